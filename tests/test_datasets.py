"""Splits, encoding, quantiles and languages on literal rows: nulls, empty texts, properties."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmark.operators import dataset as ds
from quillmark.operators import evaluate as ev
from quillmark.operators import langid as li
from quillmark.operators import models as md
from quillmark.operators import profile as pf
from quillmark.operators import text as tx


def sizes(n):
    """Test takes ceil of its share, validation ceil of its share of the rest (in doubles)."""
    test = math.ceil(ds.TEST * n)
    val = math.ceil(ds.VAL / (ds.VAL + (1 - ds.VAL - ds.TEST)) * (n - test))
    return {"train": n - test - val, "test": test, "val": val}


def test_exact_split_keeps_null_strata(spark):
    rows = [(i, ["a", "b", None][i % 3], float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, weighted_label string, x double")
    got = ds.exact_split(df).toPandas()
    assert sorted(got["id"]) == list(range(100)) and list(got.columns) == ["id", "weighted_label", "x", "split"]
    assert got["split"].value_counts().to_dict() == sizes(100)
    null = got[got["weighted_label"].isna()]["split"].value_counts()
    assert null["train"] >= 22 and null["test"] >= 6


def test_encode_keeps_texts_without_tokens(spark):
    docs = spark.createDataFrame([(1, None), (2, "?!"), (3, "the cat the")], "doc_id long, text string")
    ids = spark.createDataFrame([("the", 2), ("cat", 3)], "term string, token_id int")
    got = {r["doc_id"]: r for r in tx.encode(docs, ids, max_len=4).collect()}
    assert list(got[1]["input_ids"]) == [0] * 4 and list(got[1]["attention_mask"]) == [0] * 4
    assert list(got[2]["input_ids"]) == [0] * 4
    assert list(got[3]["input_ids"]) == [2, 3, 2, 0] and list(got[3]["attention_mask"]) == [1, 1, 1, 0]
    cut = {r["doc_id"]: list(r["input_ids"]) for r in tx.encode(docs, ids, max_len=2).collect()}
    assert cut[3] == [2, 3]


def test_unscored_documents_are_labelled_none(spark):
    docs = spark.createDataFrame([(1, "hello there all"), (2, "x"), (3, "")], "doc_id long, text string")
    fit = spark.createDataFrame([(9, "hello there all", "en"), (8, "guten tag allerseits", "de")],
                                "doc_id long, text string, lang string")
    model, priors = li.fit(fit)
    got = {r["doc_id"]: r for r in li.document_language(li.score_paragraphs(li.paragraphs(docs), model, priors),
                                                        docs).collect()}
    assert got[1]["weighted_label"] == "en" and got[1]["n_paragraphs"] == 1
    for i in (2, 3):
        assert (got[i]["weighted_label"], got[i]["n_paragraphs"], got[i]["weighted_label_conf"]) == ("None", 0, None)
        assert got[i]["weighted_scores"] == {}


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_equal_pandas(spark, seed):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(0, 3, 3000), seed)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    got = pf.exact_quantiles(df, "x", [0.25, 0.5, 0.75]).first()
    want = pd.Series(x).quantile([0.25, 0.5, 0.75])
    assert [got["q25"], got["q50"], got["q75"]] == pytest.approx(list(want), abs=1e-12)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_complement_nb_against_numpy(spark):
    r = np.random.default_rng(4)
    x = r.random((30, 6)) * (r.random((30, 6)) < 0.6)
    y = np.array(["a", "b", "c"])[np.arange(30) % 3]
    rows = [(int(i), str(y[i]), f"t{j}", float(x[i, j])) for i in range(30) for j in range(6) if x[i, j] > 0]
    train = spark.createDataFrame(rows, "doc_id long, label string, term string, weight double")
    for alpha in (0.5, 1.0):
        for norm in (True, False):
            comp = np.stack([x[y != c].sum(axis=0) for c in "abc"]) + alpha
            logged = np.log(comp / comp.sum(axis=1, keepdims=True))
            w = logged / logged.sum(axis=1, keepdims=True) if norm else -logged
            got = md.cnb_sql(train, train, alpha, norm)
            for row in got.collect():
                jll = x[row["doc_id"]] @ w.T
                assert list(row["logits"]) == pytest.approx(list(jll)) and row["pred"] == "abc"[int(jll.argmax())]
    # the totals of a class are grouped sums: no window over a whole class
    assert "Window" not in _plan(md.cnb_sql(train, train))


def test_scores_of_renamed_clusters(spark):
    rows = [(k % 4, "wxyz"[(k % 4 + 1) % 4]) for k in range(40)]
    ct = ev.contingency(spark.createDataFrame(rows, "y long, p string"))
    s = ev.cluster_scores(ct).first()
    assert s["ari"] == pytest.approx(1) and s["v_measure"] == pytest.approx(1)


def test_splits_are_disjoint_and_exact(spark):
    df = spark.range(997).withColumn("weighted_label", F.concat(F.lit("l"), (F.col("id") % 7).cast("string")))
    got = ds.exact_split(df).groupBy("split").count().toPandas().set_index("split")["count"].to_dict()
    assert got == sizes(997)
