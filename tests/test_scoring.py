"""Saved models, resumable sweep, double-encoded result files and training histories."""

import json

import numpy as np
import pytest

from quillmark.operators import scoring as sc
from quillmark.operators import sketch_svm as sv
from quillmark.session import fresh_path
from quillmark.sources import ingest as ing
from quillmark.sources import results as rs

TEXTS = ["the red fox runs", "der rote fuchs rennt", "a red dog runs fast", "ein roter hund rennt schnell"]


@pytest.fixture(scope="module")
def cnb(spark):
    docs = spark.createDataFrame([(i, TEXTS[i % 4], ["en", "de"][i % 2]) for i in range(20)], "doc_id long, text string, label string")
    idf = docs.selectExpr("explode(split(text, ' ')) AS term").distinct().selectExpr("term", "1.5D AS idf")
    return sc.fit_cnb(docs, idf, 1.0, False)


def rows_of(spark, texts):
    return spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts)], "row_id long, truth string, input string")


def test_saved_model_and_class_order(spark, cnb):
    path = fresh_path(spark, "model")
    sc.save(cnb, spark, path)
    rows = rows_of(spark, [*TEXTS, None, "", "unseen"])
    want = {r.row_id: r for r in sc.score(cnb, rows).collect()}
    got = {r.row_id: r for r in sc.score(sc.load(spark, path), rows).collect()}
    assert got == want and [want[i].label for i in range(4)] == ["en", "de", "en", "de"]
    assert all(want[i].logits == [0.0, 0.0] and want[i].label == "de" for i in (4, 5, 6))  # first class in order
    flip = cnb.tables["params"].selectExpr("term", "alpha", "reverse(logged) AS logged", "reverse(`all`) AS `all`")
    sc.save(cnb._replace(classes=cnb.classes[::-1], tables={**cnb.tables, "params": flip}), spark, path + "-flip")
    turned = {r.row_id: r for r in sc.score(sc.load(spark, path + "-flip"), rows).collect()}
    for i in range(4):
        assert turned[i].label == want[i].label and turned[i].logits == want[i].logits[::-1] and turned[i].label_id == 1 - want[i].label_id


def test_vector_scorer_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(60, 5)), rng.integers(0, 3, 60)
    df = spark.createDataFrame([(i, int(b), a.tolist()) for i, (a, b) in enumerate(zip(x, y))], "row_id long, truth int, input array<double>")
    model = sc.fit_centres(df.withColumnsRenamed({"input": "vector", "truth": "label"}))
    more = df.unionByName(spark.createDataFrame([(99, None, None)], df.schema))
    got = {r.row_id: r for r in sc.score(model, more).collect()}
    c = np.array([x[y == k].mean(axis=0) for k in range(3)])
    near = ((x[:, None] - c) ** 2).sum(2).argmin(1)
    assert [int(got[i].label) for i in range(60)] == near.tolist()
    assert np.allclose([got[i].logits for i in range(60)], 2 * x @ c.T - (c * c).sum(1))
    assert got[99].logits == [0.0] * 3 and got[99].label == "0"
    assert sc.score(model, df.limit(0)).count() == 0


def test_broken_sweep_goes_on_and_changed_input_is_scored_again(spark, cnb):
    store, data = fresh_path(spark, "store"), fresh_path(spark, "data")
    rows_of(spark, TEXTS).write.parquet(data)
    work = [("Some/model", "text", d) for d in ("a", "b", "c")]
    calls = []

    def state(*key):
        return ing.fingerprint(spark, [data], *key)

    def score(model, field, dataset, broken=()):
        if dataset in broken:
            raise RuntimeError("lost")
        calls.append(dataset)
        return sc.score(cnb, spark.read.parquet(data))

    with pytest.raises(RuntimeError):
        rs.sweep(spark, store, work, state, lambda *k: score(*k, broken=("b",)))
    assert calls == ["a"]
    # a task lost half-way leaves files without a commit record
    spark.range(3).write.parquet(rs.folder_of(store, work[1], state(*work[1])))
    spark.sparkContext._jvm.java.io.File(rs.folder_of(store, work[1], state(*work[1])) + "/_SUCCESS").delete()
    log = rs.sweep(spark, store, work, state, score)
    assert calls == ["a", "b", "c"] and [r.outcome for r in log.collect()] == ["kept", "scored", "scored"]
    rows = rs.read(log, store)
    assert rows.groupBy(*rs.KEY).count().count() == 3 and rows.count() == 12 and rows.first().model == "Some/model"
    assert {r.outcome for r in rs.sweep(spark, store, work, state, score).collect()} == {"kept"} and len(calls) == 3
    rows_of(spark, ["a red fox"]).write.mode("append").parquet(data)
    again = rs.sweep(spark, store, work, state, score)
    assert {r.outcome for r in again.collect()} == {"scored"} and rs.read(again, store).count() == 15
    assert rs.read(rs.sweep(spark, store, [], state, score), store).count() == 0


def test_json_round_trip_and_foreign_file(spark, cnb):
    rows = sc.score(cnb, rows_of(spark, TEXTS * 9)).selectExpr("'m/\"q\"' AS model", "'text' AS field", "'t' AS dataset", "*")
    path = fresh_path(spark, "json")
    rs.write_json(rows, path, block_rows=10)
    assert spark.read.text(path).count() > 1
    cols = [*rs.KEY, "row_id", "logits", "label_id"]
    assert sorted(map(tuple, rs.read_json(spark, path).select(cols).collect())) == sorted(map(tuple, rows.select(cols).collect()))
    tree = {"x": {"body": {"all": {"ds_path": "p", "results": {"f1": 0.5}, "logits": [[0.1, 0.9], [2, 1]], "label_ids": [1, 0]},
                           "en": {"ds_path": "p", "results": None, "logits": None}}}}
    other = fresh_path(spark, "foreign")
    spark.createDataFrame([(json.dumps(json.dumps(tree)),)], "value string").coalesce(1).write.text(other)
    got = rs.read_json(spark, other)
    assert sorted(map(tuple, got.collect())) == [("x", "body", "all", 0, [0.1, 0.9], 1), ("x", "body", "all", 1, [2.0, 1.0], 0)]
    new = got.unionByName(got.selectExpr("'y' AS model", "field", "dataset", "row_id", "logits", "label_id"))
    merged = rs.merge(new.withColumn("label_id", new.label_id + 10), got)  # the stored model wins, the other joins it
    assert sorted((r.model, r.label_id) for r in merged.collect()) == [("x", 0), ("x", 1), ("y", 10), ("y", 11)]


def test_losses_equal_numpy(spark):
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, i % 3, i % 2, 1.0 + i % 3) for i in range(40)], "doc_id long, y int, fold int, w double")
    cells = spark.createDataFrame([(i, f"t{j}", float(rng.random())) for i in range(39) for j in rng.choice(9, 4, replace=False)],
                                  "doc_id long, term string, weight double")
    rows, sketch, fits = sv.rows_of(docs, cells), sv.Sketch([1, 2], 64, 1.0), sv.fits_of([0.1, 10], range(3))
    seen = {}
    w = sv.train(rows, fits, 3, 40, sketch, rounds=2, passes=1, watch=lambda step, x: seen.update({step: [a.copy() for a in x]}))
    assert sorted(seen) == [0, 1, 2] and all((a == b).all() for a, b in zip(seen[2], w)) and not seen[0][0].any()
    got = {(r.degree, r.fit): r for r in sv.losses(rows, w, fits, sketch).collect()}
    p = rows.toPandas()
    x = sketch(p["terms"].tolist(), p["weights"].tolist())
    for d in (1, 2):
        for f in range(6):
            s = x[d - 1] @ w[d - 1][:, f]
            hinge = [wt * max(0, 1 + max(np.delete(row, y)) - row[y]) for row, y, wt in zip(s, p["y"], p["w"])]
            held = (p["fold"] == fits.fold[f]).to_numpy()
            assert np.isclose(got[d, f].loss, np.mean(np.array(hinge)[~held]))
            assert got[d, f].eval_loss is None if not held.any() else np.isclose(got[d, f].eval_loss, np.mean(np.array(hinge)[held]))


def test_saved_machine_equals_the_trained_one(spark, sf):
    from quillmark.plans import scoring as ps
    from quillmark.plans import svm as sp

    data = sp.Data(spark, sf)
    sketch = sv.Sketch([2], 128, data.gamma)
    w = sv.train(data.fit, sv.fits_of([1], [sv.NO_FOLD]), len(data.classes), data.n, sketch, rounds=1)
    want = {r.doc_id: r for r in sv.predict(data.test(), w, sketch).collect()}
    path = fresh_path(spark, "svm")
    sc.save(sc.keep_svm(data.classes, data.idf, w[0], sketch), spark, path)
    model = sc.load(spark, path)
    turned = model._replace(classes=model.classes[::-1])  # the weights follow the names
    for m in (model, turned):
        got = {r.row_id: r for r in sc.score(m, ps.inputs(spark, sf, "text", "test")).collect()}
        assert got.keys() == want.keys() and len({tuple(r.logits) for r in got.values()}) > 1
        for i, r in want.items():
            assert np.allclose(got[i].logits if m is model else got[i].logits[::-1], r.scores)
            assert got[i].label == data.classes[r.p]
