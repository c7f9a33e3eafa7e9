"""The pipeline stage by stage against brute force on the small tables, and the driver's guard."""

import re

import pytest

import corpus_pipeline
from quillmark.llm import mixing, quality
from quillmark.session import stage
from quillmark.sources.tables import table
from tests.llm.test_ngram_join import brute, shingles

SECRET = re.compile(r'token = "[0-9a-f]{40}"|password=[0-9a-f]{18}|AKIA[A-Z2-7]{16}')


@pytest.fixture(scope="module")
def steps(spark, sf):
    """The documents after every stage, written and read again as the driver does."""
    docs, out = table(spark, sf, "documents"), []
    for name, step in corpus_pipeline.STAGES:
        after = stage(step(spark, docs, sf), "test_" + name.replace(" ", "_"))
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_keep_the_columns(steps):
    assert [n for n, _, _ in steps] == ["quality rules", "n-gram Jaccard join", "secret scans",
                                        "mixing sources to target weights", "best-fit packing"]
    for _, before, after in steps[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_quality_rules(spark, sf, steps):
    _, before, after = steps[0]
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    kept = {r["doc_id"] for r in after.collect()}
    for r in before.collect():
        n, _, _, _, repeat = quality.rule_statistics(r["text"])[0]
        base_failed = n < 50 or 100 * repeat > 50 * n
        assert not (base_failed and r["doc_id"] in kept)
        if labels.get(r["doc_id"]) == 1 and not base_failed:
            assert r["doc_id"] in kept  # clean documents stay


def test_one_document_of_each_group_stays(steps):
    _, before, after = steps[1]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    want, _ = brute(rows, 5, 80)
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({w[2] if shingles(t, 5) else i for w, (i, t) in zip(want, rows)})


def test_secrets_are_gone_and_documents_stay(steps):
    _, before, after = steps[2]
    old, new = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (before, after))
    assert old.keys() == new.keys()
    for i, text in old.items():
        if not SECRET.search(text):
            assert new[i] == text
        assert not SECRET.search(new[i])


def test_mix_follows_its_report(steps):
    _, before, after = steps[3]
    want = {r["doc_id"]: r["copies"] for r in mixing.mix_report(before).collect() if r["copies"]}
    got = {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert got == want


def test_packing_holds_every_piece(steps):
    _, before, after = steps[4]
    rows = after.toPandas()
    assert (rows["piece"] == 0).sum() == before.count()
    total = rows.groupby("sequence_id")["length"].sum()
    assert total.max() <= 2048 and len(total) <= -(-rows["length"].sum() // 2048) * 1.05 + 1


def test_run_and_empty_documents(spark, sf, steps, make):
    assert corpus_pipeline.ORACLE_SQL is None
    none = table(spark, sf, "documents").limit(0)
    for _, step in corpus_pipeline.STAGES:
        none = stage(step(spark, none, sf), "test_empty")
        assert none.count() == 0


def test_the_rest_works_without_these_parts(monkeypatch):
    import importlib.util as u

    import __spark_entry__ as e
    every = set(e.queries())
    find = u.find_spec
    monkeypatch.setattr(u, "find_spec", lambda n, *a: None if n in ("quillmark.llm", "corpus_pipeline") else find(n, *a))
    rest = set(e.queries())
    assert every - rest == {"pipeline"} | {q for q in every if q.startswith("op")} and len(every - rest) == 11
    assert not any(q.startswith("op") for q in e.oracle_sql())
