"""Source mix: water-filled targets, bounds, nearness, reruns."""

import math

import pytest

from quillmark.llm import mixing
from tests.llm.conftest import prose


def test_targets():
    got = mixing.target_sizes({"a": 10, "b": 100, None: 50, "c": 0})
    assert got["a"] == 20 and got["c"] == 0
    assert sum(got.values()) == pytest.approx(1.5 * 160)
    assert got["b"] <= 200 and got[None] <= 100
    # order a, b, c, null: weights 5, 2, 1, 5; a and then null reach their cap
    assert got[None] == pytest.approx(100) and got["b"] == pytest.approx(120)
    assert mixing.target_sizes({}) == {}
    even = mixing.target_sizes({"a": 100, "b": 100, "c": 100})
    assert even == {"a": 200, "b": pytest.approx(500 / 3), "c": pytest.approx(250 / 3)}


def rows():
    out = []
    for i in range(300):
        src = ["big", "big", "big", "b", "é", None][i % 6]
        out.append((i, prose(i, 3000 if i % 97 == 0 else 5 + i % 60), "en", src))
    return out + [(400, "", "en", "empty"), (401, None, "en", "empty"), (None, "one two", "en", "b")] + [
        (500, "same text here", "en", "big")] * 40


def test_mix_meets_targets(make):
    docs = make(rows())
    got = mixing.mix_report(docs).toPandas()
    assert len(got) == docs.count()
    assert (got["taken"] <= 2 * got["size"]).all() and (got["taken"] >= 0).all()
    by = got.groupby(got["source"].fillna("~null"))
    for s, g in by:
        assert g["size"].sum() == g["source_size"].iloc[0]
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= max(0.005 * g["target"].iloc[0], 20), s
    assert by["target"].first().sum() == pytest.approx(1.5 * got["size"].sum())
    again = mixing.mix_report(docs).toPandas()
    order = ["doc_id", "taken", "size"]
    assert got.sort_values(order)["taken"].tolist() == again.sort_values(order)["taken"].tolist()


def test_mix_repeats_rows(make):
    docs = make(rows())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    report = mixing.mix_report(docs)
    assert mixed.count() == report.selectExpr("sum(copies)").first()[0]


def test_tilts_solve_the_dual(spark, make):
    """The rates before rounding meet the target and depend on size exponentially."""
    docs = make(rows())
    groups = mixing._sized(docs).groupBy("_source", "_size").count().withColumnRenamed("count", "n")
    sizes = {r[0]: r[1] for r in groups.selectExpr("_source", "_size * n AS w").groupBy("_source").sum("w").collect()}
    count = {r[0]: r[1] for r in groups.groupBy("_source").sum("n").collect()}
    target = {s: 1.3 * w for s, w in sizes.items()}
    tilts = mixing._tilts(groups, sizes, count, target, 2.0)
    for s in sizes:
        if not sizes[s]:
            continue
        got = sum(r["n"] * r["_size"] * 2 / (1 + math.exp(-tilts[s] * r["_size"] * count[s] / sizes[s]))
                  for r in groups.where(groups["_source"] == s).collect())
        assert got == pytest.approx(target[s], rel=1e-5)


def test_awkward_rows(make, awkward):
    docs = make([(i, t, "en", None if k % 3 else "x") for k, (i, t) in enumerate(awkward)])
    got = mixing.mix_report(docs, bucket_rows=2).toPandas()
    assert len(got) == len(awkward) and (got["taken"] <= 2 * got["size"]).all()


def test_empty_table(make):
    none = make([(1, "a")]).limit(0)
    assert mixing.mix_report(none).count() == 0
    assert mixing.mix(none).count() == 0
