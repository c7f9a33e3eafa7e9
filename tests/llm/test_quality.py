"""Quality rules: base numbers against brute force, verdicts on labelled rows, awkward rows."""

import re

import numpy as np

from quillmark.llm import quality
from quillmark.sources.tables import table
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.findall(x)]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit |= {i, i + 1, i + 2}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_base_numbers(spark, make, awkward):
    rows = [r for r in awkward if len(r[1] or "") < 10_000] + [
        (20, "a b c a b c\na b c\n\n a b c\na b c"), (21, "x x x x x"), (22, "## a|b <c>\n## a|b <c>")]
    got = quality.rate(make(rows), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert len(got) == len(rows)
    want = sorted(brute(t) for _, t in rows)
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept is (not r.base_failed)  # no labels: only the base rules decide


def test_verdicts_on_labels(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = quality.rate(docs, labels).join(labels, "doc_id").where("not base_failed").toPandas()
    assert (got[got.quality == 1].kept).mean() >= 0.99
    assert (~got[got.quality == 0].kept).mean() >= 0.95
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == quality.rate(docs, labels).where("kept").count()


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.normal(0, 0.1, (500, 3)), rng.normal(5, 0.1, (10, 3))])
    score = quality.Forest(rows, 50, 128, 1).score(rows)
    assert score[500:].min() > score[:500].max()


def test_pool_is_a_sample_of_rows(make, monkeypatch):
    """More rows than the trees draw: every vector enters the pool by its share, not by its hash."""
    clean = [(i, f"{prose(i % 40, 60)} {prose(i, 3)}") for i in range(1800)]
    junk = [(5000 + i, f"{prose(i, 60)} {'# ' * (20 + 10 * (i % 8))}") for i in range(200)]
    stats = quality.statistics(make(clean + junk))
    forest = quality.fit(stats, trees=20, sample=16)
    seen = []
    monkeypatch.setattr(quality, "Forest", lambda rows, *a: seen.append(rows))
    quality.fit(stats, trees=20, sample=16)
    (pool,) = seen
    assert len(pool) == 320 and 0.84 < (pool == 0).all(axis=1).mean() < 0.96
    assert forest.score(np.zeros((1, 4)))[0] < forest.score(pool[(pool > 0).any(axis=1)]).min()


def test_conflicting_and_missing_labels(spark, make):
    docs = make([(i, prose(i, 60)) for i in range(20)] + [(50, "## " * 100)])
    labels = spark.createDataFrame([(50, 0), (50, 1), (1, 1), (2, None), (None, 1)], "doc_id long, quality int")
    _, _, cut = quality.train(docs.select("doc_id", "text"), labels)
    assert cut is None


def test_empty_table(spark, make):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.rate(make([(1, "a")]).limit(0), labels).count() == 0
    assert quality.keep_good(make([(1, "a")]).limit(0), labels).count() == 0
