"""Language identification: held-out accuracy, learning only from allowed rows, calibration, awkward rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from quillmark.llm import language
from quillmark.sources.tables import table


def test_held_out_accuracy(spark, sf):
    docs = table(spark, sf, "documents")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count()
    held = got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)
    assert (got.held_out == held).all()
    assert (got[held].lang == got[held].lang_pred).mean() >= 0.98
    assert got.score.between(0, 1).all()


def test_held_out_rows_do_not_change_the_model(spark, sf):
    docs = table(spark, sf, "documents")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    other = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("z"))
    a = language.identify(docs, sample=60, bits=12).orderBy("doc_id").collect()
    b = language.identify(other, sample=60, bits=12).orderBy("doc_id").collect()
    assert a == b and all(r.lang_pred != "xx" for r in b)


def test_weights_are_sparse():
    state = language.Leader(50, 3, 0.3, 1.0, 0.5, 0.1)
    r = np.random.default_rng(0)
    for _ in range(200):
        y = int(r.integers(0, 3))
        at = np.array([y, 10 + int(r.integers(0, 40))])
        state.learn(at, np.array([1.0, 0.05]), y)
    w = state.weights()
    assert (w[:3].argmax(axis=1) == np.arange(3)).all()
    assert (w[10:] == 0).mean() > 0.9


def test_temperature_calibrates():
    r = np.random.default_rng(1)
    truth = r.integers(0, 3, 4000)
    scores = r.normal(0, 1, (4000, 3))
    scores[np.arange(4000), truth] += 1
    t = language.temperature(scores * 4, truth)
    p = language.softmax(scores * 4 / t)
    assert abs(p.max(axis=1).mean() - (p.argmax(axis=1) == truth).mean()) < 0.03


def test_awkward_rows(make, awkward):
    rows = [(i, t, None if k % 5 == 4 else ("en", "xx")[k % 2], "s") for k, (i, t) in enumerate(awkward)]
    rows += [(100 + i, f"der die das und {i} ", "de", "s") for i in range(10)]
    got = language.identify(make(rows)).toPandas()
    assert len(got) == len(rows)
    texts = {i: t for i, t, *_ in rows}
    for r in got.itertuples():
        if r.doc_id == r.doc_id and not any(c.isalpha() for c in texts[r.doc_id] or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        assert r.lang_pred in ("und", "en", "xx", "de")


def test_nothing_to_learn(make):
    got = language.identify(make([(1, "some text", None, "s")])).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    one = language.identify(make([(i, "some text", "en", "s") for i in range(8)])).collect()
    assert {r.lang_pred for r in one} == {"en"}
    assert language.identify(make([(1, "a")]).limit(0)).count() == 0


def test_rare_languages_keep_rows():
    rates = language.sample_rates({"en": 10_000_000, "fo": 500, "no": 100_000}, 12_000)
    assert rates["fo"] == 1.0
    assert sum(rates[x] * n for x, n in (("en", 10_000_000), ("fo", 500), ("no", 100_000))) <= 12_000
    assert language.sample_rates({"en": 300, "no": 40}, 12_000) == {"en": 1.0, "no": 1.0}


def test_copies_enter_one_by_one(make):
    """A text that holds most rows neither fills the sample nor stays out of it as a whole."""
    rows = [(i, "the same text of many copies", "en") for i in range(3000)]
    rows += [(5000 + i, f"et annet dokument nummer {i}", "no") for i in range(3000)]
    docs = make([(i, t, lang, "s") for i, t, lang in rows])
    got = language.predict(docs.limit(6000), language.train(docs, F.lit(True), bits=10, sample=400, updates=50)).toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.99
