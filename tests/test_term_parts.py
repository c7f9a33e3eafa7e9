"""Partitions of the term counts follow the text, rows of a split stay where they are."""

from pyspark.sql import functions as F

from quillmark.operators import dataset as ds
from quillmark.operators import models as md
from quillmark.operators import text as tx


def test_terms_lie_by_document_in_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(tx, "PART_BYTES", 100)
    docs = spark.createDataFrame([(i % 90, "the cat saw a cat " * 2) for i in range(100)] + [(None, "one two"), (7, None)], "doc_id long, text string")
    got = tx.doc_terms(docs, stop_words=tx.STOP_WORDS)
    assert got.rdd.getNumPartitions() == 37
    rows = {(r.doc_id, r.term): r.tf for r in got.collect()}
    assert rows[50, "cat"] == 4 and rows[5, "cat"] == 8 and rows[None, "one"] == 1 and (5, "the") not in rows and len(rows) == 182
    tfidf = tx.tfidf(got, F.broadcast(got.select("term").distinct().withColumn("idf", F.lit(1.0))))
    plan = tfidf._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == plan.count("REPARTITION_BY_NUM")  # none but the deal
    assert tx.doc_terms(docs.limit(0)).count() == 0


def test_split_sends_its_quotas(spark):
    docs = spark.range(50).select(F.col("id"), F.concat(F.lit("l"), F.col("id") % 3).alias("lang"))
    plan = ds.exact_split(docs, stratum="lang")._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan


def test_blocks_give_the_same_scores(spark):
    rows = [(d, f"l{d % 2}", d % 3, f"t{(d * k) % 7}", 0.1 + (d + k) % 5) for d in range(30) for k in (1, 2, 3)]
    train = spark.createDataFrame(rows, "doc_id long, label string, fold int, term string, weight double")
    counts = train.groupBy("fold", "label", "term").agg(F.sum("weight").alias("fc"))
    params = md.cnb_logged(counts, ["fold"], [0.5, 1.0], ["l0", "l1"])
    cells = train.select("fold", "doc_id", "term", "weight")

    def scores(blocks):
        got = md.cnb_scores(cells, params, ["fold"], [True, False], 2, blocks=blocks).collect()
        return sorted((r.fold, r.doc_id, r.alpha, r.norm, *r.labels, *[round(x, 9) for x in r.logits]) for r in got)

    assert scores(4) == scores(None) and len(scores(4)) == 120


def test_a_block_fetches_the_terms_of_one_fit(spark):
    rows = [(d, f"l{d % 2}", d % 3, f"t{k}", 1.0) for d in range(60) for k in range(5)]
    train = spark.createDataFrame(rows, "doc_id long, label string, fold int, term string, weight double")
    params = md.cnb_logged(train.groupBy("fold", "label", "term").agg(F.sum("weight").alias("fc")), ["fold"], [1.0], ["l0", "l1"])
    got = md.cnb_scores(train.select("fold", "doc_id", "term", "weight"), params, ["fold"], [True], 2, blocks=6)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "pmod(xxhash64(doc_id" in plan and ", 2)" in plan and got.count() == 60  # two blocks a fold instead of six


def test_tokens_stay_with_their_document(spark, monkeypatch):
    monkeypatch.setattr(tx, "PART_BYTES", 200)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 13}" for j in range(1 + i % 9))) for i in range(60)] + [(3, "twice here"), (61, None)],
                                 "doc_id long, text string")
    ids = F.broadcast(tx.term_ids(tx.doc_terms(docs.where("doc_id < 40"))))
    for df in (tx.encode(docs, ids, max_len=4), tx.pack_blocks(docs, ids, block=4, batch=20)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression [doc_id" in plan
    known = {r.term: r.token_id for r in tx.term_ids(tx.doc_terms(docs.where("doc_id < 40"))).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.where("doc_id <> 3 and text is not null").collect())
    want = {}
    for b in range(3):
        stream = [known.get(w, tx.UNK_ID) for d, x in rows if d // 20 == b for w in x.split()]
        want.update({(b, i): stream[4 * i: 4 * i + 4] for i in range(len(stream) // 4)})
    got = tx.pack_blocks(docs.where("doc_id <> 3"), ids, block=4, batch=20).collect()
    assert {(r.batch, r.block): list(r.input_ids) for r in got} == want
