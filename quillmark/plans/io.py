"""Registered write / read round trips.

Every query writes Spark-derived data to the shared checkpoint folder
(``spark.checkpoint.dir``), reads it back through the engine's readers and
returns what the reader produced, so the sinks and sources are exercised
end to end on the whole tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators import evaluate as ev
from quillmark.plans import dataset as dp
from quillmark.plans import evaluation as ep
from quillmark.plans.evaluation import predictions
from quillmark.session import fresh_path
from quillmark.sources import ingest as ing
from quillmark.sources import tables
from quillmark.sources.oracle import with_views

RESULT_KEY = ["model", "field", "dataset"]
RESULT_JSON = "accuracy DOUBLE, precision DOUBLE, recall DOUBLE, f1 DOUBLE"


def _scratch(spark, name: str) -> str:
    return fresh_path(spark, name)


def _price_files(spark, sf) -> DataFrame:
    """Bars written as per-symbol price CSVs (A10 source format) and scanned back.

    Issuer symbols without bars get a banner-only file: the unreadable files of A6.
    """
    bars = tables.bars(spark, sf)
    syms = bars.select("symbol").distinct()
    broken = tables.issuers(spark, sf).select("symbol").distinct().join(syms, "symbol", "left_anti")
    path = _scratch(spark, "prices")
    ing.write_price_csvs(bars, path, broken)
    return ing.read_price_dir(spark, path)


def q_price_ingest(spark, sf):
    """Parsed, cleaned price rows (prices carry the two decimals of the file format)."""
    keep, _ = ing.clean_prices(_price_files(spark, sf))
    return keep.select("symbol", "date", "open", "high", "low", "close", "volume")


def q_quarantine(spark, sf):
    """Files without one parsable row, by symbol."""
    _, quarantine = ing.clean_prices(_price_files(spark, sf))
    return quarantine.select("symbol", "reason").distinct()


def q_roundtrip_splits(spark, sf):
    """All dataset splits written as one partitioned table, then read back split by split."""
    views = dp._views(spark, sf)
    allsplits = reduce(DataFrame.unionByName, [
        dp.split_view(v, k).select("id", "weighted_label", "label", "split").withColumn("dataset", F.lit(k))
        for k, v in views.items()])
    path = _scratch(spark, "splits")
    ing.write_splits(allsplits, path)
    parts = [ing.read_split(spark, path, k, s).groupBy("weighted_label").agg(F.count(F.lit(1)).alias("n"))
             .select(F.lit(k).alias("dataset"), "weighted_label", F.lit(s).alias("split"), "n")
             for k in views for s in ("train", "val", "test")]
    return reduce(DataFrame.unionByName, parts)


def _run_results(spark, sf, models: DataFrame) -> DataFrame:
    """K1 scores of each pending model, as JSON result rows keyed (model, field, dataset)."""
    pred = predictions(spark, sf)
    cols = {"logits_argmax": "p", "cluster_ids": "cluster"}
    todo = {r["model"] for r in models.select("model").collect()}  # the work list is a handful of names
    parts = [ev.weighted_scores(ev.contingency(pred, "y", c)).select(
        F.lit(m).alias("model"), F.lit("embedding").alias("field"), F.lit("all").alias("dataset"),
        F.to_json(F.struct("accuracy", "precision", "recall", "f1")).alias("results"))
        for m, c in cols.items() if m in todo]
    if not parts:
        return spark.createDataFrame([], "model string, field string, dataset string, results string")
    return reduce(DataFrame.unionByName, parts)


def q_result_store(spark, sf):
    """Resumable evaluation sweep with a parquet results table.

    A first run stores one model; the sweep then scores only the models
    missing from the store (left anti join on the key), appends them, and
    merges with the stored rows (stored values win).  The stage of the first
    run is reused through its ``_SUCCESS`` marker.
    """
    store = _scratch(spark, "results")
    work = spark.createDataFrame([(m, "embedding", "all") for m in ("logits_argmax", "cluster_ids")],
                                 "model string, field string, dataset string")
    first = ing.load_or_build(spark, store + "/run0",
                              lambda: _run_results(spark, sf, work.where(F.col("model") == "logits_argmax")))
    pending = work.join(first.select(*RESULT_KEY), RESULT_KEY, "left_anti")
    new = _run_results(spark, sf, pending)
    new.write.mode("append").parquet(store + "/runs")
    stored = spark.read.parquet(store + "/runs")
    merged = (first.alias("e").join(stored.alias("b"), RESULT_KEY, "full_outer")
              .select(*RESULT_KEY, F.coalesce("e.results", "b.results").alias("results")))
    r = F.from_json("results", RESULT_JSON)
    return merged.select(*RESULT_KEY, *[F.round(r[c], 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


QUERIES = {
    "q_price_ingest": q_price_ingest,
    "q_quarantine": q_quarantine,
    "q_roundtrip_splits": q_roundtrip_splits,
    "q_result_store": q_result_store,
}

_CENTS = ", ".join(f"floor({c} * 100 + 0.5) / 100 AS {c}" for c in ("open", "high", "low", "close"))


def _scores_sql(model: str, col: str) -> str:
    mean = ", ".join(f"round({e}, 6) AS {c}" for c, e in (
        ("accuracy", "sum(tp) / sum(support)"), ("precision", "sum(precision * support) / sum(support)"),
        ("recall", "sum(recall * support) / sum(support)"), ("f1", "sum(f1 * support) / sum(support)")))
    return (f"SELECT '{model}' AS model, 'embedding' AS field, 'all' AS dataset, * FROM "
            f"(WITH {ep._preds(col)}{ep._STATS} SELECT {mean} FROM st)")


ORACLE = {
    "q_price_ingest": with_views(f"SELECT symbol, date, {_CENTS}, CAST(volume AS DOUBLE) AS volume FROM bars", "bars"),
    "q_result_store": _scores_sql("logits_argmax", "p") + " UNION ALL " + _scores_sql("cluster_ids", "cluster"),
    "q_quarantine": with_views(
        """SELECT DISTINCT symbol, 'no parsable row' AS reason FROM issuers
           WHERE symbol NOT IN (SELECT DISTINCT symbol FROM bars)""", "bars", "issuers"),
    "q_roundtrip_splits": dp.ORACLE["q_split_sizes"],
}
