"""Registered queries of arriving data: streamed messages, price files as they lie."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.plans import dataset as dp
from quillmark.session import fresh_path, stage
from quillmark.sources import ingest as ing
from quillmark.sources import tables
from quillmark.sources.oracle import with_views
from quillmark.streaming import labels

FILES = 6                  # batches of arriving files in all
FILE_BYTES = 64_000_000    # text bytes a file on average; a batch takes as many files as its share needs
# how the fixture's files differ: columns in another order, no header line, a name on the blacklist
SWAPPED, HEADERLESS, LISTED = ("S1", "S4", "S7"), "S9", {"S3": "KRAB"}


def q_stream_labels(spark, sf):
    """C2, H1 as a stream: half of the message files, then the rest after a restart; equals the labelled table.

    The files are written as the messages come, so no text moves for them; a file has as many rows as make ``FILE_BYTES`` on average.
    """
    messages = tables.messages(spark, sf)
    source, out, checkpoint = (fresh_path(spark, x) for x in ("messages", "stream_out", "stream_log"))
    part = F.pmod(F.xxhash64("id"), F.lit(FILES))
    rows, size = messages.agg(F.count("*"), F.sum(F.octet_length("body"))).first()
    at_most = max(1, rows * FILE_BYTES // max(1, size or 0))
    static = (stage(tables.issuers(spark, sf), "issuers"), stage(dp.history(spark, sf), "history"))
    columns = ["id", "symbol", "next_day", "is_positive", "is_negative", "label"]
    seen, a_batch = 0, 1
    for mine in (part < FILES // 2, part >= FILES // 2):
        messages.where(mine).write.mode("append").option("maxRecordsPerFile", at_most).parquet(source)
        found = len(ing.files_of(spark, source))
        a_batch, seen = max(1, -(-(found - seen) // (FILES // 2))), found
        labels.run(spark, source, messages.schema, *static, dp.K, out, checkpoint, columns, files_a_batch=a_batch)
    labels.run(spark, source, messages.schema, *static, dp.K, out, checkpoint, columns, files_a_batch=a_batch)  # nothing new
    return spark.read.parquet(out).select(*columns)


def _files(spark, sf) -> str:
    """Bars as ``<SYMBOL>.csv`` files whose headers differ; issuer symbols without bars get a banner only."""
    bars = tables.bars(spark, sf)
    name = F.col("symbol")
    for old, new in LISTED.items():
        name = F.when(F.col("symbol") == old, new).otherwise(name)
    bars = stage(bars.withColumn("symbol", name), "bars")
    broken = tables.issuers(spark, sf).select("symbol").distinct().join(tables.bars(spark, sf).select("symbol").distinct(), "symbol", "left_anti")
    orders = [("symbol in ('" + "', '".join(SWAPPED) + "')", ["Volume", "Date", "Low", "High", "Open", "Close"], True),
              (f"symbol = '{HEADERLESS}'", ing.RAW_COLS, False),
              ("symbol not in ('" + "', '".join((*SWAPPED, HEADERLESS)) + "')", ing.RAW_COLS, True)]
    path = fresh_path(spark, "price_files")
    ing.write_price_files(bars, path, orders, broken)
    return path


def q_price_files(spark, sf):
    """Rows of all readable files under their own headers, blacklisted symbols left out."""
    keep, _ = ing.clean_prices(ing.read_price_files(spark, _files(spark, sf)))
    return keep.select("symbol", "date", "open", "high", "low", "close", "volume")


def q_price_file_report(spark, sf):
    """What each file's header says, and why a file is set aside."""
    parsed = ing.read_price_files(spark, _files(spark, sf))
    _, aside = ing.clean_prices(parsed)
    per = parsed.groupBy("symbol", "file", "columns").agg(F.count("date").alias("n_rows"))
    return per.join(aside.select("file", "reason"), "file", "left").select("symbol", F.array_join("columns", ",").alias("columns"), "n_rows", "reason")


_NAME = "CASE " + " ".join(f"WHEN symbol = '{a}' THEN '{b}'" for a, b in LISTED.items()) + " ELSE symbol END"
_CENTS = ", ".join(f"floor({c} * 100 + 0.5) / 100 AS {c}" for c in ("open", "high", "low", "close"))
_SWAPPED = ", ".join(f"'{s}'" for s in SWAPPED)

QUERIES = {"q_stream_labels": q_stream_labels, "q_price_files": q_price_files, "q_price_file_report": q_price_file_report}

ORACLE = {
    "q_stream_labels": dp.ORACLE["q_ground_truth"],
    "q_price_files": with_views(f"""SELECT symbol, date, {_CENTS}, CAST(volume AS DOUBLE) AS volume FROM bars
        WHERE symbol <> '{HEADERLESS}' AND symbol NOT IN ({', '.join(f"'{s}'" for s in LISTED)})""", "bars"),
    "q_price_file_report": with_views(f"""SELECT {_NAME} AS symbol, CASE WHEN symbol = '{HEADERLESS}' THEN NULL
          WHEN symbol IN ({_SWAPPED}) THEN 'Volume,Date,Low,High,Open,Close' ELSE '{','.join(ing.RAW_COLS)}' END AS columns,
          CASE WHEN symbol = '{HEADERLESS}' THEN 0 ELSE count(*) END AS n_rows,
          CASE WHEN symbol = '{HEADERLESS}' THEN 'no header' END AS reason FROM bars GROUP BY symbol
        UNION ALL SELECT DISTINCT symbol, NULL, 0, 'no header' FROM issuers WHERE symbol NOT IN (SELECT DISTINCT symbol FROM bars)""",
                                      "bars", "issuers"),
}
