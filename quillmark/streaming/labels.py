"""Labelling of messages as they arrive: Structured Streaming over a folder of message files (C2, H1 as a stream).

The stream joins each micro-batch with the static issuers and price history (stage them: a static side is read
again by every batch) and appends labelled rows to a Parquet table.  The checkpoint holds which files
were read and the sink's log which files belong to a finished batch, so a restart goes on behind the last batch
and adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.operators import dataset as ds


def labelled(messages: DataFrame, issuers: DataFrame, history: DataFrame, k: int) -> DataFrame:
    """Messages (a stream or a table) with the trading day they can affect and their label."""
    joined = ds.join_history(ds.with_trading_day(ds.attach_symbol(messages, issuers)), history)
    return ds.label(ds.ground_truth(joined, k=k, lower=True, scale=1.0), lower=True)


def run(spark: SparkSession, source: str, schema, issuers: DataFrame, history: DataFrame, k: int, out: str, checkpoint: str,
        columns: list[str], files_a_batch: int = 1) -> int:
    """Labels all files of ``source`` that were not read yet; returns the number of batches this call ran."""
    messages = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    query = (labelled(messages, issuers, history, k).select(*columns).writeStream.format("parquet").outputMode("append")
             .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return sum(p["numInputRows"] > 0 for p in query.recentProgress)
