"""Readers for the driver's parquet tables and the derived fixture views.

Every reader goes through ``spark.read.parquet`` so Catalyst can prune
columns and push filters into the scan.  The derived views (``bars``,
``issuers``, ``messages``) map the market-news data model onto the driver
tables; each has one DataFrame definition here and one SQL text in
``quillmark.sources.oracle`` for the DuckDB cross-check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

N_SYMBOLS = 10          # bars: symbol = 'S' || l_suppkey % 10
N_ISSUER_SYMBOLS = 13   # issuers: S10..S12 have no bars (unknown symbols)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily OHLCV bars per symbol (the price-history analogue).

    ``open`` / ``close`` are the first / last price of the day in a total
    order ``(l_orderkey, l_linenumber, l_extendedprice)``; ``min_by`` /
    ``max_by`` are partial aggregates, so the shuffle carries one row per
    (symbol, day) and map task.
    """
    li = table(spark, sf_dir, "lineitem")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_orderkey", "l_linenumber", "l_extendedprice")
    return (
        li.select(
            F.concat(F.lit("S"), (F.col("l_suppkey") % N_SYMBOLS).cast("string")).alias("symbol"),
            F.to_date("l_shipdate").alias("date"),
            px.alias("px"),
            order.alias("ord"),
            F.col("l_quantity"),
        )
        .groupBy("symbol", "date")
        .agg(
            F.min_by("px", "ord").alias("open"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.max_by("px", "ord").alias("close"),
            F.sum("l_quantity").alias("volume"),
        )
    )


def issuers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("issuerId"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("S"), (F.col("c_custkey") % N_ISSUER_SYMBOLS).cast("string")).alias("symbol"),
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category names by id (English and local); ids 1000 and 1001 are not in it."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(
        (F.col("n_nationkey") + 1002).cast("int").alias("osl_id"), F.col("n_name").alias("category_en"),
        F.concat("r_name", F.lit(" / "), "n_name").alias("category_no"))


def message_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with the key their lines carry (``messageId``), null where there is none."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("messageId")).distinct()
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return o.join(lines, F.col("id") == F.col("messageId"), "left")


def message_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages, one per order, without what comes from ``documents``; ``doc_key`` names the document.

    The document of an order is ``doc_id = o_orderkey % count(documents)``; the count is an uncorrelated scalar
    subquery (computed once).
    """
    o = table(spark, sf_dir, "orders")
    n_docs = table(spark, sf_dir, "documents").select(F.count(F.lit(1))).scalar()
    k = F.col("o_orderkey")
    return o.select(
        k.alias("id"),
        F.col("o_custkey").alias("issuerId"),
        F.col("o_orderpriority").alias("title"),
        (k % n_docs).alias("doc_key"),
        F.concat(F.lit("[{'id': "), (1000 + k % 20).cast("string"), F.lit(", 'category_en': 'c'}]")).alias("category"),
        F.timestamp_add("SECOND", (k * 7919) % 86400, F.col("o_orderdate")).alias("publishedTime"),
    )


def with_texts(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` of messages (id, doc_key, ...) with ``body`` and ``weighted_label`` of their documents (doc_id, text, lang, ...).

    An equi-join that AQE plans from measured sizes.  Its result carries a text a message, so joins and filters of the rows
    go before it.
    """
    j = rows.join(docs.withColumnRenamed("doc_id", "doc_key"), "doc_key")
    return j.withColumns({
        "body": F.when(F.col("id") % 6 == 0, F.lit(None).cast("string")).otherwise(F.col("text")),
        "weighted_label": F.when(F.col("id") % 50 == 0, F.lit(None).cast("string"))
        .when(F.col("id") % 97 == 0, F.lit("None"))
        .otherwise(F.concat(F.lit("__label__"), F.col("lang"))),
    }).drop("doc_key", "text", "lang")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock-exchange messages: one per order, body text from ``documents``."""
    return with_texts(message_rows(spark, sf_dir), texts(spark, sf_dir)).select(
        "id", "issuerId", "title", "body", "category", "publishedTime", "weighted_label")
