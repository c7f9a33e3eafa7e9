"""Registered profiling queries (D1-D13, F5, F6, C4) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions.calendar import sql_business_day_target
from quillmark.functions.numeric import round_sig, sql_round_sig
from quillmark.functions.parsing import category_id, category_name
from quillmark.operators import dataset as ds
from quillmark.operators import profile as pf
from quillmark.operators.prices import intraday_columns
from quillmark.sources import tables
from quillmark.sources.oracle import with_views

DIG = 10          # significant digits for order-dependent floating aggregates
MOVE_PCT = 1.0    # D13 threshold, percent units

DESCRIBE = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]


def _rounded(df, cols):
    return df.select(*[round_sig(F.col(c), DIG).alias(c) if c in cols else F.col(c) for c in df.columns])


def q_category_id(spark, sf):
    m = tables.messages(spark, sf)
    return m.select("id", category_id("category").alias("category_id"))


def q_category_names(spark, sf):
    """C4: category id -> name through a lookup table (here built from the data itself)."""
    m = tables.messages(spark, sf).select("id", category_id("category").alias("category_id"),
                                          category_name("category").alias("category_en"))
    lookup = m.select("category_id", "category_en").where("category_id IS NOT NULL").dropDuplicates(["category_id"])
    return m.select("id", "category_id").join(lookup, "category_id", "left")


def q_category_lookup(spark, sf):
    """C4: English and local category name of every message; ids that the lookup lacks keep their message."""
    m = tables.messages(spark, sf).select("id", category_id("category").alias("category_id"))
    names = tables.categories(spark, sf).withColumnRenamed("osl_id", "category_id")
    return m.join(names, "category_id", "left")


def q_key_mismatches(spark, sf):
    """Messages whose ``id`` is not their ``messageId``."""
    return tables.message_keys(spark, sf).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col("id").eqNullSafe(F.col("messageId"))).alias("n_mismatches"))


def q_null_profile(spark, sf):
    m = tables.messages(spark, sf)
    return pf.null_profile(m, ["title", "body", "category", "publishedTime", "weighted_label"])


def _bars_moves(spark, sf):
    b = tables.bars(spark, sf)
    return b.select("symbol", intraday_columns()["intra_day_open_close_pct"].alias("x"))


def q_describe(spark, sf):
    d = pf.describe(_bars_moves(spark, sf), "x")
    return _rounded(d, ["mean", "std", "q25", "q50", "q75"])


def q_rows_per_symbol(spark, sf):
    counts = tables.bars(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))
    d = pf.describe(counts, "rows")
    return _rounded(d, ["mean", "std", "q25", "q50", "q75"])


def q_word_lengths(spark, sf):
    m = tables.messages(spark, sf)
    return m.select("id", pf.word_count("title").alias("title_words"), pf.word_count("body").alias("body_words"))


def q_longest_text(spark, sf):
    m = tables.messages(spark, sf)
    return m.agg(F.max(pf.space_split_len("title")).alias("max_title_pieces"),
                 F.max(pf.space_split_len("body")).alias("max_body_pieces"))


def q_line_endings(spark, sf):
    m = tables.messages(spark, sf)
    return m.agg(F.count_if(F.col("body").contains("\r\n")).alias("n_crlf"),
                 F.count_if(F.col("body").contains("\n")).alias("n_lf"))


def q_key_check(spark, sf):
    """D7 + C1 validation: key uniqueness, issuer ids that would fan out, orphan messages."""
    m, i = tables.messages(spark, sf), tables.issuers(spark, sf)
    a = m.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_distinct_id"))
    dup = ds.duplicate_issuers(i).agg(F.count(F.lit(1)).alias("n_dup_issuer_ids"))
    orphan = m.join(i, "issuerId", "left_anti").agg(F.count(F.lit(1)).alias("n_orphan_messages"))
    k = F.lit(1)
    return (a.withColumn("_k", k).join(dup.withColumn("_k", k), "_k")
            .join(orphan.withColumn("_k", k), "_k").drop("_k"))


def q_move_count(spark, sf):
    x = _bars_moves(spark, sf)
    return x.agg(F.lit(MOVE_PCT).alias("threshold_pct"), F.count(F.lit(1)).alias("n_rows"),
                 F.count_if(F.abs(F.col("x") * 100) > MOVE_PCT).alias("n_moves"))


def q_distinct(spark, sf):
    """Rows and distinct symbols before and after the trading-day join."""
    bars = tables.bars(spark, sf)
    m = ds.attach_symbol(tables.messages(spark, sf), tables.issuers(spark, sf))
    joined = ds.join_history(ds.with_trading_day(ds.known_symbols(m, bars)), bars)
    before = m.agg(F.count(F.lit(1)).alias("n_messages"), F.count_distinct("symbol").alias("n_msg_symbols"))
    hist = bars.agg(F.count_distinct("symbol").alias("n_hist_symbols"))
    after = joined.agg(F.count(F.lit(1)).alias("n_matched"), F.count_distinct("symbol").alias("n_matched_symbols"))
    k = F.lit(1)
    return (before.withColumn("_k", k).join(hist.withColumn("_k", k), "_k")
            .join(after.withColumn("_k", k), "_k").drop("_k"))


# ---------------------------------------------------------------- DuckDB oracles

_CAT_JSON = "replace(category, '''', '\"')"
_WS = pf.PY_WS


def _sql_describe(src: str) -> str:
    r = lambda e: sql_round_sig(e, DIG)
    return (f"SELECT CAST(count(x) AS BIGINT) AS count, {r('avg(x)')} AS mean, {r('stddev_samp(x)')} AS std, "
            f"min(x) AS min, {r('quantile_cont(x, 0.25)')} AS q25, {r('quantile_cont(x, 0.5)')} AS q50, "
            f"{r('quantile_cont(x, 0.75)')} AS q75, max(x) AS max FROM ({src})")


_MOVES = "SELECT symbol, CASE WHEN open = 0 THEN NULL ELSE (close - open) / open END * 1.0 AS x FROM bars"


def _wc(c: str) -> str:
    return f"len(list_filter(regexp_split_to_array({c}, '{_WS}'), lambda s: s <> ''))"


QUERIES = {
    "q_category_id": q_category_id,
    "q_category_names": q_category_names,
    "q_category_lookup": q_category_lookup,
    "q_key_mismatches": q_key_mismatches,
    "q_null_profile": q_null_profile,
    "q_describe": q_describe,
    "q_rows_per_symbol": q_rows_per_symbol,
    "q_word_lengths": q_word_lengths,
    "q_longest_text": q_longest_text,
    "q_line_endings": q_line_endings,
    "q_key_check": q_key_check,
    "q_move_count": q_move_count,
    "q_distinct": q_distinct,
}

ORACLE = {
    "q_category_id": with_views(
        f"SELECT id, CAST(json_extract({_CAT_JSON}, '$[0].id') AS INTEGER) AS category_id FROM messages", "messages"),
    "q_category_names": with_views(
        f"""SELECT m.id, m.category_id, l.category_en FROM
        (SELECT id, CAST(json_extract({_CAT_JSON}, '$[0].id') AS INTEGER) AS category_id FROM messages) m
        LEFT JOIN (SELECT CAST(json_extract({_CAT_JSON}, '$[0].id') AS INTEGER) AS category_id,
                          any_value(json_extract_string({_CAT_JSON}, '$[0].category_en')) AS category_en
                   FROM messages GROUP BY 1 HAVING category_id IS NOT NULL) l USING (category_id)""", "messages"),
    "q_category_lookup": with_views(
        f"""SELECT m.id, m.category_id, c.category_en, c.category_no FROM
        (SELECT id, CAST(json_extract({_CAT_JSON}, '$[0].id') AS INTEGER) AS category_id FROM messages) m
        LEFT JOIN categories c ON c.osl_id = m.category_id""", "categories", "messages"),
    "q_key_mismatches": with_views(
        "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count_if(id IS DISTINCT FROM messageId) AS BIGINT) AS n_mismatches "
        "FROM message_keys", "message_keys"),
    "q_null_profile": with_views(
        "SELECT CAST(count(*) AS BIGINT) AS n_rows, "
        + ", ".join(f"CAST(count_if({c} IS NULL) AS BIGINT) AS null_{c}"
                    for c in ["title", "body", "category", "publishedTime", "weighted_label"])
        + " FROM messages", "messages"),
    "q_describe": with_views(_sql_describe(_MOVES), "bars"),
    "q_rows_per_symbol": with_views(
        _sql_describe("SELECT symbol, CAST(count(*) AS BIGINT) AS x FROM bars GROUP BY symbol"), "bars"),
    "q_word_lengths": with_views(f"SELECT id, {_wc('title')} AS title_words, {_wc('body')} AS body_words FROM messages",
                                 "messages"),
    "q_longest_text": with_views(
        "SELECT max(len(string_split(title, ' '))) AS max_title_pieces, "
        "max(len(string_split(body, ' '))) AS max_body_pieces FROM messages", "messages"),
    "q_line_endings": with_views(
        "SELECT CAST(count_if(contains(body, chr(13) || chr(10))) AS BIGINT) AS n_crlf, "
        "CAST(count_if(contains(body, chr(10))) AS BIGINT) AS n_lf FROM messages", "messages"),
    "q_key_check": with_views(
        """SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT id) AS BIGINT) AS n_distinct_id,
           (SELECT CAST(count(*) AS BIGINT) FROM (SELECT issuerId FROM issuers GROUP BY 1 HAVING count(*) > 1)) AS n_dup_issuer_ids,
           (SELECT CAST(count(*) AS BIGINT) FROM messages m WHERE NOT EXISTS
               (SELECT 1 FROM issuers i WHERE i.issuerId = m.issuerId)) AS n_orphan_messages
           FROM messages""", "issuers", "messages"),
    "q_move_count": with_views(
        f"SELECT CAST({MOVE_PCT!r} AS DOUBLE) AS threshold_pct, CAST(count(*) AS BIGINT) AS n_rows, "
        f"CAST(count_if(abs(x * 100) > {MOVE_PCT!r}) AS BIGINT) AS n_moves FROM ({_MOVES})", "bars"),
    "q_distinct": with_views(
        f"""SELECT (SELECT CAST(count(*) AS BIGINT) FROM mi) AS n_messages,
                   (SELECT CAST(count(DISTINCT symbol) AS BIGINT) FROM mi) AS n_msg_symbols,
                   (SELECT CAST(count(DISTINCT symbol) AS BIGINT) FROM bars) AS n_hist_symbols,
                   CAST(count(*) AS BIGINT) AS n_matched, CAST(count(DISTINCT j.symbol) AS BIGINT) AS n_matched_symbols
            FROM (SELECT mi.* FROM mi JOIN bars b ON mi.symbol = b.symbol AND mi.next_day = b.date) j""",
        "bars", "issuers", "messages",
        extra={"mi": f"SELECT m.*, i.symbol, {sql_business_day_target('m.publishedTime')} AS next_day "
                     "FROM messages m JOIN issuers i USING (issuerId)"}),
}
