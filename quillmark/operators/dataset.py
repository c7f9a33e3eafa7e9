"""Message dataset build: issuer join, trading-day join, labelling, language views,
exact-size stratified splits (B2-B5, C1-C3, H1-H5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.calendar import after_close, business_day_target
from quillmark.functions.numeric import safe_div

# Label names and the split parameters of the dataset build.
LABELS = ("positive", "negative", "neutral")
EN = "__label__en"
VAL, TEST, SEED = 0.1, 0.2, 37
HEX_DIGITS = 4   # rank buckets = 16**HEX_DIGITS per stratum (md5 prefix keeps order)


def attach_symbol(msgs: DataFrame, issuers: DataFrame) -> DataFrame:
    """Message x issuer, inner equi-join on issuerId (many-to-one)."""
    return msgs.join(issuers.select("issuerId", "symbol", "name"), "issuerId")


def duplicate_issuers(issuers: DataFrame) -> DataFrame:
    """Issuer ids that appear more than once (would fan out C1)."""
    return issuers.groupBy("issuerId").count().where("count > 1")


def known_symbols(msgs: DataFrame, hist: DataFrame, known: bool = True) -> DataFrame:
    """Keep (or drop) messages whose symbol appears in the history.

    The distinct symbol list is aggregated first; AQE broadcasts it when its
    measured size is under the threshold, otherwise it is a shuffle semi-join.
    """
    syms = hist.select("symbol").distinct()
    return msgs.join(syms, "symbol", "left_semi" if known else "left_anti")


def with_trading_day(msgs: DataFrame, ts: str = "publishedTime") -> DataFrame:
    """``is_next_day`` (after the close) and ``next_day`` (target date)."""
    return msgs.withColumns({"is_next_day": after_close(ts), "next_day": business_day_target(ts)})


def join_history(msgs: DataFrame, hist: DataFrame) -> DataFrame:
    """Inner equi-join on (symbol, next_day = date); a missing trading day drops the message."""
    h = hist.withColumnRenamed("date", "next_day")
    return msgs.join(h, ["symbol", "next_day"])


def ground_truth(df: DataFrame, occ_col: str = "intra_day_open_close_pct", k: int = 3,
                 lower: bool = True, scale: float = 1.0) -> DataFrame:
    """H1/H3: threshold t = ewm_std_k / ewm_k (x scale); positive if occ > t, negative if occ < t.

    No minus sign on the lower bound (as in the source data build).  NULL
    inputs give NULL flags, hence neutral.
    """
    names = LABELS if lower else tuple(x.upper() for x in LABELS)
    t = safe_div(F.col(f"ewm_std_{k}"), F.col(f"ewm_{k}")) * scale
    occ = F.col(occ_col)
    return df.withColumns({
        "is_positive": F.when(occ > t, F.lit(names[0])),
        "is_negative": F.when(occ < t, F.lit(names[1])),
    })


def label(df: DataFrame, lower: bool = True) -> DataFrame:
    """H2: first non-missing of positive, negative, else neutral."""
    neutral = LABELS[2] if lower else LABELS[2].upper()
    return df.withColumn("label", F.coalesce("is_positive", "is_negative", F.lit(neutral)))


def language_views(df: DataFrame, lang: str = "weighted_label") -> dict[str, DataFrame]:
    """English, non-English (null-safe, keeps missing) and all."""
    c = F.col(lang)
    return {"msg_en": df.where(c == EN), "msg_all": df, "msg_no": df.where(~c.eqNullSafe(EN))}


def drop_none_sentinel(df: DataFrame, lang: str = "weighted_label") -> DataFrame:
    """Drop the literal string 'None' (missing values are kept)."""
    return df.where(~F.col(lang).eqNullSafe("None"))


def keep_common_strata(df: DataFrame, stratum: str = "weighted_label", min_count: int = 2) -> DataFrame:
    """Keep rows whose stratum has more than ``min_count`` rows; missing strata drop."""
    big = df.where(F.col(stratum).isNotNull()).groupBy(stratum).count().where(F.col("count") > min_count)
    return df.join(big.select(stratum), stratum, "left_semi")


def split_sizes(n: Column, val: float = VAL, test: float = TEST):
    """n_test = ceil(test*n); n_val = ceil(r*(n - n_test)), r = val / (val + (1 - val - test))."""
    r = val / (val + (1 - val - test))
    n_test = F.ceil(F.lit(test) * n)
    n_val = F.ceil(F.lit(r) * (n - n_test))
    return n_test, n_val


def _largest_remainder(strata: DataFrame, total: Column, size_col: str, out: str) -> DataFrame:
    """Apportion ``total`` over strata proportional to ``size_col``; ties by stratum name.

    ``strata`` has one row per stratum (a handful of languages), so the
    un-partitioned window below runs over that tiny table only.
    """
    exact = F.col(size_col) * total / F.sum(size_col).over(Window.partitionBy())
    s = strata.withColumns({"_fl": F.floor(exact), "_rem": exact - F.floor(exact)})
    s = s.withColumn("_need", total - F.sum("_fl").over(Window.partitionBy()))
    rank = F.row_number().over(Window.orderBy(F.desc("_rem"), F.asc("_s")))
    return s.withColumn(out, (F.col("_fl") + F.when(rank <= F.col("_need"), 1).otherwise(0)).cast("bigint")).drop(
        "_fl", "_rem", "_need")


def stratum_rank(df: DataFrame, key: str, stratum: str | None, seed: int = SEED) -> DataFrame:
    """Add ``_s`` (stratum) and ``_rank``: 1-based rank of each row in its stratum by ``md5(seed|key)``.

    Exact without a single-task window: rows are bucketed by the hash prefix,
    bucket counts (small) are prefix-summed per stratum, and rows are numbered
    inside their bucket, so a stratum holding most rows still spreads over
    16**HEX_DIGITS tasks.
    """
    # a null stratum is a stratum of its own: a prefix keeps it apart and joinable
    s_col = F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")) if stratum else F.lit("")
    h = df.withColumns({
        "_s": s_col,
        "_h": F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))),
    }).withColumn("_bk", F.substring("_h", 1, HEX_DIGITS))
    counts = h.groupBy("_s", "_bk").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.select(
        "_s", "_bk",
        F.coalesce(F.sum("_n").over(Window.partitionBy("_s").orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"),
    )
    rn = F.row_number().over(Window.partitionBy("_s", "_bk").orderBy("_h", key))
    return h.join(offs, ["_s", "_bk"]).withColumn("_rank", F.col("_off") + rn).drop("_h", "_bk", "_off")


def exact_split(df: DataFrame, key: str = "id", stratum: str | None = "weighted_label",
                val: float = VAL, test: float = TEST, seed: int = SEED) -> DataFrame:
    """H4: exact-size train / val / test assignment (column ``split``).

    Rows of each stratum are ranked by ``md5(seed|key)`` (:func:`stratum_rank`).
    Quotas per stratum: test by largest remainder of n_test, then val over what
    remains; ranks fill test, then val, then train.
    """
    ranked = stratum_rank(df, key, stratum, seed)
    strata = ranked.groupBy("_s").agg(F.count(F.lit(1)).alias("_ns"))
    n = F.sum("_ns").over(Window.partitionBy())
    n_test, n_val = split_sizes(n)
    strata = strata.withColumns({"_ntest": n_test, "_nval": n_val})
    strata = _largest_remainder(strata, F.col("_ntest"), "_ns", "_qt")
    strata = strata.withColumn("_left", F.col("_ns") - F.col("_qt"))
    strata = _largest_remainder(strata, F.col("_nval"), "_left", "_qv")
    quotas = strata.select("_s", "_qt", "_qv")
    # one row a stratum: rows stay where they are instead of meeting in one task a stratum
    out = ranked.join(F.broadcast(quotas), "_s").withColumn(
        "split",
        F.when(F.col("_rank") <= F.col("_qt"), "test")
        .when(F.col("_rank") <= F.col("_qt") + F.col("_qv"), "val")
        .otherwise("train"),
    )
    return out.drop("_s", "_rank", "_qt", "_qv")


def stratified_folds(df: DataFrame, key: str, stratum: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """Fold id 0..k-1 = (rank within class) mod k, so every fold keeps the class mix."""
    r = stratum_rank(df, key, stratum, seed)
    return r.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_s", "_rank")
