"""Profiling aggregates (D1-D13): counts, null profile, describe, text lengths.

``exact_quantiles`` gives the linear-interpolated quantiles of ``describe``
without holding a column in one aggregation buffer: values are counted per
distinct value (map-side combine), cut into ~1,000 ranges by an approximate
sketch, ranges are prefix-summed (small), and only the ranges that contain a
target rank are scanned in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.session import stage

# Python ``str.split()`` whitespace: ASCII whitespace, \x1c-\x1f, \x85 and Unicode separators.
PY_WS = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+"
JAVA_WS = r"[\s\x1c-\x1f\x85\p{Z}]+"


def word_count(c) -> Column:
    """number of whitespace-separated words (Python ``len(s.split())``)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.size(F.filter(F.split(c, JAVA_WS), lambda x: x != ""))


def space_split_len(c) -> Column:
    """``len(s.split(" "))`` - pieces between single spaces, empties included."""
    c = F.col(c) if isinstance(c, str) else c
    return F.size(F.split(c, " ", -1))


def null_profile(df: DataFrame, cols=None) -> DataFrame:
    """NULL count of every column in one pass."""
    cols = cols or df.columns
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols])


def _range_of(x: Column, bounds: Column, every: Column, step: int) -> Column:
    """Number of sorted ``bounds`` below ``x``: first by ``every`` ``step``-th of them, then in the block that holds it."""
    coarse = F.size(F.filter(every, lambda b: b < x)) * step
    return coarse + F.size(F.filter(F.slice(bounds, coarse + 1, F.lit(step)), lambda b: b < x))


def exact_quantiles(df: DataFrame, col: str, probs: list[float], n_ranges: int = 1024,
                    accuracy: int = 10000) -> DataFrame:
    """One row with ``q{p}`` columns: linear-interpolation quantiles of non-null ``col``.

    Values are counted once (staged), cut into ranges by approximate quantiles, and only the ranges that
    hold a wanted position are sorted.
    """
    x = df.select(F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    vc = stage(x.groupBy("x").agg(F.count(F.lit(1)).alias("c")), "value_counts")
    cuts = [i / n_ranges for i in range(1, n_ranges)]
    # One row holding ~n_ranges cut points (fixed size, independent of the data volume).
    bounds = vc.agg(F.percentile_approx("x", cuts, accuracy).alias("_bd"), F.lit(1).alias("_k"))
    bounds = bounds.withColumn("_every", F.expr("filter(_bd, (b, i) -> i % 32 = 31)"))
    vc = (vc.withColumn("_k", F.lit(1)).join(F.broadcast(bounds), "_k")
          .withColumn("rg", _range_of(F.col("x"), F.col("_bd"), F.col("_every"), 32)).drop("_k", "_bd", "_every"))
    rg = vc.groupBy("rg").agg(F.sum("c").alias("rc"))
    # At most n_ranges rows: the un-partitioned running sum stays tiny.
    rg = rg.select("rg", (F.sum("rc").over(Window.orderBy("rg")) - F.col("rc")).alias("roff"), "rc",
                   F.sum("rc").over(Window.partitionBy()).alias("n"))
    holds = F.lit(False)
    for p in probs:
        for k in (F.floor(F.lit(p) * (F.col("n") - 1)), F.ceil(F.lit(p) * (F.col("n") - 1))):
            holds = holds | ((k >= F.col("roff")) & (k < F.col("roff") + F.col("rc")))
    within = Window.partitionBy("rg").orderBy("x")
    v = vc.join(F.broadcast(rg.where(holds)), "rg").withColumn("start", F.col("roff") + F.sum("c").over(within) - F.col("c"))
    v = v.withColumn("end", F.col("start") + F.col("c"))
    aggs = []
    tag = {p: str(int(round(p * 100))) for p in probs}
    for p in probs:
        pos = F.lit(p) * (F.col("n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        aggs += [
            F.max(F.when((lo >= F.col("start")) & (lo < F.col("end")), F.col("x"))).alias(f"_lo{tag[p]}"),
            F.max(F.when((hi >= F.col("start")) & (hi < F.col("end")), F.col("x"))).alias(f"_hi{tag[p]}"),
            F.max(pos - lo).alias(f"_fr{tag[p]}"),
        ]
    r = v.agg(*aggs)
    return r.select(*[(F.col(f"_lo{t}") + (F.col(f"_hi{t}") - F.col(f"_lo{t}")) * F.col(f"_fr{t}"))
                    .alias(f"q{t}") for t in tag.values()])


def describe(df: DataFrame, col: str) -> DataFrame:
    """Count, mean, sample std, min, quartiles, max of one numeric column."""
    df = stage(df.select(col), "described")  # the aggregate and the value counts read one column, once
    x = F.col(col)
    base = df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                  F.min(x).alias("min"), F.max(x).alias("max"))
    q = exact_quantiles(df, col, [0.25, 0.5, 0.75])
    # Both sides are single rows; join on a constant key (no cross join).
    return base.withColumn("_k", F.lit(1)).join(q.withColumn("_k", F.lit(1)), "_k").drop("_k")


def value_counts(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """D3/G1: frequency list without NULLs, descending, ties by value."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(name))
            .orderBy(F.desc(name), col))
