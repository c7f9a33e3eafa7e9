"""Mixing sources to target weights by entropy balancing.

The rates nearest to "each document once" in entropy that meet every source's
token target and stay below ``most`` copies are exponentially tilted,

    rate = most / (1 + (most - 1) * exp(-lambda[source] * size / mean size)),

and one multiplier per source solves the convex dual.  Newton steps,
bracketed by bisection, run on a histogram of (source, size), so a step moves
one row per source whatever the corpus holds.  The rates are then rounded into
copies: the running sum of rates over growing sizes is rounded, each
(source, size) group spreads its whole number of copies evenly over its
documents, the remainder goes to the smallest row hashes, and single copies
are added or taken away while that brings a source nearer to its target.

Driver state is one row per source and one per corrected (source, size); a
hot source or size is ranked in sub-buckets of about ``bucket_rows`` rows.

Defined cases: a null text has size 0; a null source is a source of its own,
last in order; a source without words has target 0 and takes nothing; repeated
rows are separate documents (ties of their hash go by place in the input); a null ``doc_id`` is
kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import WORD_PATTERN
from quillmark.session import stage


def target_sizes(sizes: dict[str | None, int], weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5,
                 most: float = 2.0) -> dict[str | None, float]:
    """Target words per source: ``share`` of all words by weight, none above ``most`` times its own size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target: dict[str | None, float] = {}
    left = share * sum(sizes.values())
    free = list(order)
    while free:
        unit = max(left, 0) / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * unit > most * sizes[s]]
        for s in full or free:
            target[s] = most * sizes[s] if full else weight[s] * unit
        left -= sum(target[s] for s in full)
        free = [s for s in free if s not in target]
    return target


def _sized(docs: DataFrame) -> DataFrame:
    """Columns of the rounding: source key, size and a hash that orders rows (ties by place in the input)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = F.col("source").cast("string")
    return docs.select(
        F.struct("*").alias("_row"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("_source"),
        F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("_size"),
        F.struct(F.xxhash64(F.lit(11), F.col("doc_id"), text).alias("h"),
                 F.monotonically_increasing_id().alias("row")).alias("_order"))


def _rate(tilt: Column, most: float) -> Column:
    return F.when(tilt > 700, most).when(tilt < -700, 0.0).otherwise(most / (1 + (most - 1) * F.exp(-tilt)))


def _tilts(groups: DataFrame, sizes: dict[str, int], docs: dict[str, int], target: dict[str, float], most: float,
           steps: int = 80, near: float = 1e-7) -> dict[str, float]:
    """Multiplier of every source by Newton's method on the dual, one aggregation over the histogram a step."""
    at, low, high = {}, {}, {}
    for s, t in target.items():
        if t >= most * sizes[s] * (1 - 1e-12):
            at[s] = math.inf
        elif t <= 0:
            at[s] = -math.inf
        else:
            at[s], low[s], high[s] = 0.0, -math.inf, math.inf
    moving = set(low)
    spark = groups.sparkSession
    for _ in range(steps):
        if not moving:
            break
        now = spark.createDataFrame([(s, at[s], sizes[s] / docs[s]) for s in moving],
                                    "_source string, tilt double, mean double")
        x = F.col("_size") / F.col("mean")
        rate = _rate(F.col("tilt") * x, most)
        words = F.col("n") * F.col("_size")
        sums = (groups.join(now, "_source").groupBy("_source")
                .agg(F.sum(words * rate).alias("got"), F.sum(words * x * rate * (1 - rate / most)).alias("slope")))
        for r in sums.collect():
            s, miss = r["_source"], target[r["_source"]] - r["got"]
            if abs(miss) <= near * target[s]:
                moving.discard(s)
                continue
            if miss > 0:
                low[s] = at[s]
            else:
                high[s] = at[s]
            step = at[s] + miss / r["slope"] if r["slope"] > 0 else math.nan
            if not low[s] < step < high[s]:  # outside what is known: halve the bracket, or double away from 0
                step = ((low[s] + high[s]) / 2 if math.isfinite(low[s] + high[s])
                        else 2 * at[s] + (1 if miss > 0 else -1))
            at[s] = step
    return at


def _copies(groups: DataFrame, target: dict[str, float], tilts: dict[str, float], sizes: dict[str, int],
            docs: dict[str, int], most: int, near: float = 1e-3, rounds: int = 40) -> DataFrame:
    """(source, size, n, copies): whole copies of each group, corrected towards the target."""
    spark = groups.sparkSession
    by = spark.createDataFrame([(s, float(max(-1e300, min(1e300, tilts[s]))), sizes[s] / max(docs[s], 1)) for s in target],
                               "_source string, tilt double, mean double")
    rate = F.when(F.col("mean") > 0, _rate(F.col("tilt") * F.col("_size") / F.col("mean"), most)).otherwise(0.0)
    run = F.sum(F.col("n") * F.col("rate")).over(Window.partitionBy("_source").orderBy("_size"))
    whole = F.floor(F.col("run") + 0.5)
    before = F.lag(whole, 1, 0).over(Window.partitionBy("_source").orderBy("_size"))
    copies = F.least(F.greatest(whole - before, F.lit(0)), F.col("n") * most)
    rounded = stage(groups.join(by, "_source").withColumn("rate", rate).withColumn("run", run)
                    .select("_source", "_size", "n", copies.cast("long").alias("copies")), "mix_copies")
    taken = {r["_source"]: r["taken"] for r in rounded.groupBy("_source")
             .agg(F.sum(F.col("copies") * F.col("_size")).alias("taken")).collect()}
    miss = {s: target[s] - taken.get(s, 0) for s in target}
    change: dict[tuple[str, int], int] = {}
    kind = "_source string, _size long, change long"

    def corrected() -> DataFrame:
        moved = spark.createDataFrame([(s, z, c) for (s, z), c in change.items()], kind)
        return rounded.join(moved, ["_source", "_size"], "left").select(
            "_source", "_size", "n", (F.col("copies") + F.coalesce("change", F.lit(0))).alias("copies"))

    for _ in range(rounds):
        off = [(s, m) for s, m in miss.items() if abs(m) > near * target[s]]
        if not off:
            break
        gap = F.abs(F.abs("miss") - F.col("_size"))
        room = F.when(F.col("miss") > 0, F.col("copies") < F.col("n") * most).otherwise(F.col("copies") > 0)
        best = (corrected().join(spark.createDataFrame(off, "_source string, miss double"), "_source")
                .where(room & (gap < F.abs("miss"))).groupBy("_source").agg(F.min(F.struct(gap, "_size")).alias("b"))
                .select("_source", "b._size").collect())
        if not best:
            break
        for r in best:
            s, z = r["_source"], r["_size"]
            sign = 1 if miss[s] > 0 else -1
            change[s, z] = change.get((s, z), 0) + sign
            miss[s] -= sign * z
    return corrected()


def _last_extra(rows: DataFrame, copies: DataFrame, bucket_rows: int) -> DataFrame:
    """(source, size, base, last): documents get ``base`` copies, those up to row order ``last`` one more."""
    share = copies.select("_source", "_size", "n", F.floor(F.col("copies") / F.col("n")).alias("base"),
                          (F.col("copies") % F.col("n")).alias("extra"))
    share = share.withColumn("buckets", F.ceil(F.col("n") / bucket_rows))
    split = share.where("extra > 0").drop("base")
    place = F.floor((F.col("_order.h") / 2.0**64 + 0.5) * F.col("buckets"))
    keyed = (rows.select("_source", "_size", "_order").join(split, ["_source", "_size"])
             .select("_source", "_size", "_order", "extra", F.least(place, F.col("buckets") - 1).alias("bucket")))
    group = ["_source", "_size"]
    counts = keyed.groupBy(*group, "extra", "bucket").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*group).orderBy("bucket"))
    hit = (counts.withColumn("upto", upto).where("upto >= extra and upto - c < extra")
           .select(*group, "bucket", (F.col("extra") - F.col("upto") + F.col("c")).alias("nth")))
    rank = F.row_number().over(Window.partitionBy(*group, "bucket").orderBy("_order"))
    last = (keyed.drop("extra").join(hit, [*group, "bucket"]).withColumn("rank", rank).where("rank = nth")
            .select(*group, F.col("_order").alias("last")))
    return share.select(*group, "base").join(last, group, "left")


def plan(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2,
         bucket_rows: int = 256) -> tuple[DataFrame, DataFrame, dict[str | None, int], dict[str | None, float]]:
    """(sized rows, copies by group, words by source, targets by source) of a mix."""
    rows = _sized(docs)
    slim = stage(rows.select(F.col("_row.doc_id").alias("doc_id"), "_source", "_size", "_order"), "mix_rows")
    groups = stage(slim.groupBy("_source", "_size").agg(F.count("*").alias("n")), "mix_groups")
    total = groups.groupBy("_source").agg(F.sum(F.col("n") * F.col("_size")).alias("size"), F.sum("n").alias("n"))
    by = {r["_source"]: (r["size"], r["n"]) for r in total.collect()}
    name = {k: k[1:] if k else None for k in by}
    aims = target_sizes({name[k]: v[0] for k, v in by.items()}, weights, share, most)
    target = {k: aims[name[k]] for k in by}
    sizes, n = {k: v[0] for k, v in by.items()}, {k: v[1] for k, v in by.items()}
    tilts = _tilts(groups, sizes, n, target, most)
    given = stage(_last_extra(slim, _copies(groups, target, tilts, sizes, n, most), bucket_rows), "mix_given")
    return slim, given, sizes, target


def _with_copies(rows: DataFrame, given: DataFrame) -> DataFrame:
    """Spark broadcasts the staged groups only where their size is below the session's limit."""
    more = F.coalesce(F.col("_order") <= F.col("last"), F.lit(False)).cast("long")
    return (rows.join(given, ["_source", "_size"])
            .withColumn("_copies", F.col("base") + more).drop("base", "last"))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    slim, given, sizes, target = plan(docs, **options)
    by = docs.sparkSession.createDataFrame([(s, sizes[s], float(target[s])) for s in sizes],
                                           "_source string, source_size long, target double")
    got = _with_copies(slim, given).join(by, "_source")
    source = F.when(F.col("_source") != "", F.expr("substring(_source, 2)"))
    return got.select("doc_id", source.alias("source"), F.col("_size").alias("size"), "source_size", "target",
                      F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, columns as given."""
    _, given, _, _ = plan(docs, **options)
    got = _with_copies(_sized(docs), given)
    return got.where("_copies > 0").withColumn("_copy", F.explode(F.expr("sequence(1L, _copies)"))).select("_row.*")
