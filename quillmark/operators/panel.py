"""Panel time-series building blocks: row positions, halo blocks, decayed sums.

A panel is a DataFrame keyed by an entity column (``symbol``) and ordered by
a time column (``date``).  Nothing here opens a window over a whole entity:
a single symbol may hold a large share of all rows, so work is cut into

* **calendar buckets** (``symbol, month``) to number rows: per-bucket counts
  are tiny, their running sums give each bucket's first position, and rows are
  numbered inside their bucket;
* **position blocks** of ``block`` rows (``symbol, b``) for scans.  Lags up to
  ``halo`` rows read copies of the previous block's tail; infinite-memory
  scans (EWM) combine a running sum inside the block with a carry built from
  the totals of earlier blocks (a small table).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POS = "_p"      # 0-based row position within the entity
BLK = "_b"      # position block id
IDX = "_i"      # position inside the block
OWN = "_own"    # False on halo copies of the previous block's tail


def add_positions(df: DataFrame, key: str, order: str, bucket: Column | None = None) -> DataFrame:
    """Add ``_p``: 0-based row number of each row within its ``key`` in ``order``.

    ``bucket`` must be monotone in ``order`` (default: month of ``order``).
    Rows with equal ``order`` inside an entity are numbered arbitrarily.
    """
    bucket = bucket if bucket is not None else F.date_trunc("month", F.col(order))
    b = df.withColumn("_bk", bucket)
    counts = b.groupBy(key, "_bk").agg(F.count(F.lit(1)).alias("_n"))
    # One row per (entity, bucket): a window over an entity here is bounded by its calendar span.
    offsets = counts.select(
        key,
        "_bk",
        F.coalesce(
            F.sum("_n").over(Window.partitionBy(key).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_off"),
    )
    w = Window.partitionBy(key, "_bk").orderBy(order)
    return (
        b.join(offsets, [key, "_bk"])
        .withColumn(POS, F.col("_off") + F.row_number().over(w) - 1)
        .drop("_bk", "_off")
    )


def add_blocks(df: DataFrame, block: int, halo: int) -> DataFrame:
    """Assign ``_b``/``_i`` and append halo copies of each block's last ``halo`` rows
    to the next block (``_own`` = False)."""
    assert 0 <= halo <= block
    p = F.col(POS)
    b = df.withColumn(BLK, F.floor(p / block)).withColumn(IDX, p % block)
    tags = F.array(F.lit(True))
    if halo:
        tags = F.when(F.col(IDX) >= block - halo, F.array(F.lit(True), F.lit(False))).otherwise(tags)
    return (
        b.withColumn(OWN, F.explode(tags))
        .withColumn(BLK, F.when(F.col(OWN), F.col(BLK)).otherwise(F.col(BLK) + 1))
    )


def ewm_lookback(span: float, block: int) -> int:
    """Blocks with values whose decayed weight still counts beside a weight of 1 (1e-30 does not in doubles)."""
    r = 1.0 - 2.0 / (span + 1.0)
    if r <= 0:
        return 1
    return 1 + math.ceil(30 * math.log(10) / (-block * math.log(r)))


def _d(x: float) -> str:
    """Double literal for generated SQL."""
    return f"CAST({x!r} AS DOUBLE)"


def ewm(
    df: DataFrame,
    key: str,
    series: dict[str, str],
    spans: list[int],
    block: int = 256,
    names: dict[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Exponentially weighted mean and bias-corrected std with adjusted weights.

    Semantics (span ``k``, ``r = 1 - 2/(k+1)``): at position i the weight of a
    non-null value at position j <= i is ``r**(i-j)``; positions of null rows
    count.  mean = sum(w x)/sum(w); var = (sum(w (x-mean)^2)/sum(w)) *
    S0^2/(S0^2 - sum(w^2)); std is NULL until two non-null values.  A null row
    repeats the result of the last row with a value: all weights decay alike, so
    sums are taken as of that row and never fade away.  A std right after a gap of g
    rows is exact to about 1e-16 / r**g, as the older weights are that small beside 1.

    ``df`` must carry ``_p``/``_b``/``_i``/``_own`` (see :func:`add_blocks`).
    ``series`` maps an output stem to an input column; ``names`` maps the stem
    to the (mean, std) name patterns, formatted with the span.
    Returns ``df`` (halo rows included) with the new columns on own rows.

    Plan: block totals by one grouped aggregate, a carry table from the totals
    of the last blocks with values (equi-join on their running number), and one
    window pass over (key, block) for the sums inside the block.
    Expressions are generated as SQL text: one JVM call per column.
    """
    names = names or {s: (f"{s}_ewm_{{k}}", f"{s}_ewm_std_{{k}}") for s in series}
    rs = {k: max(1.0 - 2.0 / (k + 1.0), 1e-300) for k in spans}  # span 1: only the row itself counts
    i = f"CAST({IDX} AS DOUBLE)"
    # Centre per entity: guards the sums of squares against cancellation.
    centre = df.where(F.col(OWN)).groupBy(key).agg(*[F.expr(f"avg({c}) AS _c_{s}") for s, c in series.items()])
    rows = df.join(centre, key)

    def ok(s: str) -> str:
        return f"({OWN} AND {series[s]} IS NOT NULL)"

    def sums(s: str, over: str, last: str, prefix: str) -> list[str]:
        """Decayed sums of weights, values, squares and squared weights, as of position ``last`` of the block."""
        z, out = f"({series[s]} - _c_{s})", []
        for k in spans:
            if rs[k] <= 1e-300:
                inv = inv2 = back = back2 = None
                x = f"max_by(CASE WHEN {ok(s)} THEN {z} END, CASE WHEN {ok(s)} THEN {POS} END) {over}"
                out += [f"CASE WHEN {last} IS NOT NULL THEN 1.0D END AS {prefix}0_{s}_{k}", f"{x} AS {prefix}1_{s}_{k}",
                        f"power({x}, 2) AS {prefix}2_{s}_{k}", f"CASE WHEN {last} IS NOT NULL THEN 1.0D END AS {prefix}w_{s}_{k}"]
                continue
            inv, inv2 = (f"power({_d(1.0 / x)}, {i})" for x in (rs[k], rs[k] ** 2))   # at most r**(1-block)
            back, back2 = (f"power({_d(x)}, {last})" for x in (rs[k], rs[k] ** 2))
            out += [
                f"sum(CASE WHEN {ok(s)} THEN {inv} END) {over} * {back} AS {prefix}0_{s}_{k}",
                f"sum(CASE WHEN {ok(s)} THEN {inv} * {z} END) {over} * {back} AS {prefix}1_{s}_{k}",
                f"sum(CASE WHEN {ok(s)} THEN {inv} * {z} * {z} END) {over} * {back} AS {prefix}2_{s}_{k}",
                f"sum(CASE WHEN {ok(s)} THEN {inv2} END) {over} * {back2} AS {prefix}w_{s}_{k}",
            ]
        return out

    run = f"OVER (PARTITION BY {key}, {BLK} ORDER BY {POS} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    out = rows
    for s in series:
        last = f"max(CASE WHEN {ok(s)} THEN {i} END)"
        totals = rows.groupBy(key, BLK).agg(
            F.expr(f"count(CASE WHEN {ok(s)} THEN 1 END) AS _n"),
            F.expr(f"max(CASE WHEN {ok(s)} THEN {POS} END) AS _q"), *[F.expr(e) for e in sums(s, "", last, "_t")])
        carry = _carry(totals, key, s, spans, rs, block)
        out = out.join(carry, [key, BLK], "left")

    local, drop = [], []
    for s in series:
        local += [f"count(CASE WHEN {ok(s)} THEN 1 END) {run} AS _n_{s}",
                  f"max(CASE WHEN {ok(s)} THEN {POS} END) {run} AS _at_{s}",
                  *sums(s, run, f"max(CASE WHEN {ok(s)} THEN {i} END) {run}", "_l")]
    out = out.selectExpr("*", *local)
    final = []
    for s in series:
        n_obs = f"(_n_{s} + coalesce(_np_{s}, 0))"
        for k in spans:
            # without a value in this block the carry stands as it is; else it decays up to the last value
            gap = f"coalesce(_at_{s} - _q_{s}, 0)"

            def tot(a: str, r: float) -> str:
                return f"(coalesce(_l{a}_{s}_{k}, 0.0D) + coalesce(_C{a}_{s}_{k} * power({_d(r)}, {gap}), 0.0D))"

            s0, s1, s2, sw = tot("0", rs[k]), tot("1", rs[k]), tot("2", rs[k]), tot("w", rs[k] ** 2)
            m1 = f"try_divide({s1}, {s0})"
            mean = f"CASE WHEN {n_obs} > 0 THEN _c_{s} + {m1} END"
            var_b = f"greatest(try_divide({s2}, {s0}) - {m1} * {m1}, 0.0D)"
            den = f"({s0} * {s0} - {sw})"
            var = f"CASE WHEN {n_obs} >= 2 AND {den} > 0 THEN {var_b} * try_divide({s0} * {s0}, {den}) END"
            mname, sname = names[s]
            final += [f"{mean} AS {mname.format(k=k)}", f"sqrt({var}) AS {sname.format(k=k)}"]
    return out.selectExpr(*df.columns, *final)


def _carry(totals: DataFrame, key: str, s: str, spans: list[int], rs: dict[int, float], block: int) -> DataFrame:
    """Sums over the blocks before each block, as of the last position with a value (``_q``); one row per block.

    Blocks with values are numbered; a block reads the last ``D`` of them, so long stretches without
    values neither lengthen the join nor fade the sums.
    """
    w = f"PARTITION BY {key} ORDER BY {BLK} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    t = totals.selectExpr(
        "*", f"coalesce(sum(_n) OVER ({w}), 0) AS _np", f"coalesce(count(_q) OVER ({w}), 0) AS _nb",
        f"max(_q) OVER ({w}) AS _before")
    depth = max(ewm_lookback(k, block) for k in spans)
    src = t.where("_q IS NOT NULL").selectExpr(
        key, f"explode(sequence(1, {depth})) AS _d", "_nb", "_q AS _p_src",
        *[f"_t{a}_{s}_{k}" for k in spans for a in "012w"]).withColumn("_nb", F.col("_nb") + F.col("_d")).drop("_d")
    pair = t.selectExpr(key, BLK, "_nb", "_np", "_before").join(src, [key, "_nb"])
    agg = []
    for k in spans:
        for a in "012w":
            r = rs[k] ** 2 if a == "w" else rs[k]
            agg.append(F.expr(f"sum(power({_d(r)}, _before - _p_src) * _t{a}_{s}_{k}) AS _C{a}_{s}_{k}"))
    return pair.groupBy(key, BLK).agg(F.max("_np").alias(f"_np_{s}"), F.max("_before").alias(f"_q_{s}"), *agg)
