"""Daily price-history features per symbol (intraday moves, gap, EWM, k-row change).

Input: a bars DataFrame ``(symbol, date, open, high, low, close, volume)``.
All features are column expressions or block-local windows (see
``quillmark.operators.panel``): the plan is one shuffle to number rows, one to
build position blocks, plus small block-level tables; no whole-symbol window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.numeric import row_mean, safe_div
from quillmark.operators import panel
from quillmark.session import stage

# EWM spans and percent-change periods used for the history features.
ROLLING = [3, 7, 15, 30]
DAILY_COLS = ["close", "open", "high", "low"]
BLOCK = 256


def intraday_columns(scale: float = 1.0) -> dict:
    """Dollar volume and intraday ranges (``scale=100`` gives percent units, E7)."""
    pm = row_mean(*DAILY_COLS)
    return {
        "dol_volume": pm * F.col("volume"),
        "intra_day_high_low_pct": safe_div(F.col("high") - F.col("low"), F.col("low")) * scale,
        "intra_day_open_close_pct": safe_div(F.col("close") - F.col("open"), F.col("open")) * scale,
    }


def _blocked(bars: DataFrame, halo: int) -> DataFrame:
    pos = panel.add_positions(bars, "symbol", "date")
    return panel.add_blocks(pos, BLOCK, halo)


def _lag_window():
    return Window.partitionBy("symbol", panel.BLK).orderBy(panel.POS)


def _ffill_carry(blk: DataFrame, col: str, halo: int) -> DataFrame:
    """Last non-null ``col`` strictly before the first row seen by each block's window.

    Block b's window starts at position b*BLOCK - halo, so the carry is the last
    value among blocks < b-1 plus the part of block b-1 before its halo.
    """
    own = blk.where(F.col(panel.OWN))
    pre = F.col(panel.IDX) < BLOCK - halo
    per = own.groupBy("symbol", panel.BLK).agg(
        F.max_by(F.col(col), F.when(F.col(col).isNotNull(), F.col(panel.POS))).alias("_last_all"),
        F.max_by(F.col(col), F.when(F.col(col).isNotNull() & pre, F.col(panel.POS))).alias("_last_pre"),
    )
    w = Window.partitionBy("symbol").orderBy(panel.BLK)
    carry = per.select(
        "symbol",
        (F.col(panel.BLK) + 1).alias(panel.BLK),
        F.coalesce(
            F.col("_last_pre"),
            F.last("_last_all", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        ).alias(f"_ff_carry_{col}"),
    )
    return carry


SERIES = {"px": ("_pm", ("ewm_{k}", "ewm_std_{k}")), "vol": ("volume", ("dol_vol_ewm_{k}", "dol_vol_ewm_std_{k}"))}


def price_features(bars: DataFrame, spans=ROLLING, scale: float = 1.0, series=("px", "vol"),
                   pct: bool = True) -> DataFrame:
    """The complete per-symbol chain E6 -> E1 -> E2/E3/E4 -> E5.

    ``scale=100`` is the percent-unit variant (E7) for the ratio columns;
    ``series`` names the EWM series to compute (price mean, volume).
    """
    spans = list(spans)
    halo = max(spans) if pct else 1
    base = bars.withColumn("_pm", row_mean(*DAILY_COLS))
    blk = stage(_blocked(base, halo), "price_blocks")
    w = _lag_window()
    own = F.col(panel.OWN)

    # E1 gap vs previous row's OPEN; E5 forward-filled close for k-row change.
    blk = blk.withColumn("_prev_open", F.lag("open", 1).over(w))
    if pct:
        carry = _ffill_carry(blk, "close", halo)
        blk = blk.join(carry, ["symbol", panel.BLK], "left").withColumn(
            "_ffc",
            F.coalesce(
                F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
                F.col("_ff_carry_close"),
            ),
        )
        blk = blk.select("*", *[F.lag("_ffc", k).over(w).alias(f"_ffc_lag{k}") for k in spans])

    if series:
        blk = panel.ewm(blk, "symbol", {x: SERIES[x][0] for x in series}, spans, BLOCK, {x: SERIES[x][1] for x in series})
    out = blk.where(own)
    cols = [F.col(c) for c in bars.columns]
    feats = [v.alias(k) for k, v in intraday_columns(scale).items()]
    feats.append((safe_div(F.col("close") - F.col("_prev_open"), F.col("_prev_open")) * scale).alias("gap_pct"))
    feats += [F.col(n.format(k=k)) for x in series for k in spans for n in SERIES[x][1]]
    if pct:
        feats += [((safe_div(F.col("_ffc"), F.col(f"_ffc_lag{k}")) - 1) * scale).alias(f"d{k}_avg_pct") for k in spans]
    return out.select(*cols, *feats)
