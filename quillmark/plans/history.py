"""Registered queries over price history (E1-E8) with their DuckDB oracles."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quillmark.functions.numeric import round_sig, sql_round_sig
from quillmark.operators.prices import ROLLING, price_features
from quillmark.sources import tables
from quillmark.sources.oracle import with_views

# EWM values come from different summation orders in the two engines; compare them
# at this many significant digits.  Everything else is computed by identical IEEE
# operations and compared exactly.
EWM_DIGITS = 8

INTRADAY = ["dol_volume", "intra_day_high_low_pct", "intra_day_open_close_pct", "gap_pct"]


def ewm_names(kind: str) -> list[str]:
    out = []
    for k in ROLLING:
        out += [f"ewm_{k}", f"ewm_std_{k}"] if kind == "px" else [f"dol_vol_ewm_{k}", f"dol_vol_ewm_std_{k}"]
    return out


def _round_ewm(df, cols):
    return df.select(*[round_sig(F.col(c), EWM_DIGITS).alias(c) if c in cols else F.col(c) for c in df.columns])


def q_bars_intraday(spark, sf):
    f = price_features(tables.bars(spark, sf), series=(), pct=False)
    return f.select("symbol", "date", *INTRADAY)


def q_bars_intraday_pct(spark, sf):
    f = price_features(tables.bars(spark, sf), scale=100.0, series=(), pct=False)
    return f.select("symbol", "date", *INTRADAY)


def q_ewm_price(spark, sf):
    f = price_features(tables.bars(spark, sf), series=("px",), pct=False)
    return _round_ewm(f.select("symbol", "date", *ewm_names("px")), ewm_names("px"))


def q_ewm_volume(spark, sf):
    f = price_features(tables.bars(spark, sf), series=("vol",), pct=False)
    return _round_ewm(f.select("symbol", "date", *ewm_names("vol")), ewm_names("vol"))


def q_pct_change(spark, sf):
    f = price_features(tables.bars(spark, sf), series=())
    return f.select("symbol", "date", *[f"d{k}_avg_pct" for k in ROLLING])


def q_price_features(spark, sf):
    f = price_features(tables.bars(spark, sf))
    return _round_ewm(f, ewm_names("px") + ewm_names("vol"))


# ---------------------------------------------------------------- DuckDB oracles

_PM = ("(coalesce(close, 0.0) + coalesce(open, 0.0) + coalesce(high, 0.0) + coalesce(low, 0.0)) / "
       "nullif((close IS NOT NULL)::INT + (open IS NOT NULL)::INT + (high IS NOT NULL)::INT + (low IS NOT NULL)::INT, 0)")


def _hist_base(scale: float = 1.0, spans=ROLLING) -> dict[str, str]:
    s = repr(float(scale))
    return {
        "hb": f"""
SELECT *, {_PM} AS pm,
       row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS p,
       lag(open) OVER (PARTITION BY symbol ORDER BY date) AS prev_open,
       last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ffc
FROM bars""",
        "hf": f"""
SELECT *, {_PM} * volume AS dol_volume,
       CASE WHEN low = 0 THEN NULL ELSE (high - low) / low END * {s} AS intra_day_high_low_pct,
       CASE WHEN open = 0 THEN NULL ELSE (close - open) / open END * {s} AS intra_day_open_close_pct,
       CASE WHEN prev_open = 0 THEN NULL ELSE (close - prev_open) / prev_open END * {s} AS gap_pct,
       {", ".join(f"CASE WHEN lag(ffc, {k}) OVER w = 0 THEN NULL ELSE ffc / lag(ffc, {k}) OVER w - 1 END * {s} AS d{k}_avg_pct" for k in spans)}
FROM hb WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
    }


def ewm_sql_lookback(spans) -> int:
    """Rows after which every weight r**d is exactly 0.0 in doubles (below 2**-1075)."""
    r = max(1.0 - 2.0 / (k + 1.0) for k in spans)
    return math.ceil(1075 * math.log(2) / -math.log(r)) + 1


def _ewm_ctes(spans=ROLLING, series=None) -> dict[str, str]:
    """Exact EWM by a self-join over earlier rows of the symbol (``eo`` holds raw values)."""
    series = series or {"px": "pm", "vol": "volume"}
    look = ewm_sql_lookback(spans)
    m_cols, v_cols, out_cols = [], [], []
    for s, c in series.items():
        m_cols.append(f"count(x.{c}) AS n_{s}")
        for k in spans:
            r = 1.0 - 2.0 / (k + 1.0)
            w = f"pow({r!r}, a.p - x.p)"
            m_cols.append(f"sum(CASE WHEN x.{c} IS NOT NULL THEN {w} END) AS s0_{s}_{k}")
            m_cols.append(f"sum({w} * x.{c}) AS s1_{s}_{k}")
            mean = f"(a.s1_{s}_{k} / a.s0_{s}_{k})"
            v_cols.append(f"sum({w} * (x.{c} - {mean}) * (x.{c} - {mean})) AS q_{s}_{k}")
            v_cols.append(f"sum(CASE WHEN x.{c} IS NOT NULL THEN pow({r * r!r}, a.p - x.p) END) AS w2_{s}_{k}")
            mn, sd = (f"ewm_{k}", f"ewm_std_{k}") if s == "px" else (f"dol_vol_ewm_{k}", f"dol_vol_ewm_std_{k}")
            var = (f"CASE WHEN n_{s} >= 2 AND s0_{s}_{k} * s0_{s}_{k} - w2_{s}_{k} > 0 THEN "
                   f"greatest(q_{s}_{k} / s0_{s}_{k}, 0.0) * (s0_{s}_{k} * s0_{s}_{k}) / (s0_{s}_{k} * s0_{s}_{k} - w2_{s}_{k}) END")
            out_cols.append(f"CASE WHEN n_{s} > 0 THEN s1_{s}_{k} / s0_{s}_{k} END AS {mn}")
            out_cols.append(f"sqrt({var}) AS {sd}")
    on = f"a.symbol = x.symbol AND x.p <= a.p AND x.p > a.p - {look}"
    return {
        "em": f"SELECT a.symbol, a.p, {', '.join(m_cols)} FROM hb a JOIN hb x ON {on} GROUP BY a.symbol, a.p",
        "ev": f"SELECT a.*, {', '.join(v_cols)} FROM em a JOIN hb x ON {on} GROUP BY ALL",
        "eo": f"SELECT hb.symbol, hb.date, {', '.join(out_cols)} FROM ev JOIN hb USING (symbol, p)",
    }


def sql_ewm_rounded(names) -> str:
    return ", ".join(f"{sql_round_sig(n, EWM_DIGITS)} AS {n}" for n in names)


def _sql_intraday(scale):
    return with_views(f"SELECT symbol, date, {', '.join(INTRADAY)} FROM hf", "bars", extra=_hist_base(scale))


def _sql_ewm(kind):
    return with_views(f"SELECT symbol, date, {sql_ewm_rounded(ewm_names(kind))} FROM eo", "bars",
                      extra={**_hist_base(), **_ewm_ctes()})


QUERIES = {
    "q_bars_intraday": q_bars_intraday,
    "q_bars_intraday_pct": q_bars_intraday_pct,
    "q_ewm_price": q_ewm_price,
    "q_ewm_volume": q_ewm_volume,
    "q_pct_change": q_pct_change,
    "q_price_features": q_price_features,
}

ORACLE = {
    "q_bars_intraday": _sql_intraday(1.0),
    "q_bars_intraday_pct": _sql_intraday(100.0),
    "q_ewm_price": _sql_ewm("px"),
    "q_ewm_volume": _sql_ewm("vol"),
    "q_pct_change": with_views(
        f"SELECT symbol, date, {', '.join(f'd{k}_avg_pct' for k in ROLLING)} FROM hf", "bars", extra=_hist_base()),
    "q_price_features": with_views(
        "SELECT hf.symbol, hf.date, open, high, low, close, volume, "
        + ", ".join(INTRADAY + [f"d{k}_avg_pct" for k in ROLLING]) + ", "
        + sql_ewm_rounded(ewm_names("px") + ewm_names("vol"))
        + " FROM hf JOIN eo USING (symbol, date)",
        "bars", extra={**_hist_base(), **_ewm_ctes()}),
}
