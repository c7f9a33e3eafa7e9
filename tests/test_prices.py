"""EWM features against pandas: nulls anywhere, long gaps, short histories."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from quillmark.operators import panel
from quillmark.operators.prices import price_features


def frame(spark, values, symbol="S0"):
    day = dt.date(2000, 1, 1)
    rows = [(symbol, day + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, date date, x double")


def series(kind):
    r = np.random.default_rng(5)
    if kind == "long gap":
        return [*r.uniform(10, 20, 300), *[None] * 1400, *r.uniform(10, 20, 100)]
    if kind == "sparse":
        return [v if r.random() < 0.5 else None for v in r.uniform(10, 20, 900)]
    if kind == "none":
        return [None] * 40
    return [7.0] if kind == "one" else [None, None, *r.uniform(1, 1000, 700)]


@pytest.mark.parametrize("kind", ["long gap", "sparse", "none", "one", "late start"])
@pytest.mark.parametrize("span", [1, 3, 30])
def test_ewm_equals_pandas(spark, kind, span):
    values = series(kind)
    df = panel.add_blocks(panel.add_positions(frame(spark, values), "symbol", "date"), 64, 1)
    got = panel.ewm(df, "symbol", {"x": "x"}, [span], 64).where("_own").orderBy("date").toPandas()
    ref = pd.Series(values, dtype=float).ewm(span=span)
    np.testing.assert_allclose(got[f"x_ewm_{span}"].astype(float), ref.mean(), rtol=1e-9)
    std, want = got[f"x_ewm_std_{span}"].astype(float), ref.std()
    # deep inside a gap the squared weights of pandas underflow to NaN; a null row repeats the last result here
    if kind == "long gap":
        last = pd.Series(range(len(values))).where(pd.Series(values).notna()).ffill().astype(int)
        want = want[last].reset_index(drop=True)
    np.testing.assert_allclose(std, want, rtol=1e-6, atol=1e-9)


def test_constant_series(spark):
    df = panel.add_blocks(panel.add_positions(frame(spark, [4.5] * 600), "symbol", "date"), 64, 1)
    got = panel.ewm(df, "symbol", {"x": "x"}, [7], 64).where("_own").toPandas()
    assert (got["x_ewm_7"] == 4.5).all() and (got["x_ewm_std_7"].dropna() == 0).all()


def test_features_with_null_cells(spark):
    r = np.random.default_rng(2)
    n, day = 400, dt.date(2001, 1, 1)
    cells = {c: [float(v) if r.random() > 0.15 else None for v in r.uniform(5, 9, n)]
             for c in ("open", "high", "low", "close", "volume")}
    rows = [("A", day + dt.timedelta(days=i), *[cells[c][i] for c in ("open", "high", "low", "close", "volume")])
            for i in range(n)]
    bars = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")
    got = price_features(bars).orderBy("date").toPandas()
    p = pd.DataFrame(cells, dtype=float)
    mean = p[["close", "open", "high", "low"]].mean(axis=1)
    np.testing.assert_allclose(got["dol_volume"].astype(float), mean * p["volume"])
    np.testing.assert_allclose(got["gap_pct"].astype(float), (p["close"] - p["open"].shift()) / p["open"].shift())
    for k in (3, 7, 15, 30):
        np.testing.assert_allclose(got[f"ewm_{k}"].astype(float), mean.ewm(span=k).mean(), rtol=1e-9)
        np.testing.assert_allclose(got[f"dol_vol_ewm_std_{k}"].astype(float), p["volume"].ewm(span=k).std(), rtol=1e-6)
        full = p["close"].ffill()
        np.testing.assert_allclose(got[f"d{k}_avg_pct"].astype(float), full / full.shift(k) - 1)
