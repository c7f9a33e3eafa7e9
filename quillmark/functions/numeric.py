"""Numeric column helpers (JVM-side expressions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num, den) -> Column:
    """Division that yields NULL on a zero or NULL divisor (ANSI-safe)."""
    return F.try_divide(col_(num), col_(den))


def row_mean(*cols) -> Column:
    """Mean over the non-null values of several columns, NULL when all are NULL.

    Summation runs in argument order so other engines can reproduce the
    value bit for bit.
    """
    cs = [col_(c) for c in cols]
    total = F.coalesce(cs[0], F.lit(0.0))
    for c in cs[1:]:
        total = total + F.coalesce(c, F.lit(0.0))
    n = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cs[1:]), F.when(cs[0].isNotNull(), 1).otherwise(0))
    return F.when(n > 0, total / n)


def round_sig(c, digits: int) -> Column:
    """Round to ``digits`` significant digits with exact power-of-ten scaling.

    Scaling multiplies or divides by an exactly representable ``10**n`` so
    the same value rounds identically in any IEEE engine.
    """
    if isinstance(c, str):
        return F.expr(sql_round_sig(f"`{c}`", digits).replace("isnan(", "isnan("))
    x = col_(c)
    e = F.floor(F.log10(F.abs(x)))
    up = F.pow(F.lit(10.0), e)
    down = F.pow(F.lit(10.0), -e)
    d = digits - 1
    return (
        F.when(x.isNull() | (x == 0) | F.isnan(x), x)
        .when(e >= 0, F.round(x / up, d) * up)
        .otherwise(F.round(x * down, d) / down)
    )


def sql_round_sig(expr: str, digits: int) -> str:
    """DuckDB text of :func:`round_sig`."""
    e = f"floor(log10(abs({expr})))"
    d = digits - 1
    return (
        f"CASE WHEN ({expr}) IS NULL OR ({expr}) = 0 OR isnan({expr}) THEN ({expr}) "
        f"WHEN {e} >= 0 THEN round(({expr}) / pow(10, {e}), {d}) * pow(10, {e}) "
        f"ELSE round(({expr}) * pow(10, -{e}), {d}) / pow(10, -{e}) END"
    )
