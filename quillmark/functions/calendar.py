"""Calendar expressions: market close cut-off and business-day targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions.numeric import col_

# Fixed value: market close (wall clock, session time zone).
CLOSE_HOUR, CLOSE_MINUTE = 16, 30


def parse_ts(c) -> Column:
    """ISO text -> TIMESTAMP (NULL when unparsable)."""
    c = col_(c)
    return F.try_to_timestamp(c)


def after_close(ts, hour: int = CLOSE_HOUR, minute: int = CLOSE_MINUTE) -> Column:
    """F2: strictly after hh:mm:00 on the timestamp's own day (microsecond exact)."""
    ts = col_(ts)
    cut = F.timestamp_add("MINUTE", F.lit(hour * 60 + minute), F.date_trunc("DAY", ts))
    return ts > cut


def business_day_target(ts, hour: int = CLOSE_HOUR, minute: int = CLOSE_MINUTE) -> Column:
    """trading day a message can affect (Mon-Fri calendar, no holidays).

    After the close: the next business day.  Otherwise the same day, where a
    Saturday or Sunday rolls forward to Monday.  ``weekday`` is Mon=0..Sun=6.
    """
    ts = col_(ts)
    d = F.to_date(ts)
    wd = F.weekday(d)
    late = F.when(wd == 4, 3).when(wd == 5, 2).otherwise(1)
    early = F.when(wd == 5, 2).when(wd == 6, 1).otherwise(0)
    return F.date_add(d, F.when(after_close(ts, hour, minute), late).otherwise(early))


def sql_after_close(ts: str, hour: int = CLOSE_HOUR, minute: int = CLOSE_MINUTE) -> str:
    return f"({ts} > date_trunc('day', {ts}) + INTERVAL {hour * 60 + minute} MINUTE)"


def sql_business_day_target(ts: str) -> str:
    wd = f"((dayofweek(CAST({ts} AS DATE)) + 6) % 7)"  # Mon=0
    return (f"CAST(CAST({ts} AS DATE) + CAST(CASE WHEN {sql_after_close(ts)} THEN "
            f"(CASE WHEN {wd} = 4 THEN 3 WHEN {wd} = 5 THEN 2 ELSE 1 END) ELSE "
            f"(CASE WHEN {wd} = 5 THEN 2 WHEN {wd} = 6 THEN 1 ELSE 0 END) END AS INTEGER) AS DATE)")
