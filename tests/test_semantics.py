"""Checked semantics from the survey on literal inputs."""

import datetime as dt
import math

from pyspark.sql import functions as F

from quillmark.functions.calendar import after_close, business_day_target
from quillmark.operators import dataset as ds
from quillmark.operators import evaluate as ev
from quillmark.operators import profile as pr
from quillmark.operators import text as tx


def test_business_day_target_rolls_weekends(spark):
    rows = [
        (dt.datetime(2024, 1, 5, 16, 30, 0), dt.date(2024, 1, 5)),            # Fri at the cut-off: same day
        (dt.datetime(2024, 1, 5, 16, 30, 0, 500000), dt.date(2024, 1, 8)),    # Fri just after: Monday
        (dt.datetime(2024, 1, 6, 9, 0), dt.date(2024, 1, 8)),                 # Saturday: Monday
        (dt.datetime(2024, 1, 7, 23, 0), dt.date(2024, 1, 8)),                # Sunday: Monday
        (dt.datetime(2024, 1, 3, 17, 0), dt.date(2024, 1, 4)),                # Wed late: Thursday
        (dt.datetime(2024, 1, 3, 10, 0), dt.date(2024, 1, 3)),                # Wed early: same day
    ]
    df = spark.createDataFrame(rows, "ts timestamp, want date")
    got = df.select(business_day_target(F.col("ts")).alias("d"), "want").collect()
    assert [r["d"] for r in got] == [r["want"] for r in got]
    late = df.select(after_close(F.col("ts")).alias("a")).collect()
    assert [r["a"] for r in late][:2] == [False, True]


def test_exact_split_sizes_golden(spark):
    n = 92_441
    df = spark.range(n).withColumnRenamed("id", "id")
    out = ds.exact_split(df, key="id", stratum=None)
    sizes = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert sizes == {"train": 64_707, "val": 9_245, "test": 18_489}


def test_stratified_split_quotas(spark):
    rows = [(i, "a" if i % 4 else "b") for i in range(1000)]
    out = ds.exact_split(spark.createDataFrame(rows, "id long, s string"), key="id", stratum="s")
    sizes = {(r["s"], r["split"]): r["count"] for r in out.groupBy("s", "split").count().collect()}
    assert sum(v for (s, k), v in sizes.items() if k == "test") == 200
    assert abs(sizes[("b", "test")] - 50) <= 1 and abs(sizes[("a", "test")] - 150) <= 1


def test_describe_linear_quartiles(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4]], "x double")
    r = pr.describe(df, "x").first().asDict()
    assert r["count"] == 4 and r["min"] == 1 and r["max"] == 4
    assert math.isclose(r["std"], 1.2909944487358056)
    quart = sorted(v for k, v in r.items() if k not in ("count", "mean", "std", "min", "max"))
    assert any(math.isclose(v, 1.75) for v in quart)


def test_argmax_first_maximum(spark):
    df = spark.createDataFrame([([0.1, 0.7, 0.7],), ([3.0, 1.0, 2.0],)], "l array<double>")
    assert [r[0] for r in df.select(ev.argmax("l")).collect()] == [1, 0]


def test_line_endings_and_tokens(spark):
    df = spark.createDataFrame([("Hello wörld\r\nA b_c 42",), ("plain\ntext",)], "body string")
    assert df.where(F.col("body").contains("\r\n")).count() == 1
    toks = df.select(tx.tokens("body").alias("t")).first()["t"]
    assert toks == ["hello", "wörld", "b_c", "42"]
