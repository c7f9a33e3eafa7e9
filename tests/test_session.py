"""Intermediates: a shared folder is required, stages are named by application and deleted together."""

import os
import time

import pytest
from pyspark.sql import functions as F

from quillmark.session import checkpoint_dir, drop_stage, drop_stages, fresh_path, run_folder, stage


class Bare:
    """A session without spark.checkpoint.dir."""

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return default


def test_a_shared_folder_is_required():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir is not set"):
        checkpoint_dir(Bare())


def test_stages_are_written_and_dropped(spark):
    df = stage(spark.range(10).withColumn("x", F.col("id") * 2), "numbers")
    assert sorted(r["x"] for r in df.collect()) == list(range(0, 20, 2))
    assert fresh_path(spark, "a") != fresh_path(spark, "a")
    folder = run_folder(spark).removeprefix("file:").replace("//", "/")
    assert any(x.startswith("numbers-") for x in os.listdir(folder))
    drop_stages(spark)
    assert not os.path.exists(folder)
    drop_stages(spark)  # nothing left: no error


def test_shuffle_files_go_with_their_job(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before = files()
    df = spark.range(100_000).repartition(4, "id").groupBy((F.col("id") % 100).alias("k")).count()
    kept = stage(df, "counts")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert kept.count() == df.count() == len(df.collect()) == len(df.collect()) == 100  # a plan may run again


def test_a_stage_is_dropped_alone(spark):
    one, two = stage(spark.range(3), "one"), stage(spark.range(4), "two")
    drop_stage(one)
    assert not os.path.exists(one.stage_path.removeprefix("file:")) and two.count() == 4
