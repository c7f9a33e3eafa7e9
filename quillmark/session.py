"""Spark session defaults shared by tests, the bench and the query registry.

The settings are the ones the engine relies on for correct results (UTC wall
clock, ANSI arithmetic) plus the adaptive-execution switches that let Spark
re-plan joins and skewed partitions at run time.  On a cluster the session is
built by the platform; ``configure`` only fills in what is unset there.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings the engine's semantics depend on (always applied).
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

# Planner settings that matter at scale; applied only where the cluster left them unset.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # Broadcast only what is provably small; AQE may still convert at run time
    # from measured shuffle sizes, which is the checked bound.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A query runs many jobs: the shuffle files of one go when it ends, not when the driver happens to collect garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def ship_code(spark: SparkSession) -> None:
    """Hands this package to the Python workers once per application, wherever the session was started from."""
    sc = spark.sparkContext
    if getattr(sc, "_quillmark_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="quillmark-code-")
    path = os.path.join(folder, "quillmark-code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)
    sc._quillmark_shipped = True


def configure(spark: SparkSession) -> SparkSession:
    ship_code(spark)
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    for k, v in SCALE_CONF.items():
        try:
            if spark.conf.get(k, None) in (None, ""):
                spark.conf.set(k, v)
        except Exception:  # static conf on a running cluster session
            pass
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster (``spark.checkpoint.dir``); never a machine-local one."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share "
                           "when the session is built; intermediates are written there")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """Folder of this application's intermediates; ``drop_stages`` removes it as a whole."""
    return f"{checkpoint_dir(spark)}/quillmark-{spark.sparkContext.applicationId}"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "quillmark",
                  shared: str | None = None) -> SparkSession:
    """Session for tests and the local bench: one machine, so a temporary folder is the shared one."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("QUILLMARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="quillmark-wh-"))
        .config("spark.checkpoint.dir", shared or tempfile.mkdtemp(prefix="quillmark-ckpt-"))
    )
    for k, v in {**REQUIRED_CONF, **SCALE_CONF}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the run folder."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df, name: str):
    """Materialise ``df`` as parquet under the run folder and read it back.

    Used where a plan branches (the same intermediate feeds several joins or
    aggregates): the branches then scan the written table instead of
    recomputing the upstream shuffles, and the lineage is cut, so a lost
    executor only re-reads files.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.stage_path = path
    return staged


def drop_stage(staged) -> None:
    """Deletes what ``stage`` wrote, once nothing lazy reads it any more."""
    drop_path(staged.sparkSession, staged.stage_path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate through Spark's file system layer."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_stages(spark: SparkSession) -> None:
    """Delete every intermediate of this application.

    Results of queries read their stages lazily, so call this once the results
    have been written or collected.
    """
    if spark.conf.get("spark.checkpoint.dir", None):
        drop_path(spark, run_folder(spark))
