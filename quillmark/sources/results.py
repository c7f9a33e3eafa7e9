"""Result store of a resumable scoring sweep (A12, C5, C6, J11) and its double-encoded JSON files.

The result of a key (model, field, dataset) is one Parquet folder named by the key and by the state of what it was
made from; Spark's ``_SUCCESS`` file in it is the commit record.  A run that breaks leaves the keys it ended, and the
next run scores the others; a changed input or model has another state, so its keys are scored anew while the
earlier results stay on disk.

The JSON files hold one document a line: a JSON string whose content is itself JSON,
``{model: {field: {dataset: {logits, label_ids, row_ids}}}}``.  Files of one single document without ``row_ids`` are
read too; their rows are numbered by position.  Results are written in blocks, so no task holds a whole key.

Defined cases: a key without logits (null or missing, as in a template of work to do) gives no rows; an empty work
list gives an empty log; ``/`` and other signs in names are escaped in paths and come back as written.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["model", "field", "dataset"]
LOG = "model string, field string, dataset string, state string, folder string, outcome string"
ROWS = ("row_id long, truth string, logits array<double>, label_id int, label string, "
        "model string, field string, dataset string, state string")
CELL = "struct<logits: array<array<double>>, label_ids: array<int>, row_ids: array<bigint>>"


def folder_of(store: str, key: tuple[str, str, str], state: str) -> str:
    names = "/".join(f"{k}={quote(v, safe='')}" for k, v in zip(KEY, key))
    return f"{store}/{names}/state={state}"


def committed(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def sweep(spark: SparkSession, store: str, work: list[tuple[str, str, str]], state: Callable[..., str],
          score: Callable[..., DataFrame]) -> DataFrame:
    """Scores the keys of ``work`` (a list of names, one job each) that have no commit; returns the log.

    ``state(model, field, dataset)`` is a fingerprint of what the result depends on; ``score`` returns
    (row_id, truth, logits, label_id, label).  ``outcome`` is ``kept`` or ``scored``.
    """
    log = []
    for key in work:
        now = state(*key)
        folder = folder_of(store, key, now)
        kept = committed(spark, folder)
        if not kept:
            score(*key).select("row_id", "truth", "logits", "label_id", "label").write.mode("overwrite").parquet(folder)
        log.append((*key, now, folder, "kept" if kept else "scored"))
    return spark.createDataFrame(log, LOG)


def read(log: DataFrame, store: str) -> DataFrame:
    """Result rows of the keys in ``log``, in their states; other folders of the store are not listed."""
    spark = log.sparkSession
    folders = [r["folder"] for r in log.select("folder").distinct().collect()]  # one a key of the work list
    if not folders:
        return spark.createDataFrame([], ROWS)
    return spark.read.schema(ROWS).option("basePath", store).parquet(*folders)


def write_json(rows: DataFrame, path: str, block_rows: int = 10_000) -> None:
    """Results (KEY, row_id, logits, label_id) as double-encoded documents of about ``block_rows`` rows."""
    sizes = rows.groupBy(*KEY).agg(F.ceil(F.count("*") / block_rows).alias("_blocks"))  # one row a key
    dealt = rows.join(F.broadcast(sizes), KEY).withColumn("_block", F.pmod(F.xxhash64("row_id"), F.col("_blocks")))
    cells = dealt.groupBy(*KEY, "_block").agg(F.array_sort(F.collect_list(F.struct("row_id", "logits", "label_id"))).alias("r"))
    cell = F.struct(F.col("r")["logits"].alias("logits"), F.col("r")["label_id"].alias("label_ids"), F.col("r")["row_id"].alias("row_ids"))
    inner = F.to_json(F.create_map("model", F.create_map("field", F.create_map("dataset", cell))))
    quoted = F.to_json(F.array(inner))
    cells.select(F.substring(quoted, F.lit(2), F.length(quoted) - 2).alias("value")).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(KEY, row_id, logits, label_id) of double-encoded result files."""
    inner = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>")[0]
    tree = F.from_json(inner, f"map<string, map<string, map<string, {CELL}>>>")
    docs = spark.read.text(path).where(F.trim("value") != "").select(F.explode(tree).alias("model", "m"))
    cells = docs.select("model", F.explode("m").alias("field", "f")).select("model", "field", F.explode("f").alias("dataset", "c"))
    size = F.greatest(F.size("c.logits"), F.size("c.label_ids"))
    # a row takes its own id along, not the ids of its whole document; without ids the zip stays without them
    ids = F.when(F.col("c.row_ids").isNotNull(), F.slice("c.row_ids", F.lit(1), F.greatest(size, F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
    rows = cells.select(*KEY, F.posexplode(F.arrays_zip(F.col("c.logits").alias("logits"), F.col("c.label_ids").alias("label_ids"),
                                                        ids.alias("row_ids"))).alias("at", "r"))
    return rows.select(*KEY, F.coalesce("r.row_ids", F.col("at").cast("long")).alias("row_id"),
                       F.col("r.logits").alias("logits"), F.col("r.label_ids").alias("label_id"))


def merge(new: DataFrame, existing: DataFrame) -> DataFrame:
    """All rows of ``existing``, and those of ``new`` whose model it does not hold (stored models win whole)."""
    held = existing.select("model").distinct()
    return existing.unionByName(new.select(*existing.columns).join(held, "model", "left_anti"))
