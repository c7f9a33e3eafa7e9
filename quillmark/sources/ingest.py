"""Raw sources and sinks (A1-A13): price CSVs, reference CSVs, parquet stages, split sink.

Price files: one CSV per symbol, a banner line, a header line
``Date,Close,Open,High,Low,Volume``, prices like ``kr 1,234.5`` and volumes
with thousands commas.  The whole directory is one multi-file scan with an
all-string schema; the banner and header drop out because their ``Date`` does
not parse (no dependence on line order), and the symbol comes from the file
name.  Files without a single valid row are quarantined.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions.parsing import price_cell, volume_cell
from quillmark.session import run_folder

RAW_COLS = ["Date", "Close", "Open", "High", "Low", "Volume"]
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLS])
# Symbols excluded by hand from the price history.
BLACKLIST = ["KRAB", "CSS", "ALT", "ECIT"]
ISSUER_SCHEMA = "issuerId BIGINT, name STRING, symbol STRING"
CATEGORY_SCHEMA = "osl_id INT, category_no STRING, category_en STRING"


def _stem() -> F.Column:
    """File stem of the scanned file (symbol), from the hidden metadata column."""
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)


def read_price_files(spark: SparkSession, path: str, most_columns: int = 32) -> DataFrame:
    """Every ``<SYMBOL>.csv`` under ``path``, each under its own header line.

    Lines are read once.  A line that names all of ``RAW_COLS`` is its file's header; the small (file, columns) table is
    joined to the lines, which are parsed as cells and picked by the place of their name.  Returns (symbol, file,
    columns, date, close, open, high, low, volume); ``columns`` is null and nothing is parsed where a file has no header.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), _stem().alias("symbol"), "value")
    cells = F.from_csv("value", ", ".join(f"c{i} STRING" for i in range(most_columns)), {"mode": "PERMISSIVE"})
    lines = lines.withColumn("cells", F.array(*[F.trim(cells[f"c{i}"]) for i in range(most_columns)]))
    wanted = F.array(*[F.lit(c) for c in RAW_COLS])
    heads = (lines.where(F.size(F.array_except(wanted, "cells")) == 0).groupBy("file")
             .agg(F.min(F.filter("cells", lambda c: c.isNotNull())).alias("columns")))
    rows = lines.join(heads.withColumnRenamed("file", "_file"), F.col("file") == F.col("_file"), "left")
    cell = {c: F.when(F.col("columns").isNotNull(), F.try_element_at("cells", F.array_position("columns", c).cast("int"))) for c in RAW_COLS}
    rows = rows.select("symbol", "file", "columns", *[x.alias(c) for c, x in cell.items()])
    return rows.select("symbol", "file", "columns", F.to_date(F.try_to_timestamp(F.col("Date"), F.lit("yyyy-MM-dd"))).alias("date"),
                       *[price_cell(c).alias(c.lower()) for c in ["Close", "Open", "High", "Low"]],
                       volume_cell("Volume").alias("volume"))


def clean_prices(parsed: DataFrame, blacklist=BLACKLIST) -> tuple[DataFrame, DataFrame]:
    """Valid rows of good files minus the blacklist, and the quarantine table.

    A file is quarantined when none of its lines has a parsable date; the reason tells a missing header (where
    ``parsed`` knows ``columns``).  The blacklist is a fixed parameter list (broadcast, size known).
    """
    valid = parsed.where(F.col("date").isNotNull())
    headed = "columns" in parsed.columns
    files = parsed.select("file", "symbol", *(["columns"] if headed else [])).distinct()
    good = valid.select("file").distinct()
    reason = F.when(F.col("columns").isNull(), "no header").otherwise("no parsable row") if headed else F.lit("no parsable row")
    quarantine = files.join(good, "file", "left_anti").withColumn("reason", reason).drop("columns")
    bl = parsed.sparkSession.createDataFrame([(s,) for s in blacklist], "symbol string")
    keep = valid.join(F.broadcast(bl), "symbol", "left_anti").drop("file")
    return keep, quarantine


def write_price_csvs(bars: DataFrame, path: str, extra_symbols: DataFrame | None = None) -> None:
    """Write bars as per-symbol price files in the source format (banner + header rows).

    ``extra_symbols`` (symbol) get a file with the banner only: a broken file.
    One task per symbol writes its file (the price history of a symbol is bounded by
    its trading days).
    """
    # cents by floor(x * 100 + 0.5): a rounding every engine reproduces
    fmt = lambda c: F.concat(F.lit("kr "), F.format_number(F.floor(F.col(c) * 100 + 0.5) / 100, 2))
    rows = bars.select(
        "symbol", F.lit(2).alias("_o"), F.date_format("date", "yyyy-MM-dd").alias("Date"),
        fmt("close").alias("Close"), fmt("open").alias("Open"), fmt("high").alias("High"), fmt("low").alias("Low"),
        F.format_number(F.col("volume"), 0).alias("Volume"))
    syms = bars.select("symbol").distinct()
    if extra_symbols is not None:
        syms = syms.unionByName(extra_symbols.select("symbol")).distinct()
    banner = syms.select("symbol", F.lit(0).alias("_o"), F.concat(F.lit("Price history "), F.col("symbol")).alias("Date"),
                         *[F.lit(None).cast("string").alias(c) for c in RAW_COLS[1:]])
    header = bars.select("symbol").distinct().select("symbol", F.lit(1).alias("_o"),
                                                     *[F.lit(c).alias(c) for c in RAW_COLS])
    out = rows.unionByName(banner).unionByName(header)
    (out.repartition("symbol").sortWithinPartitions("symbol", "_o", "Date").drop("_o")
        .write.mode("overwrite").partitionBy("symbol").option("header", "false").csv(path))


def write_price_files(bars: DataFrame, path: str, orders: list[tuple[str, list[str], bool]], extra_symbols: DataFrame) -> None:
    """Bars as one ``<SYMBOL>.csv`` a symbol, in the source format.

    ``orders`` (condition, columns, header) gives the symbols of a condition their column order and header line.
    Spark writes a folder a symbol with one file; the driver then gives each file its name (one move a symbol, a
    bounded number).
    """
    spark = bars.sparkSession
    fmt = lambda c: F.concat(F.lit("kr "), F.format_number(F.floor(F.col(c) * 100 + 0.5) / 100, 2))
    cell = {c: F.concat(F.lit('"'), fmt(c.lower()), F.lit('"')) for c in RAW_COLS[1:5]}
    cell |= {"Date": F.date_format("date", "yyyy-MM-dd"), "Volume": F.concat(F.lit('"'), F.format_number(F.col("volume"), 0), F.lit('"'))}
    symbols = bars.select("symbol").distinct()
    lines = symbols.unionByName(extra_symbols.select("symbol")).distinct().select(
        "symbol", F.lit(0).alias("o"), F.concat(F.lit("Price history "), F.col("symbol")).alias("value"))
    for condition, columns, header in orders:
        if header:
            lines = lines.unionByName(symbols.where(condition).select("symbol", F.lit(1).alias("o"), F.lit(",".join(columns)).alias("value")))
        lines = lines.unionByName(bars.where(condition).select("symbol", F.lit(2).alias("o"), F.concat_ws(",", *[cell[c] for c in columns]).alias("value")))
    folders = f"{path}-folders"
    lines.repartition("symbol").sortWithinPartitions("symbol", "o", "value").drop("o").write.partitionBy("symbol").text(folders)
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(Path(path))
    for found in fs.globStatus(Path(f"{folders}/symbol=*/part-*")):
        name = found.getPath().getParent().getName().removeprefix("symbol=")
        if not fs.rename(found.getPath(), Path(f"{path}/{name}.csv")):
            raise OSError(f"cannot name the price file of {name}")


def files_of(spark: SparkSession, path: str) -> list[str]:
    """Names of the data files that Spark has written to a folder."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.globStatus(Path(f"{path}/part-*"))]


def read_price_dir(spark: SparkSession, path: str) -> DataFrame:
    """Variant for a ``symbol=<S>/part-*.csv`` layout: symbol from the partition folder."""
    # recursive lookup turns partition discovery off: the symbol is taken from the path as written
    raw = spark.read.schema(RAW_SCHEMA).option("header", "false").option("recursiveFileLookup", "true").csv(path).select(
        "*", F.col("_metadata.file_path").alias("file"),
        F.regexp_extract(F.col("_metadata.file_path"), r"symbol=([^/]+)/", 1).alias("symbol"))
    d = F.try_to_timestamp(F.col("Date"), F.lit("yyyy-MM-dd"))
    return raw.select("symbol", "file", F.to_date(d).alias("date"),
                      *[price_cell(c).alias(c.lower()) for c in ["Close", "Open", "High", "Low"]],
                      volume_cell("Volume").alias("volume"))


def read_reference_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Small reference CSV (issuers, categories, dictionary) with an explicit schema."""
    return spark.read.schema(schema).option("header", "true").csv(path)


def write_parquet(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """A10: parquet sink, optionally a column subset (selected before the write)."""
    (df.select(*columns) if columns else df).write.mode("overwrite").parquet(path)


def write_splits(df: DataFrame, path: str) -> None:
    """One table partitioned by dataset and split (``<dataset>/<split>`` folders)."""
    df.write.mode("overwrite").partitionBy("dataset", "split").parquet(path)


def read_split(spark: SparkSession, path: str, dataset: str, split: str) -> DataFrame:
    """A1/A2: one split of one dataset; partition pruning reads only its folder."""
    return spark.read.parquet(path).where((F.col("dataset") == dataset) & (F.col("split") == split))


def load_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """Read a materialised stage when its ``_SUCCESS`` marker exists, else build and write it."""
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(os.path.join(path, "_SUCCESS"))
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fingerprint(spark: SparkSession, inputs: list[str], *parameters) -> str:
    """md5 of the parameters and of every input file's path, size and time of change."""
    Path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    seen = [repr(parameters)]
    for name in inputs:
        fs = Path(name).getFileSystem(conf)
        files = fs.listFiles(Path(name), True)  # metadata of the files alone
        found = []
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath().toString()} {f.getLen()} {f.getModificationTime()}")
        seen += sorted(found)
    return hashlib.md5("\n".join(seen).encode()).hexdigest()


def kept(spark: SparkSession, name: str, inputs: list[str], parameters: tuple, build) -> DataFrame:
    """The result of ``build``, written once an application for these parameters and this state of the inputs.

    A changed, added or removed input file gives another fingerprint, so the result is built anew.
    """
    return load_or_build(spark, f"{run_folder(spark)}/kept-{name}-{fingerprint(spark, inputs, *parameters)}", build)
