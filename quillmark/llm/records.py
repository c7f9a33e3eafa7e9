"""Token ids in length-delimited binary records with an offset index.

File format: records one after the other,

    u64 length | u32 masked CRC-32 of the length | payload | u32 masked CRC-32 of the payload | 0x0A

little-endian; a checksum c is stored masked as ((c >> 15 | c << 17) + 0xA282EAD8) mod 2**32, so that a
checksum over data that holds checksums stays meaningful.  The payload is
``u8 flags | i64 doc_id | u8 bytes per id | ids``.  Files are written by
Spark's text sink (the line end is the last byte of the record), so they reach
any file system Spark can write, are committed whole, and a lost executor
leaves no half file.  Documents run in ascending ``doc_id`` through the files in
the order of their part numbers.  The index (Parquet, one row per record) holds
file, offset and length, so records can be read in any order.

Defined cases: a null text is an empty one (end id only); a null ``doc_id``
comes first; equal ids are ordered by text; an empty table writes no record.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm import tokens
from quillmark.llm.common import parts, texts_of

# Fixed values of the file format.
MASK_DELTA = 0xA282EAD8
HEAD = struct.Struct("<QI")
PAYLOAD = struct.Struct("<BqB")
CRC = struct.Struct("<I")
LINE_END = b"\n"

INDEX = "file string, offset long, length long, doc_id long, n_tokens long, ids_crc32 long, before long"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    """One record without the line end; ``width`` is 2 or 4 bytes an id."""
    payload = PAYLOAD.pack(doc_id is None, doc_id or 0, width) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + CRC.pack(masked(length)) + payload + CRC.pack(masked(payload))


def unframe(data: bytes, at: int) -> tuple[int | None, np.ndarray, int]:
    """(doc_id, ids as u4, place of the next record); raises ``ValueError`` on a damaged record."""
    if len(data) < at + HEAD.size:
        raise ValueError(f"record cut short at byte {at}")
    length, crc = HEAD.unpack_from(data, at)
    if masked(data[at: at + 8]) != crc:
        raise ValueError(f"damaged length at byte {at}")
    start = at + HEAD.size
    stop = start + length + CRC.size
    payload = data[start: start + length]
    if len(data) < stop + 1 or masked(payload) != CRC.unpack_from(data, start + length)[0]:
        raise ValueError(f"damaged record at byte {at}")
    if data[stop: stop + 1] != LINE_END:
        raise ValueError(f"record at byte {at} does not end where its length says")
    null, doc_id, width = PAYLOAD.unpack_from(payload)
    ids = np.frombuffer(payload, dtype=f"<u{width}", offset=PAYLOAD.size).astype("<u4")
    return None if null else doc_id, ids, stop + 1


def write_records(docs: DataFrame, folder: str, end: int = 2, path: str | None = None, width: int = 2,
                  files: int | None = None, file_bytes: int = 128 << 20) -> None:
    """Writes every document's ids and the end id below ``folder``/data in ascending ``doc_id`` order.

    ``files`` sets how many ranges of ids, hence files, the corpus is cut into; by default as many as keep a
    file at about ``file_bytes`` of text (its ids take about half of that), and at least the session's shuffle
    partitions.  ``width`` 2 holds ids below 65,536.
    """
    path = path or tokens.byte_bpe()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            frames = []
            for row, t in tokens.encoded(b, path, end):
                frames.append(frame(ids[row], t, width))
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["record"])

    rows = texts_of(docs, F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if files is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(parts(docs.sparkSession), -(-size // file_bytes))
    rows = rows.repartitionByRange(files, "doc_id")
    (rows.sortWithinPartitions("doc_id", "text").mapInArrow(run, "record binary")
     .select(F.col("record").cast("string")).write.option("lineSep", LINE_END.decode()).text(f"{folder}/data"))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/data")
            .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content"))


def write_index(spark: SparkSession, folder: str) -> DataFrame:
    """Reads the files back, checks every checksum, writes and returns the index.

    ``before`` counts the ids of the same file in front of the record.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, data in zip(b["file"], b["content"]):
                at, before, rows = 0, 0, []
                while at < len(data):
                    doc_id, ids, after = unframe(data, at)
                    rows.append((file, at, after - at, doc_id, len(ids), zlib.crc32(ids.tobytes()), before))
                    at, before = after, before + len(ids)
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    _files(spark, folder).mapInPandas(run, INDEX).write.mode("overwrite").parquet(f"{folder}/index")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_records(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids, and the other columns of ``wanted``) for rows of the index, read by offset in any order.

    A file meets the rows wanted of it once, so its bytes travel once however many they are.  A file that
    is not there raises ``ValueError``.
    """
    extra = [c for c in wanted.columns if c not in {x.split()[0] for x in INDEX.split(", ")}]
    kinds = "".join(f", `{c}` {wanted.schema[c].dataType.simpleString()}" for c in extra)

    def run(files: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        data = files["content"].iloc[0] if len(files) else b""
        got = [unframe(data, at)[:2] for at in rows["offset"]]
        out = pd.DataFrame({"doc_id": pd.array([g[0] for g in got], dtype="Int64"), "ids": [g[1] for g in got]})
        return out.join(rows[extra].reset_index(drop=True))

    rows = wanted.select("file", "offset", *extra)
    files = _files(spark, folder).join(rows.select("file").distinct(), "file", "left_semi")
    return files.groupBy("file").cogroup(rows.groupBy("file")).applyInPandas(run, f"doc_id long, ids array<long>{kinds}")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, from the index.

    The running number of ids needs one sum per file; only these sums meet in one window.
    """
    index = read_index(spark, folder)
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    total = (index.groupBy("file").agg(F.sum("n_tokens").alias("ids"))
             .withColumn("first", F.sum("ids").over(Window.orderBy(number, "file")) - F.col("ids")).drop("ids"))
    return index.join(total, "file").select("doc_id", (F.col("first") + F.col("before")).alias("start"),
                                            "n_tokens", "ids_crc32")


def encode(docs: DataFrame, folder: str, **options) -> DataFrame:
    """Writes records and index of ``docs`` below ``folder`` and returns the digests read back."""
    spark = docs.sparkSession
    write_records(docs, folder, **options)
    write_index(spark, folder)
    return digests(spark, folder)
