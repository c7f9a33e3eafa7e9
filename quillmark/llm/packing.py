"""Best-fit packing of documents into fixed-length sequences (vector best-fit).

A sequence has three capacities: tokens, documents and attention cost (sum of
squared piece lengths).  Pieces are placed largest first; among the open
sequences that can take a piece under every constraint, the one with the best
score is used:

* ``norm``: smallest weighted norm of what remains free after placing;
* ``dot``: largest weighted dot product of the piece and what is free.

The pieces are dealt to shards of about ``shard_pieces`` by row number, each
packed by one task, so neither a hot document id nor the corpus size decides
how much a task holds; a shard leaves at most a few sequences underfilled.

Defined cases: a null or empty text is one piece holding the end id; repeated
rows are packed as separate documents; a null ``doc_id`` is kept as null; a
document longer than a sequence is cut into full pieces after a first, possibly
shorter one; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import tokens
from quillmark.llm.common import texts_of
from quillmark.session import stage

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, end: int, size: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, end id included."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            out = []
            for row, t in tokens.encoded(b, path, end):
                first = (len(t) - 1) % size + 1
                cuts = [0, *range(first, len(t) + 1, size)]
                out += [(ids[row], k, x, y - x, zlib.crc32(t[x:y].tobytes()))
                        for k, (x, y) in enumerate(zip(cuts, cuts[1:]))]
            cols = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             names=[c.split()[0] for c in PIECE.split(", ")])

    return texts_of(docs, F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECE)


def vector_best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float],
                    rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; ``lengths`` must not increase."""
    top = np.array(capacity, dtype=float)
    w = np.array(weights, dtype=float)
    smallest = int(lengths[-1]) if len(lengths) else 0
    free = np.empty((3, len(lengths)))
    name = np.empty(len(lengths), dtype=np.int64)
    n_open = made = 0
    sequence = np.empty(len(lengths), dtype=np.int64)
    offset = np.empty(len(lengths), dtype=np.int64)
    for i, length in enumerate(lengths.tolist()):
        need = np.array([length, 1.0, float(length) * length])
        f = free[:, :n_open]
        fits = np.flatnonzero((f[0] >= need[0]) & (f[1] >= 1) & (f[2] >= need[2]))
        if len(fits):
            left = f[:, fits] / top[:, None]
            if rule == "norm":
                k = fits[np.argmin(w @ (left - (need / top)[:, None]) ** 2)]
            else:
                k = fits[np.argmax((w * need / top) @ left)]
        else:
            k = n_open
            free[:, k], name[k] = top, made
            n_open += 1
            made += 1
        sequence[i], offset[i] = name[k], top[0] - free[0, k]
        free[:, k] -= need
        if free[0, k] < smallest or free[1, k] < 1 or free[2, k] < smallest * smallest:  # full: close it
            n_open -= 1
            free[:, k], name[k] = free[:, n_open], name[n_open]
    return sequence, offset


def pack(found: DataFrame, size: int, max_docs: int | None = None, max_attention: int | None = None,
         weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm",
         shard_pieces: int = 20_000) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of at most ``size`` tokens.

    The limits on documents and attention cost default to values that never
    bind, so the number of sequences is as small as the lengths allow.
    """
    capacity = (size, max_docs or size, max_attention or size * size)
    found = stage(found, "pieces")
    shards = max(1, -(-found.count() // shard_pieces))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "ids_crc32", "doc_id", "piece", "row"],
                                  ascending=[False] + [True] * 4, ignore_index=True)
        seq, off = vector_best_fit(group["length"].to_numpy(), capacity, weights, rule)
        group["sequence_id"], group["offset"] = seq * shards + key[0], off
        return group.drop(columns=["row", "shard"])

    row = F.monotonically_increasing_id()  # over written files: the same again when a task is repeated
    dealt = found.withColumn("row", row).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(run, f"{PIECE}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, size: int = 2048, end: int = 0, path: str | None = None, **options) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, path or tokens.byte_bpe(), end, size), size, **options)
