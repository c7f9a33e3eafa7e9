"""Packing documents into fixed-length sequences by minimum bin slack.

A document is its token ids and an end id.  Whole windows of a long document
are sequences of their own; what is left of it, and every shorter document,
is a rest of a certain length.  A task gathers rests up to ``pool`` tokens and
fills one window after the other:

* the longest rest opens the window;
* a subset-sum over the remaining lengths (longest first, each as often as it
  occurs) is kept as a bit set of reachable sums, one per length; it ends when
  the free room itself is reachable, or with the largest sum below it;
* the counts of every length are read back through the bit sets, and equal
  windows are made as long as the counts allow;
* a window that stays short is filled with the front of the shortest rest
  that is left (each of them is longer than the gap), whose back goes to the
  pool again.

Sequences are padded to ``size`` except at a power of two.  So the last rests of
a task, which fill no window, are dealt to sequences whose lengths are the
binary digits of their sum, and no sequence needs padding.

A task's state is its pool and one batch; there is no shuffle, so neither hot
ids nor the corpus size decide what a task holds.  A lost task packs its own
rows again, into the same sequences: their numbers are made of partition and
turn.

Defined cases: a null or empty text is the end id alone; repeated rows are
packed as separate documents; a null ``doc_id`` is kept as null; a text of any
length fills its own windows; ties of length go by the order of reading, last first; extra
columns are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import tokens
from quillmark.llm.common import texts_of

ROW = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SEQUENCES = 33  # low bits of a sequence id: its turn within the partition


class Rest(NamedTuple):
    """A stretch of a document that is not yet placed."""

    doc: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int


def closest(lengths: list[int], counts: list[int], room: int) -> list[int]:
    """How often to use each length (descending, ``counts`` times at most) for the largest sum up to ``room``."""
    mask = (1 << (room + 1)) - 1
    sums = [1]
    for length, count in zip(lengths, counts):
        reach, left, step = sums[-1], min(count, room // length), 1
        while left:  # 1, 2, 4, ... and the remainder make every number up to the count
            some = min(step, left)
            reach |= (reach << (some * length)) & mask
            left, step = left - some, 2 * step
        sums.append(reach)
        if reach >> room:
            break
    at = sums[-1].bit_length() - 1
    used = [0] * len(lengths)
    for i in range(len(sums) - 2, -1, -1):
        while not sums[i] >> at & 1:
            at -= lengths[i]
            used[i] += 1
    return used


class Pool:
    """Rests by length, and the windows made of them."""

    def __init__(self, size: int):
        self.size, self.by, self.tokens = size, {}, 0

    def add(self, rest: Rest) -> None:
        self.by.setdefault(len(rest.ids), []).append(rest)
        self.tokens += len(rest.ids)

    def take(self, length: int) -> Rest:
        found = self.by[length]
        rest = found.pop()
        if not found:
            del self.by[length]
        self.tokens -= length
        return rest

    def split(self, length: int, front: int) -> Rest:
        """The first ``front`` ids of a rest of this length; its back returns to the pool."""
        rest = self.take(length)
        self.add(Rest(rest.doc, rest.start + front, rest.ids[front:], rest.doc_tokens))
        return Rest(rest.doc, rest.start, rest.ids[:front], rest.doc_tokens)

    def windows(self, until: int) -> Iterator[list[Rest]]:
        """Full windows while more than ``until`` tokens are left."""
        while self.tokens > max(until, self.size - 1):
            top = max(self.by)
            left = {x: len(found) - (x == top) for x, found in self.by.items()}  # the longest rest opens the window
            lengths = sorted((x for x, n in left.items() if n and x <= self.size - top), reverse=True)
            counts = [left[x] for x in lengths]
            used = closest(lengths, counts, self.size - top)
            chosen = {x: n for x, n in zip(lengths, used) if n}
            chosen[top] = chosen.get(top, 0) + 1
            gap = self.size - sum(x * n for x, n in chosen.items())
            repeat = 1 if gap else min(len(self.by[x]) // n for x, n in chosen.items())
            for _ in range(repeat):
                if self.tokens <= max(until, self.size - 1):
                    return
                window = [self.take(x) for x, n in chosen.items() for _ in range(n)]
                if gap:  # whatever is left is longer than the gap, or it would have been used
                    window.append(self.split(min(self.by), gap))
                yield window

    def last(self) -> Iterator[list[Rest]]:
        """What is left, in sequences of the binary digits of its sum, longest first."""
        while self.tokens:
            room = 1 << (self.tokens.bit_length() - 1)
            window = []
            while room:
                fit = [x for x in self.by if x <= room]
                window.append(self.take(max(fit)) if fit else self.split(min(self.by), room))
                room -= len(window[-1].ids)
            yield window


def pack_documents(docs: DataFrame, size: int = 2048, end: int = 1, path: str | None = None,
                   pool: int = 2_000_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``size`` must be a power of two.  A pool is packed down to an eighth of ``pool`` tokens while more
    documents come, so that later ones still find short rests to go with.
    """
    if size < 1 or size & (size - 1):
        raise ValueError("size must be a power of two")
    path = path or tokens.byte_bpe()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        turn = TaskContext.get().partitionId() << SEQUENCES
        rests, out = Pool(size), []

        def put(window: list[Rest]) -> None:
            nonlocal turn
            at = 0
            for r in window:
                out.append((r.doc, r.start, len(r.ids), zlib.crc32(r.ids.tobytes()), r.doc_tokens, turn, at))
                at += len(r.ids)
            turn += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                              names=[c.split()[0] for c in ROW.split(", ")])

        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for row, t in tokens.encoded(b, path, end):
                full = len(t) // size * size
                for start in range(0, full, size):
                    put([Rest(ids[row], start, t[start: start + size], len(t))])
                if full < len(t):
                    rests.add(Rest(ids[row], full, t[full:].copy(), len(t)))
                if rests.tokens > pool:
                    for window in rests.windows(pool // 8):
                        put(window)
                if len(out) >= 10_000:
                    yield flush()
        for window in rests.windows(0):
            put(window)
        for window in rests.last():
            put(window)
        yield flush()

    return texts_of(docs, F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ROW)


def padding(packed: DataFrame, size: int = 2048) -> DataFrame:
    """(sequences, tokens, padding, cuts): ids that pad sequences to ``size`` except at a power of two, and pieces beyond one a document."""
    per = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("pieces"),
                                            F.sum(F.when(F.col("start") > 0, 1).otherwise(0)).alias("cut"))
    whole = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    return per.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"),
                   F.sum(F.when(whole, 0).otherwise(size - F.col("n"))).alias("padding"), F.sum("cut").alias("cuts"))
