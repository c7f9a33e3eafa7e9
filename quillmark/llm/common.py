"""Helpers shared by the corpus operators: words, hashes, connected components."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.session import stage

# A word is a run of characters other than space and U+0009..U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD_PATTERN)


def words_col(text: Column) -> Column:
    """Array of words; null text gives an empty array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN), F.lit(0))


def texts_of(docs: DataFrame, *columns: Column) -> DataFrame:
    """The columns a Python stage reads; whole texts travel in batches of 1,000 rows, which bounds a worker's memory."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return docs.select(*columns)


def parts(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixer (fixed odd multipliers of the SplitMix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """64-bit polynomial hashes of stretches of a byte or symbol sequence, all at once from one running sum."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15):
        self.base = base  # odd, so its powers have inverses
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        inverse = pow(self.base, -1, 1 << 64)
        self.up, self.down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(x))]), dtype=np.uint64)
                              for x in (self.base, inverse))

    def spans(self, symbols: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of symbols[start:stop] for every pair; equal content and length give equal hashes."""
        n = len(symbols)
        if n >= len(self.up):
            self._grow(2 * n)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=total[1:])
        return mix((total[stop] - total[start]) * self.down[start])

    def windows(self, symbols: np.ndarray, size: int) -> np.ndarray:
        """Hashes of all stretches of ``size`` symbols."""
        first = max(len(symbols) - size + 1, 0)
        return self.spans(symbols, slice(0, first), slice(size, size + first))


def word_hashes(texts: list[str | None], rolling: Rolling, ends: bool = False) -> tuple[np.ndarray, ...]:
    """(64-bit hashes of all words one text after the other, words per text); A-Z count as a-z, null as empty.

    With ``ends`` the last byte of each word and the one before it (0 if none) come between the two.
    """
    raw = [t.encode().lower() if t else b"" for t in texts]  # bytes: only A-Z change, white space is U+0009..D and space
    data = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    inside = ~((data == 32) | (data - np.uint8(9) < 5))
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    start, stop = edges[::2], edges[1::2]
    last = np.cumsum([len(x) + 1 for x in raw])
    count = np.diff(np.searchsorted(start, last), prepend=0)
    h = rolling.spans(data, start, stop)
    if not ends:
        return h, count
    more = np.where(stop - start > 1, data[stop - 2], 0)
    return h, data[stop - 1].astype(np.uint64), more.astype(np.uint64), count


def by_size(texts: list[str | None], at_once: int) -> Iterator[tuple[int, int]]:
    """(first, last) of runs of texts of about ``at_once`` characters."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size < at_once):
            size += len(texts[last] or "") + 1
            last += 1
        yield first, last
        first = last


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, root): smallest node reachable over links (a, b); nodes without a link are absent.

    Alternates "hang every neighbour on the smallest" steps (large star, then
    small star) over staged tables until the links no longer change.  Each
    step pre-aggregates by node, so a node with many links costs one row per
    link and no group is gathered.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = stage(edges, name)
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a")
                 .select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")),
                                           F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
                 .select("e.*").where("a <> b").distinct())
        edges = stage(small, name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
