"""N-gram Jaccard join with token-combination prefixes.

A document is its set of distinct n-word shingles; two sets link when
100 * intersection >= percent * union.  A set of size n may miss at most
``slack = n - ceil(percent * n / 100)`` of its shingles in a partner.

Signatures.  All shingles are ordered by their estimated number in the corpus, rarest
first.  Rare shingles sign alone.  Frequent ones are split by hash into
classes and sign in pairs of the same class, which are far rarer than
the shingles themselves.  A prefix of the order is taken that holds

    (rare shingles) + sum over classes (shingles - 1, at least 0)  >=  slack + 1.

At most ``slack`` of them are missing in a partner, so at least one rare
shingle or one class with two shingles is left: linked sets share a signature.
The prefix therefore grows where frequent classes use pairs.  The number of classes
grows with the set (``classes`` below 1,024 shingles, four times as many from there on, and so
on), which keeps the pairs in proportion to the set; a set whose partners may have another number of
classes signs for both.  Only sets of fewer
than ``(classes + 1) / percent**2`` shingles might not reach that sum; these
sign by single shingles as well.

The frequencies come from a sketch over all documents, with about as many counters as the corpus
has shingles and at most ``2**bits``.  Its
estimates only choose the order and the classes, so a wrong estimate costs time,
never a link.

Candidates.  Equal sets are one node, and signatures with the same nodes are one, so a passage that many
sets share is compared once and not for each of its shingles.  Nodes under a signature are first compared
with one hub (a star, not all pairs).  Verified links merge nodes; what is still
in different components under one signature is then compared pairwise, inside a
join whose condition holds the size bound and a bound on the difference of two
parity maps (256 bits, and a map as wide as the set for larger ones, folded to 4,096 bits), so only likely pairs
leave it.  Every surviving pair is
verified on the whole sets.  A pair that is not compared lies in one component already,
so the components are exactly those of all links.

Sets are compared through 64-bit shingle hashes, nodes are named by a 64-bit
hash of the set.

Defined cases: null, empty and word-free texts have no shingles, link with
nothing and are their own component; fewer words than n make one shingle;
repeated rows and ids are separate rows, equal texts share a component; a null
``doc_id`` takes the smallest id of its component, null if there is none; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import Rolling, by_size, components, mix, texts_of, word_hashes
from quillmark.session import stage

SLICES = 64


class Sets:
    """Distinct shingle hashes of texts, computed ``at_once`` characters at a time."""

    def __init__(self, n: int, at_once: int = 500_000):
        self.n, self.at_once, self.rolling = n, at_once, Rolling()

    def _next(self, h: np.ndarray, words: np.ndarray) -> np.ndarray:
        return mix(h * np.uint64(0x9E3779B97F4A7C15) + words)

    def grams(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The shingle hashes of each text in order of place."""
        for first, last in by_size(texts, self.at_once):
            words, count = word_hashes(texts[first:last], self.rolling)
            long = max(len(words) - self.n + 1, 0)
            every = np.full(long, self.n, dtype=np.uint64)
            for i in range(self.n):
                every = self._next(every, words[i: long + i])
            stop = np.cumsum(count)
            for a, b in zip((stop - count).tolist(), stop.tolist()):
                if b - a >= self.n:
                    yield every[a: b - self.n + 1]
                else:  # the whole sequence as one shingle; its length keeps it apart from longer ones
                    h = np.full(1 if b > a else 0, b - a, dtype=np.uint64)
                    for x in words[a:b]:
                        h = self._next(h, x)
                    yield h

    def __call__(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        for g in self.grams(texts):
            g = np.sort(g)
            yield g[np.concatenate([[True], g[1:] != g[:-1]])] if len(g) else g


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def counters(docs: DataFrame, most: int, least: int = 16) -> int:
    """Bits of the sketch: about one counter for each shingle (six bytes of text), within bounds."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return min(most, max(least, (size // 6).bit_length()))


def frequencies(docs: DataFrame, n: int, bits: int) -> np.ndarray:
    """Occurrences of shingles by hash bucket, ``2**bits`` counts of at most 255.

    Each task counts its documents; the compressed slices are added up in two
    levels, so no group holds more than about the square root of the tasks.
    """
    width = (1 << bits) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        table, sets, held = np.zeros(1 << bits, dtype=np.uint8), Sets(n), []

        def put() -> None:
            at, times = np.unique(np.concatenate(held), return_counts=True)
            table[at] = np.minimum(table[at].astype(np.int64) + times, 255)
            held.clear()

        for b in batches:
            for g in sets.grams(b.column("text").to_pylist()):
                held.append(_bucket(g, bits))
                if sum(map(len, held[-64:])) > 1_000_000 or len(held) == 4096:
                    put()
            if held:
                put()
        if not table.any():
            return
        pack = zstandard.ZstdCompressor(level=1)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(range(SLICES), pa.int32()), "salt": pa.array([task] * SLICES, pa.int32()),
            "counts": pa.array([pack.compress(x.tobytes()) for x in np.split(table, SLICES)], pa.binary())})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, dtype=np.uint32)
        for c in group["counts"]:
            total += np.frombuffer(zstandard.decompress(c), dtype=np.uint8)
        packed = zstandard.ZstdCompressor(level=1).compress(np.minimum(total, 255).astype(np.uint8).tobytes())
        return pd.DataFrame({"part": [group["part"].iloc[0]], "counts": [packed]})

    each = texts_of(docs, F.col("text").cast("string").alias("text")).mapInArrow(count, "part int, salt int, counts binary")
    salt = F.floor(F.sqrt(F.col("salt").cast("double"))).cast("int")  # groups of growing size, about 2 * sqrt(tasks) each
    some = each.groupBy("part", salt.alias("salt")).applyInPandas(add, "part int, counts binary")
    table = np.zeros(1 << bits, dtype=np.uint8)
    for r in some.groupBy("part").applyInPandas(add, "part int, counts binary").toLocalIterator():
        table[r["part"] * width: (r["part"] + 1) * width] = np.frombuffer(zstandard.decompress(bytes(r["counts"])), dtype=np.uint8)
    return table


def levels(n: int, percent: int) -> list[int]:
    """Numbers of classes, as powers of four of the smallest, for which a set of n shingles and its partners sign."""
    def level(m: int) -> int:
        return max(0, ((m // 256).bit_length() - 1) // 2)
    return list(range(level(-(-n * percent // 100)), level(n * 100 // percent) + 1))


def signatures(h: np.ndarray, freq: np.ndarray, frequent: int, percent: int, classes: int) -> np.ndarray:
    """Signatures of one set: its prefix's rare shingles, and pairs of its frequent ones within a class."""
    n = len(h)
    if not n:
        return h
    slack = n + (-percent * n // 100)
    # by estimate, then hash: the hashes come sorted
    order = np.argsort((freq.astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32)), kind="stable")
    h, often = h[order], freq[order] > frequent
    rare = int(n - often.sum())
    single = h[: min(rare, slack + 1)]
    out = [mix(single + np.uint64(1))]
    need = slack + 1 - rare
    if need > 0:
        tail = h[rare:]
        for level in levels(n, percent):
            kind = (tail % np.uint64(classes << 2 * level)).astype(np.int64)
            _, first = np.unique(kind, return_index=True)
            adds = np.ones(len(tail), dtype=np.int64)
            adds[first] = 0
            upto = int(np.searchsorted(np.cumsum(adds), need)) + 1
            by = np.argsort(kind[:upto], kind="stable")
            for x in np.split(tail[:upto][by], np.flatnonzero(np.diff(kind[:upto][by])) + 1):
                i, j = np.triu_indices(len(x), 1)
                out.append(mix(mix(x[i] + np.uint64(2 + 7 * level)) + x[j]))
    if n * percent * percent < ((classes << 2 * levels(n, percent)[-1]) + 1) * 10_000:  # too few shingles for the sum to be certain
        out.append(mix(h[: slack + 1] + np.uint64(3)))
    return np.unique(np.concatenate(out))


def parity_map(h: np.ndarray, bits: int = 256) -> np.ndarray:
    """``bits`` bits as 64-bit words; a shingle flips one, so maps differ in at most as many bits as sets in members."""
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def wide_map(h: np.ndarray) -> np.ndarray | None:
    """A parity map of at least as many bits as shingles, for sets that would fill 256 bits."""
    return parity_map(h, 256 << (len(h) // 256).bit_length()) if len(h) >= 256 else None


def _node(h: np.ndarray) -> int | None:
    return int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).astype(np.int64)) if len(h) else None


def _rows(docs: DataFrame) -> DataFrame:
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return texts_of(docs, doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("rid"), text.alias("text"))


def _signed(docs: DataFrame, n: int, percent: int, classes: int, freq, frequent: int, bits: int) -> DataFrame:
    """(doc_id, rid, node, n, rare, map, sigs); equal sets carry their signatures once a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, table, seen = Sets(n), freq.value, set()
        for b in batches:
            cols = {k: [] for k in ("node", "n", "rare", "map", "wide", "sigs")}
            for h in sets(b.column("text").to_pylist()):
                node = _node(h)
                f = table[_bucket(h, bits)]
                new = node is not None and node not in seen
                if new:
                    seen.add(node)
                for k, v in (("node", node), ("n", len(h)), ("rare", int((f <= frequent).sum())),
                             ("map", parity_map(h) if new else None), ("wide", wide_map(h) if new else None),
                             ("sigs", signatures(h, f, frequent, percent, classes) if new else None)):
                    cols[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("rid"), pa.array(cols["node"], pa.int64()), pa.array(cols["n"], pa.int32()),
                 pa.array(cols["rare"], pa.int32()), _lists(cols["map"]), _lists(cols["wide"]),
                 _lists(cols["sigs"])], names=["doc_id", "rid", "node", "n", "rare", "map", "wide", "sigs"])

    return _rows(docs).mapInArrow(run, "doc_id long, rid long, node long, n int, rare int, "
                                       "map array<long>, wide array<long>, sigs array<long>")


def _marks(wanted: DataFrame, bits: int) -> np.ndarray:
    """Bit map of the wanted rows' hashes: ``2**bits`` bits whatever their number."""
    at = F.shiftrightunsigned("rid", 64 - bits)
    words = (wanted.groupBy(F.shiftright(at, 6).alias("word"))
             .agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(rid, {64 - bits}) & 63 AS int)))").alias("m")))
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    got = words.toPandas()
    out[got["word"].to_numpy(dtype=np.int64)] = got["m"].to_numpy()
    return out.view(np.uint64)


def _sets_of(docs: DataFrame, wanted: DataFrame, n: int, bits: int = 24) -> DataFrame:
    """(node, h) of the rows named by ``wanted`` (rid).

    The texts are not shuffled: a bit map of fixed size tells every task which rows may be
    wanted, and the few that only look so are dropped by the join after it.
    """
    wanted = wanted.select("rid").distinct()
    marks = docs.sparkSession.sparkContext.broadcast(_marks(wanted, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(n)
        for b in batches:
            rid = np.asarray(b.column("rid"))
            at = rid.view(np.uint64) >> np.uint64(64 - bits)
            hit = np.flatnonzero(marks.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1))
            got = list(sets(b.column("text").take(pa.array(hit)).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(rid[hit]), pa.array([_node(h) for h in got], pa.int64()),
                                              _lists(got)], names=["rid", "node", "h"])

    rows = _rows(docs).select("rid", "text").mapInArrow(run, "rid long, node long, h array<long>")
    return rows.join(wanted, "rid", "left_semi").dropDuplicates(["rid"]).drop("rid")


def _lists(arrays: list[np.ndarray | None]) -> pa.Array:
    """Arrays of 64-bit hashes as one list column; None gives null."""
    offsets = np.concatenate([[0], np.cumsum([0 if a is None else len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, dtype=np.uint64), *[a for a in arrays if a is not None]])
    null = pa.array([a is None for a in arrays], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)), mask=null)


def _near(percent: int) -> Column:
    """Whether nodes a and b may link by size and by their 256-bit parity maps."""
    a, b = F.col("a.n"), F.col("b.n")
    differ = sum((F.bit_count(F.col("a.map")[i].bitwiseXOR(F.col("b.map")[i])) for i in range(4)), F.lit(0))
    return ((100 * F.least(a, b) >= percent * F.greatest(a, b))
            & (differ * (100 + percent) <= (a + b) * (100 - percent)))


def _wide_near(a: Column, b: Column, percent: int) -> Column:
    """Whether two structs (n, wide) may link by their wide maps.

    Maps of two lengths are compared after folding the longer one (the exclusive or of its halves is the
    map of half the length); sets without a wide map and lengths further apart may.
    """
    def bits(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, k: s + k)

    def half(x: Column) -> Column:
        size = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, 1, size), F.slice(x, size + 1, size), lambda p, q: p.bitwiseXOR(q))

    x, y = a["wide"], b["wide"]
    differ = (F.when(F.size(x) == F.size(y), bits(x, y)).when(F.size(x) == 2 * F.size(y), bits(half(x), y))
              .when(2 * F.size(x) == F.size(y), bits(x, half(y))).otherwise(0))
    return x.isNull() | y.isNull() | (differ * (100 + percent) <= (a["n"] + b["n"]) * (100 - percent))


def _folded(wide: Column, words: int = 64) -> Column:
    """A wide map of at most so many words: word j is the exclusive or of every ``words``-th one from j on."""
    def word(j: Column) -> Column:
        return F.aggregate(F.filter(wide, lambda _, k: k % words == j), F.lit(0).cast("long"), lambda s, v: s.bitwiseXOR(v))

    return F.when(F.size(wide) <= words, wide).when(wide.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(words - 1)), word))


def _widely_near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may link by their whole wide maps too."""
    wide = nodes.where("wide is not null").select("node", F.struct("n", "wide").alias("w"))
    both = (pairs.join(wide.select(F.col("node").alias("a"), F.col("w").alias("x")), "a", "left")
            .join(wide.select(F.col("node").alias("b"), F.col("w").alias("y")), "b", "left"))
    return both.where(_wide_near(F.col("x"), F.col("y"), percent)).select("a", "b")


def _verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    pairs = stage(_widely_near(pairs, nodes, percent), "join_pairs")
    used = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = stage(_sets_of(docs, nodes.join(used, "node", "left_semi"), n), "join_sets")
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("h").alias("ha")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("h").alias("hb")), "b")
            .select("a", "b", (F.size("ha") + F.size("hb")).alias("n"),
                    F.size(F.array_intersect("ha", "hb")).alias("common")))
    return stage(both.where(100 * F.col("common") >= percent * (F.col("n") - F.col("common"))).select("a", "b"),
                 "join_links")


def near_classes(docs: DataFrame, n: int = 5, percent: int = 80, classes: int = 8, bits: int = 25,
                 rare_limit: int = 32) -> DataFrame:
    """(doc_id, n_shingles, component_id, root, rid): one row per document; root names its component.

    A shingle counts as frequent above ``rare_limit`` documents plus four times the sketch's mean load.
    """
    spark = docs.sparkSession
    bits = counters(docs, bits)
    table = frequencies(docs, n, bits)
    frequent = min(250, int(rare_limit + 4 * table.mean()))
    freq = spark.sparkContext.broadcast(table)
    del table
    signed = stage(_signed(docs, n, percent, classes, freq, frequent, bits), "join_signed")
    freq.destroy()  # the staged signatures are all that is needed of it

    shared = (signed.where("sigs is not null").select(F.explode("sigs").alias("sig"), "node", "rare")
              .repartition("sig").dropDuplicates(["sig", "node"]))
    shared.createOrReplaceTempView("quillmark_shared")
    # signatures with the same nodes become one; should other sets of nodes get the same name, they are only compared as well
    shared = stage(spark.sql("""
        SELECT name AS sig, node, hub.node AS hub FROM (
            SELECT node, min(struct(rare, node)) OVER (PARTITION BY sig) AS hub,
                   bit_xor(xxhash64(node)) OVER (PARTITION BY sig) AS name,
                   count(*) OVER (PARTITION BY sig) AS members FROM quillmark_shared)
        WHERE members > 1""").distinct(), "join_shared")
    spark.catalog.dropTempView("quillmark_shared")
    nodes = stage(signed.where("sigs is not null").join(shared.select("node").distinct(), "node", "left_semi")
                  .groupBy("node").agg(F.min("rid").alias("rid"), F.min("n").alias("n"), F.min("map").alias("map"),
                                       F.min("wide").alias("wide")),
                  "join_nodes")
    maps = nodes.select("node", "n", "map")

    def known(pairs: DataFrame) -> DataFrame:
        got = (pairs.join(maps.select(F.col("node").alias("a"), F.struct("n", "map").alias("x")), "a")
               .join(maps.select(F.col("node").alias("b"), F.struct("n", "map").alias("y")), "b"))
        return got.select("a", "b", F.col("x").alias("xa"), F.col("y").alias("yb"))

    star = shared.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    star = known(star).select(F.struct(F.col("a").alias("node"), "xa.*").alias("a"),
                              F.struct(F.col("b").alias("node"), "yb.*").alias("b"))
    star = star.where(_near(percent)).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    links = _verified(docs, star, nodes, n, percent)
    roots = components(links, "join_roots")

    # what a node carries under each of its signatures: one shuffle by signature serves both sides
    about = (nodes.withColumn("w", F.struct("n", _folded(F.col("wide")).alias("wide"))).join(roots, "node", "left")
             .select("node", F.coalesce("root", "node").alias("root"), "n", "map", "w"))
    rest = shared.join(about, "node")
    pairs = (rest.alias("a").join(rest.alias("b"), (F.col("a.sig") == F.col("b.sig")) & (F.col("a.node") < F.col("b.node"))
                                  & (F.col("a.root") != F.col("b.root")) & (F.col("a.node") != F.col("b.hub"))
                                  & (F.col("b.node") != F.col("a.hub")) & _near(percent)
                                  & _wide_near(F.col("a.w"), F.col("b.w"), percent))
             .select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct())
    more = _verified(docs, pairs, nodes, n, percent)
    roots = components(links.union(more), "join_roots")

    rows = signed.select("doc_id", "rid", "node", F.col("n").cast("long").alias("n_shingles"))
    rows = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "root", "left").select(
        "doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least"))
        .alias("component_id"), "root", "rid")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, all columns kept: the one with the smallest (doc_id, row hash).

    Documents without words belong to no group and all stay.
    """
    found = stage(near_classes(docs.select("doc_id", "text"), **options).drop("component_id"), "join_found")
    first = (found.where("root is not null").groupBy("root")
             .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("m")).select("m.rid"))
    keep = first.withColumn("grouped", F.lit(True)).union(
        found.where("root is null").select("rid").distinct().withColumn("grouped", F.lit(False)))
    rid = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = docs.select(F.struct("*").alias("row"), rid.alias("rid")).join(keep, "rid")
    turn = F.row_number().over(Window.partitionBy("rid").orderBy("row.doc_id"))  # equal rows: one stays
    return rows.withColumn("turn", turn).where("turn = 1 or not grouped").select("row.*")
