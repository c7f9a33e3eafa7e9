"""Merkle manifest of a dataset: a hash tree per source, one over the sources, a proof for every row.

H is the lowercase hex sha256 of its inputs as text.  A row's leaf is H of
``columns``, each as its UTF-8 byte count, a colon and the value (``-`` if null).
The leaves of a source, in order of ``doc_id``, become nodes in runs of ``fan``
until one is left, the source's subroot; the subroots, ordered by source, become the root
the same way.

Cogrouped subtree exchange.  ``fan ** depth`` consecutive leaves are a superblock.

1. Rows are numbered within their source by ranges of (source, doc_id), so a hot source is
   spread over many tasks, and each superblock is reduced to its top node.
2. The small upper trees are reduced level by level and read back from the
   root: every superblock learns its *outer nodes*, the siblings on its way to the root.
3. Leaves and outer nodes are cogrouped by superblock.  Each group finishes its own levels, joins
   them with the outer ones into proofs and folds every leaf (or the leaf to be
   verified) up to the root.

No group holds more than a superblock, and an upper level holds ``1 / fan`` of the rows below it.

Defined cases: a null value is ``-`` and an empty one ``0:``; a null source is a source of its own, first in
order; a null ``doc_id`` comes first in its source; rows of one ``doc_id`` follow their
leaf, and equal rows are interchangeable; texts of any length are hashed whole; a source of one
row has its leaf as subroot and a proof of outer nodes only; extra columns are no part of a leaf, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import parts
from quillmark.session import stage

# What a leaf holds, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def H(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values: list[Column]) -> Column:
    """H of values, each with its byte count."""
    def framed(c: Column) -> Column:
        s = c.cast("string")
        return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))
    return F.sha2(F.concat(*[framed(c) for c in values]), 256)


def numbered(rows: DataFrame, order: list[str], name: str, rows_a_part: int = 500_000) -> DataFrame:
    """Adds ``pos``, the place of each row within its ``src``.

    ``row`` breaks ties, so that even equal rows are dealt to several ranges.
    """
    ranges = max(parts(rows.sparkSession), -(-rows.count() // rows_a_part))
    keys = ["src", *order, "row"]
    sorted_ = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    cut = stage(sorted_.withColumn("at", F.monotonically_increasing_id()), name).withColumn("part", F.shiftright("at", 33))
    runs = cut.groupBy("src", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("src", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))  # one row a source and range
    return cut.join(runs, ["src", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift", "row")


def above(n: Column, fan: int) -> Column:
    """Levels over n leaves: how often they are reduced until one is left."""
    powers = [fan ** k for k in range(63) if fan ** k < 2 ** 62]
    return reduce(lambda a, b: a + b, [F.when(n > F.lit(p), 1).otherwise(0) for p in powers])


def reduced(digests: Column, fan: int) -> Column:
    """The next level over an array of digests."""
    runs = F.sequence(F.lit(0), F.floor((F.size(digests) - 1) / fan).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(digests, i * fan + 1, F.lit(fan)), ""), 256))


def _in_order(place: str, digest: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(place, digest))), lambda x: x[digest])


class Tree:
    """Upper levels of hash trees, one tree per ``src``, above nodes (src, idx, digest) and ``levels`` (src, levels)."""

    def __init__(self, nodes: DataFrame, levels: DataFrame, fan: int, name: str):
        """``levels`` counts the reductions still to be done in a tree."""
        self.fan, self.name, self.levels = fan, name, levels
        self.runs: list[DataFrame] = []  # per level: (src, run, digests)
        most = levels.agg(F.max("levels")).first()[0] or 0
        tops = [nodes.join(levels.where("levels = 0").select("src"), "src").select("src", "digest")]
        for k in range(most):
            open_ = nodes.join(levels.where(F.col("levels") > k).select("src"), "src")
            runs = (open_.groupBy("src", F.floor(F.col("idx") / fan).cast("long").alias("run"))
                    .agg(_in_order("idx", "digest").alias("digests")))
            self.runs.append(stage(runs, f"{name}_runs"))
            nodes = self.runs[-1].select("src", F.col("run").alias("idx"),
                                         F.sha2(F.array_join("digests", ""), 256).alias("digest"))
            tops.append(nodes.join(levels.where(F.col("levels") == k + 1).select("src"), "src").select("src", "digest"))
        self.tops = stage(reduce(DataFrame.unionByName, tops), f"{name}_tops")  # one row a tree

    def paths(self, start: DataFrame) -> DataFrame:
        """(src, idx, left, right) of the lowest nodes: the joined siblings of every level on the way up.

        ``start`` (src, left, right) is what lies above each tree's top.
        """
        none = F.lit(0).cast("long").alias("idx")
        found = None
        for k in range(len(self.runs), -1, -1):
            here = start.join(self.levels.where(F.col("levels") == k).select("src"), "src").select("src", none, "left", "right")
            if found is not None:
                d, i = F.col("digests"), F.col("i")
                child = self.runs[k].join(found.withColumnRenamed("idx", "run"), ["src", "run"]).select(
                    "src", "run", "left", "right", "digests", F.posexplode("digests").alias("i", "_d"))
                here = here.unionByName(child.select(
                    "src", (F.col("run") * self.fan + i).alias("idx"),
                    F.concat(F.array(F.array_join(F.slice(d, F.lit(1), i), "")), "left").alias("left"),
                    F.concat(F.array(F.array_join(F.slice(d, i + 2, F.size(d)), "")), "right").alias("right")))
            found = here
        return stage(found, f"{self.name}_paths")


def exchange(fan: int, depth: int):
    """The function of the cogroups: proofs and folds of one superblock."""
    def run(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", ignore_index=True)
        up = outer.iloc[0]
        levels = [rows["leaf"].tolist()]
        for _ in range(up["local"]):
            below = levels[-1]
            levels.append([H("".join(below[i: i + fan])) for i in range(0, len(below), fan)])
        way = list(zip(up["left"], up["right"]))
        above_ = ["".join(a + b for a, b in way)] * len(levels[-1])  # proof text from a node of this level upwards
        beside = []
        for nodes in levels[-2::-1]:
            sides = []
            for i in range(len(nodes)):
                first = i - i % fan
                sides.append(("".join(nodes[first:i]), "".join(nodes[i + 1: first + fan])))
            above_ = [a + b + above_[i // fan] for i, (a, b) in enumerate(sides)]
            beside.append(sides)
        beside.reverse()
        folded = []
        for i, digest in enumerate(rows["other"].where(rows["other"].notna(), rows["leaf"])):
            for sides in beside:
                a, b = sides[i]
                digest, i = H(a + digest + b), i // fan
            for a, b in way:
                digest = H(a + digest + b)
            folded.append(digest)
        return pd.DataFrame({
            "doc_id": rows["doc_id"].astype("Int64"), "leaf": rows["leaf"], "subroot": up["subroot"], "root": up["root"],
            "proof_sha256": [H(x) for x in above_], "folded_root": folded, "verified": np.array(folded) == up["root"]})

    return run


SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, altered: dict[str, Column] | None = None, fan: int = 16, depth: int = 2) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``altered`` gives columns of a copy of the rows that is verified against the tree of ``docs``
    (the rows themselves if not given): its leaf is folded with the original siblings.
    """
    def of(values: dict[str, Column]) -> Column:
        return leaf([values.get(c, F.col(c)) for c in COLUMNS])

    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # null first, then bytewise
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("src"), of({}).alias("leaf"),
                         (of(altered) if altered else F.lit(None).cast("string")).alias("other"),
                         F.monotonically_increasing_id().alias("row"))
    placed = stage(numbered(stage(leaves, "merkle_leaves"), ["doc_id", "leaf"], "merkle_sorted")
                   .withColumn("block", F.floor(F.col("pos") / fan ** depth).cast("long")), "merkle_placed")

    trees = placed.groupBy("src").agg(above(F.count("*"), fan).alias("levels")).withColumn("local", F.least("levels", F.lit(depth)))
    trees = stage(trees, "merkle_trees")
    tops = placed.groupBy("src", "block").agg(_in_order("pos", "leaf").alias("digests")).join(trees, "src")
    digest = F.col("digests")
    step = digest
    for k in range(depth):
        step = F.when(F.col("local") > k, reduced(step, fan)).otherwise(step)
    blocks = stage(tops.select("src", F.col("block").alias("idx"), step[0].alias("digest")), "merkle_blocks")
    inner = Tree(blocks, trees.select("src", (F.col("levels") - F.col("local")).alias("levels")), fan, "merkle_inner")

    # the subroots are the leaves of one more tree
    sources = numbered(inner.tops.select(F.lit("").alias("src"), F.col("src").alias("name"), "digest", F.lit(0).alias("row")),
                       ["name"], "merkle_sources")
    sources = stage(sources, "merkle_subroots")
    whole = sources.groupBy("src").agg(above(F.count("*"), fan).alias("levels"))
    outer = Tree(sources.select("src", F.col("pos").alias("idx"), "digest"), whole, fan, "merkle_outer")
    none = F.array().cast("array<string>")
    ways = outer.paths(outer.tops.select("src", none.alias("left"), none.alias("right")))
    starts = (sources.join(ways.withColumnRenamed("idx", "pos"), ["src", "pos"]).join(outer.tops.select("src", F.col("digest").alias("root")), "src")
              .select(F.col("name").alias("src"), F.col("digest").alias("subroot"), "root", "left", "right"))
    starts = stage(starts, "merkle_starts")
    need = (inner.paths(starts).join(starts.select("src", "subroot", "root"), "src").join(trees.select("src", "local"), "src")
            .select("src", F.col("idx").alias("block"), "local", "left", "right", "subroot", "root"))
    rows = placed.select("src", "block", "pos", "doc_id", "leaf", "other")
    return rows.groupBy("src", "block").cogroup(need.groupBy("src", "block")).applyInPandas(exchange(fan, depth), SCHEMA)


def lowered(text: Column) -> Column:
    """A text with A-Z in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
