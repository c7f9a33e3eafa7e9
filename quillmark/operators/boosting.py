"""Boosted trees with L1, L2 and split penalties, a whole grid of fits at once.

Features are binned once: 0 where the feature is absent, 1 up to the median
of its non-zero values, 2 above.  Documents lie in blocks, one row a block,
with their bins as one byte matrix.  A *fit* is a grid point trained without one
fold; it grows one softmax tree a class and round.  One level of all trees of all fits is one job:

1. every block adds up gradients and curvatures by (fit, class, node, feature, bin) -
   products of the block's bin indicators with the gradients of many fits;
2. tasks add their blocks up before the shuffle, and the sums of a chunk of fits meet in one group;
3. the group takes each node's best split, ``gain = T(GL)^2/(HL+l2) + T(GR)^2/(HR+l2) - T(G)^2/(H+l2)``
   with the soft threshold ``T(G) = sign(G) * max(|G| - l1, 0)``, and keeps it if it exceeds ``gamma``.

Fits that train on the same rows and have grown the same trees have the same gradients: their sums are added up
once (in the first round a handful instead of the whole grid), and each fit takes its own splits from them.

The driver holds the models alone (a few numbers a node, bounded by the grid).  Margins are
recomputed from the models, so there is no state by document and fit to move
or to lose.

Row sampling goes by a hash of document and round, column sampling takes the share of
features with the smallest hash of feature and round.  Ties of gain go to the first feature and
the lower cut.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.session import stage

CUTS = 2  # a split sends bins >= 1 or bins >= 2 to the right
NO_FOLD = -1
HELD_BYTES = 64_000_000  # sums that a task holds
TASKS_A_COPY = 4


class Fits(NamedTuple):
    """Parameters of every fit, one array each; ``fold`` is left out of training (-1: none)."""

    learning_rate: np.ndarray
    gamma: np.ndarray
    reg_alpha: np.ndarray
    reg_lambda: np.ndarray
    subsample: np.ndarray
    colsample_bytree: np.ndarray
    fold: np.ndarray

    def some(self, rows) -> Fits:
        return Fits(*(x[rows] for x in self))


def points(grid: dict[str, list[float]]) -> list[dict[str, float]]:
    """Every combination of the grid's values, in its order."""
    return [dict(zip(grid, map(float, v))) for v in itertools.product(*grid.values())]


def fits_of(grid_points: list[dict[str, float]], folds: list[int]) -> Fits:
    """One fit a grid point and fold, folds innermost."""
    rows = [(p, f) for p in grid_points for f in folds]
    return Fits(*(np.array([p[name] for p, _ in rows]) for name in Fits._fields[:-1]), np.array([f for _, f in rows], dtype=int))


# ----------------------------------------------------------------- data

def cuts_of(cells: DataFrame) -> DataFrame:
    """(term, feature, median): features numbered by name.

    The vocabulary must be bounded (a minimum share of documents bounds it by the terms a document over that share).
    """
    medians = cells.groupBy("term").agg(F.percentile("weight", 0.5).alias("median"))
    return medians.withColumn("feature", (F.row_number().over(Window.orderBy("term")) - 1).cast("int"))


def binned(cells: DataFrame, cuts: DataFrame) -> DataFrame:
    """(doc_id, feature, bin) of the non-zero cells (doc_id, term, weight)."""
    return cells.join(cuts, "term").select("doc_id", "feature", F.when(F.col("weight") > F.col("median"), 2).otherwise(1).alias("bin"))


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit hashes and a salt."""
    with np.errstate(over="ignore"):
        h = (h.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h.astype(np.float64) / 2.0 ** 64


def blocks(docs: DataFrame, cells: DataFrame, n_features: int, rows: int = 2048, copies: int = 1) -> DataFrame:
    """One row a block of about ``rows`` documents: ids, y, fold, row hash and the bin matrix as bytes.

    ``docs`` (doc_id, y, fold) includes documents without cells.  ``copies`` is noted with each block: the number of tasks that
    a job over all fits has at least.  A block lies on disk once; tasks with different fits read the same rows.
    """
    n = max(1, -(-docs.count() // rows))
    every = docs.select("doc_id", F.col("y").cast("int"), F.col("fold").cast("int"), F.lit(NO_FOLD).alias("feature"), F.lit(0).alias("bin"))
    every = every.unionByName(cells.select("doc_id", F.lit(0).alias("y"), F.lit(0).alias("fold"), "feature", "bin"))
    every = every.select(F.pmod(F.xxhash64("doc_id"), F.lit(n)).alias("block"), F.xxhash64(F.lit(1), "doc_id").alias("h"), "*")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        head = g[g["feature"] < 0].sort_values("doc_id")
        bins = np.zeros((len(head), n_features), dtype=np.uint8)
        body = g[g["feature"] >= 0]
        at = np.searchsorted(head["doc_id"].to_numpy(), body["doc_id"].to_numpy())
        bins[at, body["feature"].to_numpy()] = body["bin"].to_numpy()
        return pd.DataFrame({"block": [g["block"].iloc[0]], "ids": [head["doc_id"].to_numpy(np.int64).tobytes()],
                             "y": [head["y"].to_numpy(np.int32).tobytes()], "fold": [head["fold"].to_numpy(np.int32).tobytes()],
                             "h": [head["h"].to_numpy(np.int64).tobytes()], "bins": [bins.tobytes()]})

    made = every.groupBy("block").applyInPandas(run, "block long, ids binary, y binary, fold binary, h binary, bins binary")
    return stage(made.withColumn("copies", F.lit(copies)).repartition(n), "boost_blocks")


def _parts(work: DataFrame, groups: int) -> int:
    """Tasks that share the blocks for one of ``groups`` groups of fits: few where the groups alone occupy all cores."""
    n, copies = work.agg(F.count("*"), F.max("copies")).first()
    return max(1, min(n, -(-TASKS_A_COPY * (copies or 1) // groups)))


def _dealt(work: DataFrame, groups: int, run: Callable, schema: str) -> DataFrame:
    """``run(group)`` over all blocks, for every group of fits; nothing of a block is written or moved for it."""
    parts = _parts(work, groups)
    read = work.select("ids", "y", "fold", "h", "bins").coalesce(parts)
    return reduce(DataFrame.unionByName, [read.mapInPandas(run(g), schema) for g in range(groups)])


class Block(NamedTuple):
    ids: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    h: np.ndarray
    bins: np.ndarray


def _block(r, n_features: int) -> Block:
    return Block(np.frombuffer(r.ids, np.int64), np.frombuffer(r.y, np.int32), np.frombuffer(r.fold, np.int32),
                 np.frombuffer(r.h, np.int64).view(np.uint64), np.frombuffer(r.bins, np.uint8).reshape(-1, n_features))


# ----------------------------------------------------------------- model

class Model:
    """Trees of every unit (fit x class): feature and cut of each inner node (-1: leaf), value of each node, by round."""

    def __init__(self, fits: Fits, classes: int, features: int, depth: int):
        self.fits, self.classes, self.features, self.depth = fits, classes, features, depth
        self.feature: list[np.ndarray] = []
        self.cut: list[np.ndarray] = []
        self.value: list[np.ndarray] = []

    @property
    def units(self) -> int:
        return len(self.fits.fold) * self.classes

    def grow(self) -> None:
        """A new round of trees that are one leaf of value 0."""
        inner, nodes = 2 ** self.depth - 1, 2 ** (self.depth + 1) - 1
        self.feature.append(np.full((self.units, inner), -1, dtype=np.int32))
        self.cut.append(np.zeros((self.units, inner), dtype=np.uint8))
        self.value.append(np.zeros((self.units, nodes)))

    def some(self, first: int, last: int) -> Model:
        """The fits from first to last."""
        return self.pick(np.arange(first, last))

    def pick(self, rows: np.ndarray) -> Model:
        """The fits with these numbers."""
        m = Model(self.fits.some(rows), self.classes, self.features, self.depth)
        units = (rows[:, None] * self.classes + np.arange(self.classes)).ravel()
        m.feature, m.cut, m.value = ([x[units] for x in xs] for xs in (self.feature, self.cut, self.value))
        return m

    def distinct(self, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(one fit of each kind, kind of every fit): fits of a kind share fold, row sample and all trees so far.

        With ``rounds`` the values count in so many first rounds only: a round's gradients do not depend on its own values.
        """
        n = len(self.fits.fold)
        trees = [x.reshape(n, -1).astype(float) for xs in (self.feature, self.cut, self.value[:rounds]) for x in xs]
        _, first, kind = np.unique(np.column_stack([self.fits.fold, self.fits.subsample, *trees]), axis=0, return_index=True, return_inverse=True)
        return first, kind.ravel()

    def _nodes(self, columns: np.ndarray, r: int) -> np.ndarray:
        """``nodes`` from bins with a row a feature: units x documents."""
        node = np.zeros((self.units, columns.shape[1]), dtype=np.int16)
        for i in range(2 ** self.depth - 1):
            f = self.feature[r][:, i]
            if (f >= 0).any():
                right = np.take(columns, np.maximum(f, 0), axis=0) >= self.cut[r][:, i, None]
                node = np.where((node == i) & (f >= 0)[:, None], np.int16(2 * i + 1) + right, node)
        return node

    def nodes(self, bins: np.ndarray, r: int) -> np.ndarray:
        """Node of each document in each unit's tree of round r."""
        return np.ascontiguousarray(self._nodes(np.ascontiguousarray(bins.T), r).T)

    def margins(self, bins: np.ndarray, rounds: int) -> np.ndarray:
        """Sum of the values of the first trees: documents x units."""
        columns = np.ascontiguousarray(bins.T)
        out = np.zeros((self.units, len(bins)))
        for r in range(rounds):
            out += np.take_along_axis(self.value[r], self._nodes(columns, r).astype(np.intp), axis=1)
        return np.ascontiguousarray(out.T)


def gradients(model: Model, b: Block, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Softmax gradient and curvature of round r, 0 for documents that a fit does not train on."""
    k = model.classes
    m = model.margins(b.bins, r).reshape(len(b.y), -1, k)
    m -= m.max(axis=2, keepdims=True)
    p = np.exp(m)
    p /= p.sum(axis=2, keepdims=True)
    h = np.maximum(2 * p * (1 - p), 1e-16)
    p[np.arange(len(b.y)), :, b.y] -= 1
    trained = (b.fold[:, None] != model.fits.fold) & (_uniform(b.h, r + 1)[:, None] < model.fits.subsample)
    p *= trained[:, :, None]
    h *= trained[:, :, None]
    return p.reshape(len(b.y), -1), h.reshape(len(b.y), -1)


def histogram(model: Model, b: Block, r: int, level: int) -> np.ndarray:
    """Sums (node of the level, gradient or curvature, cut x feature and the total, unit) of one block.

    The sums of a cut are those of the documents right of it.
    """
    g, h = gradients(model, b, r)
    node = model.nodes(b.bins, r)
    right = np.concatenate([b.bins >= c for c in range(1, CUTS + 1)] + [np.ones((len(b.y), 1), dtype=bool)], axis=1)
    right = right.astype(np.float64).T
    out = np.empty((2 ** level, 2, len(right), model.units))
    for i in range(2 ** level):
        here = node == 2 ** level - 1 + i
        out[i, 0] = right @ (g * here)
        out[i, 1] = right @ (h * here)
    return out


def soft(g: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def gains(sums: np.ndarray, fits: Fits, classes: int, min_child: float) -> np.ndarray:
    """Gain of every (node, cut x feature, unit); -inf where a side has too little curvature."""
    alpha, lam = (np.repeat(x, classes) for x in (fits.reg_alpha, fits.reg_lambda))
    gr, hr = sums[:, 0, :-1], sums[:, 1, :-1]
    g, h = sums[:, 0, -1:], sums[:, 1, -1:]

    def score(g, h):
        return soft(g, alpha) ** 2 / (h + lam)

    out = score(g - gr, h - hr) + score(gr, hr) - score(g, h)
    out[(hr < min_child) | (h - hr < min_child)] = -np.inf
    return out


def columns_of(fits: Fits, features: int, r: int) -> np.ndarray:
    """Which features a fit may use in round r: (cut x feature, fit)."""
    order = np.argsort(np.argsort(_uniform(np.arange(features, dtype=np.uint64), 1_000_003 * (r + 1)), kind="stable"))
    used = order[:, None] < np.ceil(fits.colsample_bytree * features)[None, :]
    return np.concatenate([used] * CUTS)


def best(sums: np.ndarray, model: Model, r: int, min_child: float) -> pd.DataFrame:
    """Best split of every node and unit with the values of the node and its children."""
    k, fits = model.classes, model.fits
    gain = gains(sums, fits, k, min_child)
    gain[:, ~np.repeat(columns_of(fits, model.features, r), k, axis=1)] = -np.inf
    order = np.arange(CUTS * model.features).reshape(CUTS, -1).T.ravel()  # feature first, then cut
    at = order[np.argmax(gain[:, order], axis=1)]
    alpha, lam, rate = (np.repeat(x, k) for x in (fits.reg_alpha, fits.reg_lambda, fits.learning_rate))

    def value(g, h):
        return np.where(h > 0, -soft(g, alpha) / np.maximum(h + lam, 1e-300) * rate, 0.0)

    node, unit = np.meshgrid(np.arange(len(sums)), np.arange(model.units), indexing="ij")
    g, h = sums[:, 0, -1], sums[:, 1, -1]
    gr, hr = sums[node, 0, at, unit], sums[node, 1, at, unit]
    return pd.DataFrame({"node": node.ravel(), "unit": unit.ravel(), "feature": (at % model.features).ravel(),
                         "cut": (at // model.features + 1).ravel(), "gain": gain[node, at, unit].ravel(), "own": value(g, h).ravel(),
                         "left": value(g - gr, h - hr).ravel(), "right": value(gr, hr).ravel()})


SPLIT = "node int, unit int, feature int, cut int, gain double, own double, left double, right double"


def level_sums(work: DataFrame, model: Model, r: int, level: int, chunk: int) -> DataFrame:
    """(chunk, sums) of one level: one row a chunk of fits, added up over all blocks.

    A task adds up all its blocks for a group of chunks whose sums fit in ``HELD_BYTES``.  What is sent is the number of tasks
    times these, however many blocks there are.
    """
    n = len(model.fits.fold)
    chunks = -(-n // chunk)
    shared = work.sparkSession.sparkContext.broadcast([model.some(c * chunk, min(n, (c + 1) * chunk)) for c in range(chunks)])
    features = model.features
    size = 8 * 2 ** level * 2 * (CUTS * features + 1) * min(n, chunk) * model.classes
    groups = -(-chunks // max(1, HELD_BYTES // size))

    def run(group: int):
        def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext
            held: dict[int, np.ndarray] = {}
            for pdf in batches:
                for row in pdf.itertuples():
                    b = _block(row, features)
                    for c in range(group, chunks, groups):
                        s = histogram(shared.value[c], b, r, level)
                        if c in held:
                            held[c] += s
                        else:
                            held[c] = s
            for c in list(held):
                yield pd.DataFrame({"chunk": [c], "salt": [TaskContext.get().partitionId() // groups], "sums": [held.pop(c).tobytes()]})
        return some

    def add(g: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(g["sums"].iloc[0]).copy()
        for s in g["sums"].iloc[1:]:
            total += np.frombuffer(s)
        return pd.DataFrame({"chunk": [g["chunk"].iloc[0]], "sums": [total.tobytes()]})

    each = _dealt(work, groups, run, "chunk int, salt int, sums binary")
    if _parts(work, groups) > 8:
        salt = F.floor(F.sqrt(F.col("salt").cast("double"))).cast("int")  # about 2 * sqrt(tasks) rows a group
        each = each.groupBy("chunk", salt.alias("salt")).applyInPandas(add, "chunk int, sums binary")
    return each.groupBy("chunk").applyInPandas(add, "chunk int, sums binary")


def _choose(model: Model, kind: np.ndarray, r: int, level: int, chunk: int, slice_fits: int, min_child: float):
    """The function that finds the best splits of all fits of a chunk of kinds."""
    fits, k, features, depth = model.fits, model.classes, model.features, model.depth

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            for c, raw in zip(g["chunk"].tolist(), g["sums"]):
                sums = np.frombuffer(raw).reshape(2 ** level, 2, CUTS * features + 1, -1, k)
                mine = np.flatnonzero(kind // chunk == c)
                for a in range(0, len(mine), slice_fits):
                    rows = mine[a: a + slice_fits]
                    own = sums[:, :, :, kind[rows] - c * chunk].reshape(*sums.shape[:3], -1)
                    found = best(own, Model(fits.some(rows), k, features, depth), r, min_child)
                    found["unit"] = rows[found["unit"] // k] * k + found["unit"] % k
                    yield found

    return run


def train(work: DataFrame, fits: Fits, classes: int, features: int, rounds: int, depth: int, min_child: float = 1.0,
          chunk: int = 48) -> Model:
    """Grows ``rounds`` trees a class for every fit; one job a level."""
    model = Model(fits, classes, features, depth)
    for r in range(rounds):
        model.grow()
        for level in range(depth):
            first, kind = model.distinct(r)
            part = max(1, min(chunk, -(-len(first) // 64)))  # few kinds still occupy many tasks
            got = (level_sums(work, model.pick(first), r, level, part)
                   .mapInPandas(_choose(model, kind, r, level, part, chunk, min_child), SPLIT).toPandas())
            node, unit = got["node"].to_numpy() + 2 ** level - 1, got["unit"].to_numpy()
            alive = np.ones(len(got), dtype=bool)
            if level:
                up = (node - 1) // 2
                alive = model.feature[r][unit, up] >= 0
            else:
                model.value[r][unit, 0] = got["own"]
            split = alive & (got["gain"].to_numpy() > np.repeat(fits.gamma, classes)[unit])
            u, v = unit[split], node[split]
            model.feature[r][u, v] = got["feature"].to_numpy()[split]
            model.cut[r][u, v] = got["cut"].to_numpy()[split]
            model.value[r][u, 2 * v + 1] = got["left"].to_numpy()[split]
            model.value[r][u, 2 * v + 2] = got["right"].to_numpy()[split]
    return model


def held_out_counts(work: DataFrame, model: Model, chunk: int = 48) -> DataFrame:
    """(fit, y, p, n): predictions of the documents of each fit's own fold."""
    spark = work.sparkSession
    first, kind = model.distinct()
    n, k, features = len(first), model.classes, model.features
    shared = spark.sparkContext.broadcast(model.pick(first))
    chunks = -(-n // chunk)
    groups = min(chunks, work.agg(F.max("copies")).first()[0] or 1)

    def run(group: int):
        def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[int, np.ndarray] = {}  # counts by fit, y and p: bounded by the grid
            for pdf in batches:
                for row in pdf.itertuples():
                    b = _block(row, features)
                    for c in range(group, chunks, groups):
                        low, high = c * chunk, min(n, (c + 1) * chunk)
                        part = shared.value.some(low, high)
                        p = part.margins(b.bins, len(part.value)).reshape(len(b.y), -1, k).argmax(axis=2)
                        doc, fit = np.nonzero(b.fold[:, None] == part.fits.fold)
                        cells = np.bincount((fit * k + b.y[doc]) * k + p[doc, fit], minlength=(high - low) * k * k)
                        held[c] = held[c] + cells if c in held else cells
            for c, cells in held.items():
                at = np.flatnonzero(cells)
                yield pd.DataFrame({"kind": at // (k * k) + c * chunk, "y": at // k % k, "p": at % k, "n": cells[at]})
        return some

    cells = _dealt(work, groups, run, "kind int, y int, p int, n long")
    names = spark.createDataFrame(pd.DataFrame({"kind": kind, "fit": np.arange(len(kind))}), "kind int, fit int")  # one row a fit
    return cells.groupBy("kind", "y", "p").agg(F.sum("n").alias("n")).join(F.broadcast(names), "kind").select("fit", "y", "p", "n")


def predict(work: DataFrame, model: Model) -> DataFrame:
    """(doc_id, p, margins) of every document by a model of one fit."""
    shared = work.sparkSession.sparkContext.broadcast(model)
    features = model.features

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                b = _block(row, features)
                m = shared.value.margins(b.bins, len(shared.value.value))
                yield pd.DataFrame({"doc_id": b.ids, "p": m.argmax(axis=1), "margins": list(m)})

    return work.select("ids", "y", "fold", "h", "bins").mapInPandas(run, "doc_id long, p int, margins array<double>")
