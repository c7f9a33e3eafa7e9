"""Quality rules by an isolation forest on rule statistics.

Every document gets its rule statistics; a forest of random splits isolates
unusual rows in few steps, so a short mean path length marks an anomaly
(score = 2 ** (-mean path / expected path), near 1 for anomalies).  The
threshold on that score is calibrated from the labelled rows.

Defined cases: a null or empty text has zero words and fails the base rules;
a null or repeated ``doc_id`` is scored like any row (one output row per input
row); an id whose labels disagree, or with a null label, is left out of the
calibration; without usable labels of both kinds the threshold is ``None``
and only the base rules decide; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import WORDS, texts_of
from quillmark.session import stage

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
SHRINK = 25   # a short text's shares say little, so they shrink to 0
STEP = 0.1    # shares count in tenths: trivial amounts are no rule hits and must not look unusual
NO_SYMBOL = str.maketrans("", "", SYMBOLS)


def repeat_words(words: list[str]) -> int:
    """Words inside three-word windows that occur twice or more, first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[str, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), dtype=np.int64, count=n)
    pair = w[:-1] * len(ids) + w[1:]
    if len(ids) > 1_000_000:  # keeps the combined number inside 64 bits
        _, pair = np.unique(pair, return_inverse=True)
    tri = pair[:-1] * len(ids) + w[2:]
    order = np.argsort(tri, kind="stable")
    same = tri[order][1:] == tri[order][:-1]
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for i in range(3):
        covered[i: n - 2 + i] |= twice
    return int(covered.sum())


def rule_statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The five base numbers and the statistics the forest splits on."""
    text = text or ""
    words = WORDS.findall(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols = len(text) - len(text.translate(NO_SYMBOL))
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    dup = len(lines) - len(set(lines))
    repeat = repeat_words(words)
    upper = odd = plain = 0
    for w in words:
        upper += len(w) > 2 and w.isupper()
        core = w[:-1] if w[-1] in ".,;:?" else w
        plain += core.isalpha()
        odd += not (core and core[-1].isalpha())
    shares = [c / (n + SHRINK) for c in (symbols, upper, odd, n - plain)]
    stats = [STEP * math.floor(x / STEP) for x in shares]
    return [n, chars, symbols, dup, repeat], stats


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, base numbers, stats array, draw) of every row; ``draw`` is a hash of the row that ignores the statistics."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [rule_statistics(t) for t in b["text"]]
            out = pd.DataFrame([r[0] for r in rows], columns=[c.split()[0] for c in BASE.split(", ")], dtype="int64")
            out.insert(0, "doc_id", b["doc_id"].array)
            out["stats"] = [r[1] for r in rows]
            out["draw"] = b["draw"].array
            yield out

    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return texts_of(docs, doc_id, text, F.xxhash64(doc_id, text).alias("draw")).mapInPandas(
        run, f"doc_id long, {BASE}, stats array<double>, draw long")


def _path(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Forest:
    """Trees as flat arrays: feature, cut, children; leaves point to themselves and carry their path length."""

    def __init__(self, rows: np.ndarray, trees: int, sample: int, seed: int):
        rng = np.random.default_rng(seed)
        self.sample = max(2, min(sample, len(rows)))
        self.height = math.ceil(math.log2(self.sample))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.sample, replace=len(rows) < 2)], rng)
                      for _ in range(trees)]

    def _grow(self, rows: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, depth = [], [], [], [], []

        def node(x: np.ndarray, d: int) -> int:
            me = len(feature)
            feature.append(0)
            cut.append(0.0)
            left.append(me)
            right.append(me)
            depth.append(d + _path(len(x)))
            low, high = x.min(axis=0), x.max(axis=0)
            split = np.flatnonzero(high > low)
            if d < self.height and len(x) > 1 and len(split):
                f = int(rng.choice(split))
                c = float(rng.uniform(low[f], high[f]))
                feature[me], cut[me] = f, c
                left[me] = node(x[x[:, f] <= c], d + 1)
                right[me] = node(x[x[:, f] > c], d + 1)
            return me

        node(rows, 0)
        return tuple(np.array(v) for v in (feature, cut, left, right, depth))

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        at = np.arange(len(rows))
        for feature, cut, left, right, depth in self.trees:
            k = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.height):
                k = np.where(rows[at, feature[k]] <= cut[k], left[k], right[k])
            total += depth[k]
        return 2.0 ** (-total / len(self.trees) / _path(self.sample))


def fit(stats: DataFrame, trees: int = 100, sample: int = 256, seed: int = 7) -> Forest | None:
    """Forest over ``sample`` rows a tree.

    The trees draw from the ``trees * sample`` rows with the smallest hash of
    seed, id and text: a fixed bound whatever the table's size.  The hash
    does not depend on the statistics, so every vector enters with its share.
    """
    order = F.xxhash64(F.lit(seed), "draw")
    pool = stats.select("stats", "draw").orderBy(order, "draw").limit(trees * sample).select("stats").collect()
    rows = np.array([r[0] for r in pool], dtype=float)
    return Forest(rows, trees, sample, seed) if len(rows) else None


def score(stats: DataFrame, forest: Forest | None) -> DataFrame:
    """Adds ``anomaly`` (0 to 1)."""
    if forest is None:
        return stats.withColumn("anomaly", F.lit(0.0))
    shared = stats.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def anomaly(rows: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.stack(rows.to_numpy())) if len(rows) else [], dtype=float)

    return stats.withColumn("anomaly", anomaly("stats"))


def calibrate(scored: DataFrame, labels: DataFrame, max_false: float = 0.002, bins: int = 2000) -> float | None:
    """Threshold with the best balanced accuracy among those that reject at most ``max_false`` of the good rows.

    Works on a histogram of ``bins`` score steps by label, so what reaches the
    driver does not grow with the labelled rows.
    """
    known = (labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("doc_id is not null")
             .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("q2"))
             .where("quality = q2").drop("q2"))
    rows = (scored.select("doc_id", F.floor(F.col("anomaly") * bins).cast("int").alias("bin")).join(known, "doc_id")
            .groupBy("bin", "quality").count().collect())
    good, bad = np.zeros(bins + 1), np.zeros(bins + 1)
    for r in rows:
        (good if r["quality"] else bad)[r["bin"]] += r["count"]
    if not good.sum() or not bad.sum():
        return None
    false = good[::-1].cumsum()[::-1] / good.sum()  # share of good rows at or above each step
    caught = bad[::-1].cumsum()[::-1] / bad.sum()
    gain = np.where(false <= max_false, caught - false, -1.0)
    best = np.flatnonzero(gain == gain.max())
    return float(np.median(best[: np.argmax(np.diff(best, append=2 * bins) > 1) + 1])) / bins  # middle of the gap


def _failed(n_words, n_repeat_words):
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def train(docs: DataFrame, labels: DataFrame, trees: int = 100, sample: int = 256, seed: int = 7,
          max_false: float = 0.002) -> tuple[DataFrame, Forest | None, float | None]:
    """Scored rule statistics of every row, the forest and its threshold.

    Forest and threshold come from the rows that pass the base rules.
    """
    failed = _failed(F.col("n_words"), F.col("n_repeat_words"))
    stats = stage(statistics(docs).withColumn("base_failed", failed), "rule_statistics")
    forest = fit(stats.where("not base_failed"), trees, sample, seed)
    scored = score(stats, forest)
    return scored, forest, calibrate(scored.where("not base_failed"), labels, max_false)


def rate(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, base numbers, base_failed, anomaly, kept."""
    scored, _, cut = train(docs, labels, **options)
    verdict = F.lit(True) if cut is None else F.col("anomaly") < cut
    return scored.drop("stats", "draw").withColumn("kept", ~F.col("base_failed") & verdict)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that pass, all columns kept, judged in place by their text: no join back, so ids may repeat."""
    _, forest, cut = train(docs.select("doc_id", "text"), labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast((forest, cut))

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        rules, cut = shared.value
        rows = [rule_statistics(t) for t in texts]
        ok = np.array([not _failed(r[0][0], r[0][4]) for r in rows], dtype=bool)
        if cut is not None and len(rows):
            ok &= rules.score(np.array([r[1] for r in rows])) < cut
        return pd.Series(ok, dtype=bool)

    return docs.where(kept(F.col("text").cast("string")))
