"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: character 1- to 3-grams of the lower-cased text (runs of other
characters than letters become one space), hashed into ``2**bits`` places; weight
(1 + ln tf) * idf, scaled to unit length.  Document frequencies are counted over every
learning document.

Training: follow-the-regularised-leader (proximal) with elastic-net penalties.  A
bounded sample is dealt to a fixed number of shards; every round each shard runs over its
documents from the common state, then the states are averaged.  The first penalty keeps
most weights at exactly zero.  A temperature is calibrated on sampled documents that were kept
out of training.

Bounds: the weights are fitted on about ``sample`` learning documents (all with a row
hash below a limit set from their number); the model is a table of ``2**bits``
rows by learned languages.  Counts and predictions cover every document.

Defined cases: a null text or one without a letter is ``und`` with score 0;
a null ``doc_id`` is predicted like any other and, its checksum being null, learned from; rows
without a language are never learned from; with one learned language that
one is predicted; without any, every row is ``und``; repeated rows are rows of
their own; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import texts_of
from quillmark.session import stage

NOT_LETTERS = re.compile(r"[\W\d_]+")
GRAMS = 3


class Grams:
    """Hashed n-gram counts of one text at a time."""

    def __init__(self, bits: int):
        self.size, self.shift = 1 << bits, np.uint32(32 - bits)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(places, counts); nothing for a text without letters."""
        clean = NOT_LETTERS.sub(" ", text.lower()).strip()
        if not clean:
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        c = np.frombuffer(f" {clean} ".encode("utf-32-le"), dtype=np.uint32)
        h = np.zeros(len(c), dtype=np.uint32)
        every = []
        for k in range(min(GRAMS, len(c))):
            h = (h[: len(c) - k] * np.uint32(0x85EBCA6B) + c[k:] + np.uint32(k + 1)) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            every.append((h * np.uint32(0xC2B2AE35)) >> self.shift)
        flat = np.concatenate(every)
        if len(flat) * 8 < self.size:
            return np.unique(flat, return_counts=True)
        counts = np.bincount(flat, minlength=self.size)
        at = np.flatnonzero(counts)
        return at, counts[at]


def _weighted(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    return x / max(math.sqrt(float(x @ x)), 1e-12)


def _learning(docs: DataFrame, learn: Column) -> DataFrame:
    return docs.where(F.coalesce(learn, F.lit(True)) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def document_frequencies(docs: DataFrame, bits: int) -> np.ndarray:
    """Number of learning documents per feature, counted over all of them; ``2**bits`` sums reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total = Grams(bits), np.zeros(1 << bits, dtype=np.int64)
        for b in batches:
            for t in b.column("text").to_pylist():
                total[grams(t)[0]] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())],
                                         names=["at", "df"])

    sums = docs.select("text").mapInArrow(run, "at int, df long").groupBy("at").agg(F.sum("df").alias("df"))
    got = sums.toPandas()
    out = np.zeros(1 << bits, dtype=np.int64)
    out[got["at"].to_numpy(dtype=np.int64)] = got["df"].to_numpy()
    return out


class Leader:
    """State of follow-the-regularised-leader: z and n per feature and language; weights follow from both."""

    def __init__(self, size: int, languages: int, alpha: float, beta: float, l1: float, l2: float):
        self.z = np.zeros((size, languages))
        self.n = np.zeros((size, languages))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax((x @ w)[None, :])[0]
        p[y] -= 1
        g = x[:, None] * p[None, :]
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def temperature(scores: np.ndarray, truth: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section on its logarithm.

    The targets are smoothed by one pseudo-count a language, so a sample without an error
    does not make every prediction certain.
    """
    n, k = scores.shape
    target = np.full((n, k), 1 / (n + k))
    target[np.arange(n), truth] = (n + 1) / (n + k)

    def loss(t: float) -> float:
        p = softmax(scores / math.exp(t))
        return float(-(target * np.log(np.maximum(p, 1e-300))).sum() / n)

    low, high, r = math.log(0.02), math.log(20), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - r * (high - low), low + r * (high - low)
        if loss(a) < loss(b):
            high = b
        else:
            low = a
    return math.exp((low + high) / 2)


class Model:
    def __init__(self, languages: list[str], bits: int, idf: np.ndarray, weights: np.ndarray, heat: float):
        self.languages, self.grams, self.idf, self.heat = languages, Grams(bits), idf, heat
        self.weights = weights

    def __call__(self, text: str | None) -> tuple[str, float]:
        at, counts = self.grams(text or "")
        if not len(at) or not self.languages:
            return "und", 0.0
        s = _weighted(at, counts, self.idf) @ self.weights[at]
        p = softmax(s[None, :] / self.heat)[0]
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def sample_rates(counts: dict[str, int], sample: int) -> dict[str, float]:
    """Share of each language's rows that enters the sample: half of it by the languages' sizes, half the same for each."""
    total = sum(counts.values())
    return {x: min(1.0, sample / 2 / total + sample / 2 / len(counts) / n) for x, n in counts.items()}


def train(docs: DataFrame, learn: Column, bits: int = 16, sample: int = 12_000, shard_rows: int = 1200,
          rounds: int = 3, updates: int = 1200, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02,
          l2: float = 0.02) -> Model:
    """Model from the rows of ``docs`` (doc_id, text, lang) for which ``learn`` is true or null.

    The sample is dealt to shards of about ``shard_rows``; a shard makes at least ``updates`` steps a round,
    passing over its rows as often as that takes.
    """
    known = _learning(texts_of(docs, "doc_id", F.col("text").cast("string"), F.col("lang").cast("string"), learn.alias("_learn")),
                      F.col("_learn")).drop("_learn")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(counts)
    total = sum(counts.values())
    df = document_frequencies(known, bits)
    idf = np.log((total + 1) / (df + 1)) + 1
    if len(languages) < 2:
        return Model(languages, bits, idf, np.zeros((1 << bits, len(languages))), 1.0)
    # a row enters by its own hash, so copies of a text enter one by one
    place = F.shiftrightunsigned(F.xxhash64(F.lit(3), "doc_id", "text"), 32)
    limits = F.create_map(*[x for lang, rate in sample_rates(counts, sample).items()
                            for x in (F.lit(lang), F.lit(int(rate * 2**32)).cast("long"))])
    some = known.withColumn("_place", place).where(F.col("_place") < limits[F.col("lang")])
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    index = {x: k for k, x in enumerate(languages)}

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams(bits)
        for b in batches:
            got = [grams(t) for t in b["text"]]
            yield pd.DataFrame({"place": b["_place"], "y": b["lang"].map(index), "at": [a for a, _ in got],
                                "x": [_weighted(a, c, shared.value) for a, c in got]})

    rows = stage(some.mapInPandas(vectors, "place long, y int, at array<int>, x array<float>")
                 .where("size(at) > 0"), "language_sample")
    shape = (1 << bits, len(languages))
    state = Leader(*shape, alpha, beta, l1, l2)
    shards = max(1, round(rows.count() / shard_rows))
    part = F.pmod("place", F.lit(10))  # the last tenth calibrates
    shard = F.when(part == 9, shards).otherwise(F.pmod(F.floor(F.col("place") / 10), F.lit(shards))).cast("int")

    for _ in range(rounds):
        given = docs.sparkSession.sparkContext.broadcast(state)

        def run(group: pd.DataFrame) -> pd.DataFrame:
            own = Leader(*shape, alpha, beta, l1, l2)
            own.z, own.n = given.value.z.copy(), given.value.n.copy()
            group = group.sort_values(["place", "y"])
            given_rows = [(np.asarray(a, dtype=np.int64), np.asarray(x, dtype=float), y)
                          for a, x, y in zip(group["at"], group["x"], group["y"])]
            for _ in range(-(-updates // len(given_rows))):
                for row in given_rows:
                    own.learn(*row)
            used = np.flatnonzero(own.n.any(axis=1))
            return pd.DataFrame({"at": used, "z": list(own.z[used]), "n": list(own.n[used])})

        learned = (rows.withColumn("shard", shard).where(F.col("shard") < shards).groupBy("shard")
                   .applyInPandas(run, "at int, z array<double>, n array<double>"))
        names = [f"{c}{k}" for c in "zn" for k in range(len(languages))]
        mean = learned.groupBy("at").agg(*[F.sum(F.col(c[0])[int(c[1:])]).alias(c) for c in names]).toPandas()
        used = rows.select(shard.alias("s")).where(F.col("s") < shards).distinct().count()
        at = mean["at"].to_numpy(dtype=np.int64)
        state = Leader(*shape, alpha, beta, l1, l2)
        state.z[at] = mean[names[: len(languages)]].to_numpy() / max(used, 1)
        state.n[at] = mean[names[len(languages):]].to_numpy() / max(used, 1)
    weights = state.weights()
    final = docs.sparkSession.sparkContext.broadcast(weights)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "s": [np.asarray(x, dtype=float) @ final.value[np.asarray(a, dtype=np.int64)]
                                                   for a, x in zip(b["at"], b["x"])]})

    held = rows.where(shard == shards).select("y", "at", "x").mapInPandas(scored, "y int, s array<double>").toPandas()
    heat = temperature(np.stack(held["s"].to_numpy()), held["y"].to_numpy()) if len(held) else 1.0
    return Model(languages, bits, idf, weights, heat)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``lang_pred`` and ``score``; only the text is read for it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def best(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value(t) for t in texts], columns=["lang_pred", "score"])

    return docs.withColumn("_p", best(F.col("text").cast("string"))).select(
        *docs.columns, F.col("_p.lang_pred"), F.col("_p.score"))


def identify(docs: DataFrame, folds: int = 4, held: int = 2, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; held-out ones are never learned from."""
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == held
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    model = train(docs.select("doc_id", "text", "lang"), ~held_out, **options)
    return predict(rows, model).drop("text")
