"""Models saved as tables and scored in batches.

A model is a folder: one Parquet table for each part, then the table ``model`` (kind, class order, options), whose
``_SUCCESS`` file commits it.  The class order is data: scores are arrays in that order, and names come from it alone.

A *scorer* turns a loaded model and rows (row_id, the input column) into (row_id, logits).  Relational models score by
joins; models over vectors go through ``vector_logits``, where numpy code sees whole batches.  ``SCORERS`` maps a kind to
its scorer; further kinds are added there.

Defined cases: a row without any score (no known term, a null vector) gets zeros and so the first class; ties go to the
class that comes first in the model's order; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quillmark.operators import evaluate as ev
from quillmark.operators import models as md
from quillmark.operators import sketch_svm as sv
from quillmark.operators import text as tx


class Model(NamedTuple):
    kind: str
    classes: list[str]
    options: dict[str, str]
    tables: dict[str, DataFrame]


def save(model: Model, spark: SparkSession, path: str) -> None:
    for name, t in model.tables.items():
        t.write.mode("overwrite").parquet(f"{path}/{name}")
    row = [(model.kind, model.classes, model.options, sorted(model.tables))]
    about = spark.createDataFrame(row, "kind string, classes array<string>, options map<string, string>, tables array<string>")
    about.coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def load(spark: SparkSession, path: str) -> Model:
    r = spark.read.parquet(f"{path}/model").first()
    return Model(r["kind"], list(r["classes"]), dict(r["options"]), {t: spark.read.parquet(f"{path}/{t}") for t in r["tables"]})


# ----------------------------------------------------------------- fitting

def fit_cnb(docs: DataFrame, idf: DataFrame, alpha: float, norm: bool) -> Model:
    """Complement naive Bayes over TF-IDF of ``docs`` (doc_id, text, label): its idf and parameter tables."""
    train = tx.tfidf(tx.doc_terms(docs, stop_words=tx.STOP_WORDS), idf).join(docs.select("doc_id", "label"), "doc_id")
    classes = md.class_names(docs)
    params = md.cnb_logged(train.groupBy("label", "term").agg(F.sum("weight").alias("fc")), [], [alpha], classes)
    return Model("cnb", classes, {"norm": str(norm).lower()}, {"idf": idf, "params": params.drop("labels")})


def fit_centres(rows: DataFrame, vector: str = "vector", label: str = "label") -> Model:
    """Nearest class mean over vectors: one mean a class, classes in the order of their values."""
    cells = rows.where(F.col(label).isNotNull()).select(label, F.posexplode(vector).alias("i", "v"))
    means = cells.groupBy(label, "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    centres = means.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("i", "m")))["m"].alias("centre"))
    classes = [str(r[label]) for r in rows.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).collect()]
    return Model("centres", classes, {}, {"centres": centres.select(F.col(label).cast("string").alias("label"), "centre")})


def keep_svm(classes: list[str], idf: DataFrame, weights: np.ndarray, sketch: sv.Sketch) -> Model:
    """A trained machine of one degree as a model; ``weights`` (features, 1, classes), one row of the table a class."""
    rows = [(c, [float(x) for x in weights[:, 0, i]]) for i, c in enumerate(classes)]
    table = idf.sparkSession.createDataFrame(rows, "label string, w array<double>")
    options = {"degree": str(sketch.degrees[0]), "width": str(sketch.width), "gamma": repr(float(sketch.gamma))}
    return Model("svm", classes, options, {"idf": idf, "weights": table})


# ----------------------------------------------------------------- scoring

def _cnb(model: Model, rows: DataFrame) -> DataFrame:
    docs = rows.select(F.col("row_id").alias("doc_id"), F.col("input").alias("text"))
    cells = tx.tfidf(tx.doc_terms(docs, stop_words=tx.STOP_WORDS), model.tables["idf"])
    params = model.tables["params"].withColumn("labels", F.array(*[F.lit(c) for c in model.classes]))
    got = md.cnb_scores(cells, params, [], [model.options["norm"] == "true"], len(model.classes))
    return got.select(F.col("doc_id").alias("row_id"), "logits")


def vector_logits(rows: DataFrame, make: Callable, width: int, batch: int = 4096) -> DataFrame:
    """(row_id, logits) of vectors of ``width`` numbers; ``make()`` runs once a worker and returns (n, width) -> (n, classes)."""
    score = predict_batch_udf(make, return_type=ArrayType(DoubleType()), batch_size=batch, input_tensor_shapes=[[width]])
    known = rows.where(F.col("input").isNotNull())
    return known.select("row_id", score(F.col("input").cast("array<double>")).alias("logits"))


def _centres(model: Model, rows: DataFrame) -> DataFrame:
    """2 x . c - |c|^2: the class mean with the smallest distance scores highest."""
    at = {r["label"]: r["centre"] for r in model.tables["centres"].collect()}  # one vector a class
    c = np.array([at[x] for x in model.classes])

    def make():
        less = (c * c).sum(axis=1)
        return lambda x: 2 * x @ c.T - less

    return vector_logits(rows, make, c.shape[1])


def _svm(model: Model, rows: DataFrame) -> DataFrame:
    docs = rows.select(F.col("row_id").alias("doc_id"), F.col("input").alias("text"))
    cells = tx.tfidf(tx.doc_terms(docs, stop_words=tx.STOP_WORDS), model.tables["idf"])
    blank = [F.lit(0).alias("y"), F.lit(0).alias("fold"), F.lit(1.0).alias("w")]
    at = {r["label"]: r["w"] for r in model.tables["weights"].collect()}  # one array a class
    o = model.options
    w = np.array([at[c] for c in model.classes]).T[:, None, :]
    got = sv.predict(sv.rows_of(docs.select("doc_id", *blank), cells), [w], sv.Sketch([int(o["degree"])], int(o["width"]), float(o["gamma"])))
    return got.select(F.col("doc_id").alias("row_id"), F.col("scores").alias("logits"))


SCORERS: dict[str, Callable[[Model, DataFrame], DataFrame]] = {"cnb": _cnb, "centres": _centres, "svm": _svm}


def score(model: Model, rows: DataFrame) -> DataFrame:
    """(row_id, truth, logits, label_id, label) of ``rows`` (row_id, truth, input), one for each."""
    none = F.array(*[F.lit(0.0) for _ in model.classes])
    got = rows.select("row_id", F.col("truth").cast("string").alias("truth")).join(
        SCORERS[model.kind](model, rows.select("row_id", "input")), "row_id", "left").withColumn("logits", F.coalesce("logits", none))
    names = F.array(*[F.lit(c) for c in model.classes])
    at = ev.argmax("logits").cast("int")
    return got.select("row_id", "truth", "logits", at.alias("label_id"), F.element_at(names, at + 1).alias("label"))
