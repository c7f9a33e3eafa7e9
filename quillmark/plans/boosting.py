"""Registered queries of the boosted trees (J5, J6, J7) on document text.

Task: ``documents.lang`` from TF-IDF weights of the terms that at least 5 % of the fit
documents hold.  The whole grid is searched over five folds; the best point is fitted
again on all fit documents and predicts the test documents.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmark.functions.numeric import round_sig, sql_round_sig
from quillmark.operators import boosting as bo
from quillmark.operators import dataset as ds
from quillmark.operators import evaluate as ev
from quillmark.operators import text as tx
from quillmark.plans import text as tp
from quillmark.session import drop_stage, stage
from quillmark.sources import ingest as ing

# The grid of the boosted trees.
GRID = {
    "learning_rate": [0.01, 0.05, 0.1, 0.2, 0.5, 1],
    "gamma": [0.1, 0.5, 1],
    "reg_alpha": [0.1, 0.5, 1],
    "reg_lambda": [0.1, 0.5, 1],
    "subsample": [0.5, 0.7, 0.9],
    "colsample_bytree": [0.5, 0.7, 0.9],
}
MIN_SHARE, MAX_SHARE = 0.05, 0.5
FOLDS = 5
ROUNDS, DEPTH = 3, 2       # trees a class and their depth in the search
FINAL_ROUNDS = 20          # trees a class of the refitted model
FIRST = {"learning_rate": 1.0, "gamma": 0.5, "reg_alpha": 0.5, "reg_lambda": 0.5, "subsample": 1.0, "colsample_bytree": 1.0}


class Data:
    """Blocks of the fit and test documents, the classes and the features."""

    def __init__(self, spark, sf, copies: int = 1):
        fit, test = tp._fit_apply(spark, sf)
        terms = stage(tx.doc_terms(fit, stop_words=tx.STOP_WORDS), "boost_terms")
        n = tp._n(fit)
        idf = tx.idf_table(terms, n, max_df=MAX_SHARE)
        often = tx.document_frequency(terms).where(F.col("df") >= MIN_SHARE * n).select("term")
        idf = stage(idf.join(often, "term"), "boost_idf")

        def weights(found):
            return tx.tfidf(found, idf).select("doc_id", "term", round_sig(F.col("weight"), 10).alias("weight"))

        cells = stage(weights(terms), "boost_cells")
        drop_stage(terms)
        self.cuts = stage(bo.cuts_of(cells), "boost_cuts")
        self.features = self.cuts.count()
        self.classes = sorted(r["lang"] for r in fit.select("lang").distinct().collect())  # a handful
        code = F.array_position(F.array(*[F.lit(c) for c in self.classes]), F.col("lang")) - 1
        folds = ds.stratified_folds(fit.select("doc_id", "lang"), "doc_id", "lang", FOLDS)
        self.fit = bo.blocks(folds.select("doc_id", code.alias("y"), "fold"), bo.binned(cells, self.cuts), self.features, copies=copies)
        drop_stage(cells)
        self.test_docs = test.select("doc_id", "lang", code.alias("y"))
        self._test_cells = lambda: bo.binned(weights(tx.doc_terms(test, stop_words=tx.STOP_WORDS)), self.cuts)

    def test(self):
        return bo.blocks(self.test_docs.withColumn("fold", F.lit(0)), self._test_cells(), self.features)

    def train(self, fits, rounds):
        return bo.train(self.fit, fits, len(self.classes), self.features, rounds, DEPTH)


def _searched(data: Data, grid=None):
    """(fit columns, mean_f1, rank) of every grid point, best first."""
    grid_points = bo.points(grid or GRID)
    model = data.train(bo.fits_of(grid_points, list(range(FOLDS))), ROUNDS)
    f1 = ev.weighted_f1(bo.held_out_counts(data.fit, model), ["fit"])
    mean = f1.groupBy(F.floor(F.col("fit") / FOLDS).cast("int").alias("point")).agg(round_sig(F.avg("f1"), 9).alias("mean_f1"))
    spark = data.fit.sparkSession
    rows = spark.createDataFrame([(i, *p.values()) for i, p in enumerate(grid_points)],
                                 "point int, " + ", ".join(f"{c} double" for c in grid_points[0]))
    # one row a grid point
    rank = F.row_number().over(Window.orderBy(F.desc("mean_f1"), "point")).cast("int")
    return rows.join(mean, "point").withColumn("rank", rank)


def _copies(spark):
    return spark.sparkContext.defaultParallelism


def _grid(spark, sf, data=None):
    """The searched grid; kept for the application, so that the refit does not search again."""
    inputs = [f"{sf.rstrip('/')}/documents.parquet"]
    return ing.kept(spark, "gbt_grid", inputs, (GRID, ROUNDS, DEPTH, FOLDS, MIN_SHARE, MAX_SHARE),
                    lambda: _searched(data or Data(spark, sf, copies=_copies(spark))))


def q_gbt_grid(spark, sf):
    """Mean weighted F1 over five folds of every grid point, best first."""
    return _grid(spark, sf).drop("point")


def _refit(spark, sf):
    data = Data(spark, sf, copies=_copies(spark))
    top = _grid(spark, sf, data).where("rank = 1").first().asDict()
    return data, data.train(bo.fits_of([{c: top[c] for c in GRID}], [bo.NO_FOLD]), FINAL_ROUNDS)


def q_gbt_predict(spark, sf):
    """The best grid point fitted on all fit documents predicts the test documents; margins by class."""
    data, model = _refit(spark, sf)
    found = bo.predict(data.test(), model)
    names = F.array(*[F.lit(c) for c in data.classes])
    return found.join(data.test_docs, "doc_id").select(
        "doc_id", "lang", F.element_at(names, F.col("p") + 1).alias("pred"),
        F.transform("margins", lambda x: round_sig(x, 8)).alias("margins"))


def q_gbt_first_tree(spark, sf):
    """Gain of every admissible first split of each class, with the penalties of ``FIRST``."""
    data = Data(spark, sf)
    fits = bo.fits_of([FIRST], [bo.NO_FOLD])
    model = bo.Model(fits, len(data.classes), data.features, 1)
    model.grow()
    k, features = len(data.classes), data.features

    def run(g):
        import numpy as np
        import pandas as pd
        gain = bo.gains(np.frombuffer(g["sums"].iloc[0]).reshape(1, 2, bo.CUTS * features + 1, k).copy(), fits, k, 1.0)[0]
        at, unit = np.nonzero(np.isfinite(gain))
        return pd.DataFrame({"feature": at % features, "cut": at // features + 1, "y": unit, "gain": gain[at, unit]})

    found = (bo.level_sums(data.fit, model, 0, 0, 1).groupBy("chunk")
             .applyInPandas(run, "feature int, cut int, y int, gain double"))
    names = F.array(*[F.lit(c) for c in data.classes])
    return found.join(data.cuts, "feature").select(F.element_at(names, F.col("y") + 1).alias("label"), "term", "cut",
                                                   F.round("gain", 6).alias("gain"))


# ---------------------------------------------------------------- DuckDB oracles

def _first_tree_sql() -> str:
    a, lam = FIRST["reg_alpha"], FIRST["reg_lambda"]

    def score(g: str, h: str) -> str:
        return f"pow(greatest(abs({g}) - {a}, 0), 2) / ({h} + {lam})"

    return tp._with({
        **tp._base(),
        "ft": tp._terms_sql("fit", stop=True),
        "dfv": f"""SELECT term, count(*) AS df FROM ft GROUP BY term
                   HAVING count(*) >= {MIN_SHARE} * (SELECT n FROM nfit) AND count(*) <= {MAX_SHARE} * (SELECT n FROM nfit)""",
        "idf": "SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM dfv, nfit",
        "w0": "SELECT t.doc_id, t.term, t.tf * idf.idf AS w FROM ft t JOIN idf USING (term)",
        "w1": "SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS x FROM w0",
        "w": f"SELECT doc_id, term, {sql_round_sig('x', 10)} AS weight FROM w1",
        "med": "SELECT term, quantile_cont(weight, 0.5) AS median FROM w GROUP BY term",
        "bins": "SELECT doc_id, term, CASE WHEN weight > median THEN 2 ELSE 1 END AS bin FROM w JOIN med USING (term)",
        "cls": "SELECT lang AS label, count(*) AS own FROM fit GROUP BY lang",
        "k": "SELECT count(*) AS k FROM cls",
        "gh": "SELECT 1.0 / k AS p, greatest(2.0 / k * (1 - 1.0 / k), 1e-16) AS h FROM k",
        "cells": """SELECT b.term, c.cut, count(*) AS n, fit.lang AS lang FROM bins b JOIN fit USING (doc_id),
                    (VALUES (1), (2)) c(cut) WHERE b.bin >= c.cut GROUP BY ALL""",
        "sums": """SELECT c.term, c.cut, cls.label, sum(c.n) AS n, sum(CASE WHEN c.lang = cls.label THEN c.n ELSE 0 END) AS own
                   FROM cells c, cls GROUP BY ALL""",
        "g": """SELECT s.term, s.cut, s.label, s.n * p - s.own AS gr, s.n * h AS hr, nfit.n * p - cls.own AS g, nfit.n * h AS ht
                FROM sums s JOIN cls USING (label), gh, nfit""",
    }, f"""SELECT label, term, CAST(cut AS INTEGER) AS cut,
        round({score('g - gr', 'ht - hr')} + {score('gr', 'hr')} - {score('g', 'ht')}, 6) AS gain
        FROM g WHERE hr >= 1 AND ht - hr >= 1""")


QUERIES = {
    "q_gbt_grid": q_gbt_grid,
    "q_gbt_predict": q_gbt_predict,
    "q_gbt_first_tree": q_gbt_first_tree,
}

ORACLE = {"q_gbt_first_tree": _first_tree_sql()}
