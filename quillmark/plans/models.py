"""Registered queries of the complement naive Bayes (J1, J2, J4, J6, J10) on document text.

Task: predict ``documents.lang`` from text.  Documents are split with the
exact stratified split; models are fit on train + val (S1) and scored on
test.  Predictions, logits, report and grid search have DuckDB oracles.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmark.functions.numeric import round_sig, sql_round_sig
from quillmark.operators import dataset as ds
from quillmark.operators import evaluate as ev
from quillmark.operators import models as md
from quillmark.operators import text as tx
from quillmark.plans import text as tp
from quillmark.session import stage

MIN_DF, MAX_DF = tp.MIN_DF, tp.MAX_DF


def _fit_test(spark, sf):
    fit, test = tp._fit_apply(spark, sf)
    return fit.withColumnRenamed("lang", "label"), test.withColumnRenamed("lang", "label")


def _idf(fit):
    return tx.idf_table(tx.doc_terms(fit, stop_words=tx.STOP_WORDS), tp._n(fit), min_df=MIN_DF, max_df=MAX_DF)


def _weights(df, idf):
    return tx.tfidf(tx.doc_terms(df, stop_words=tx.STOP_WORDS), idf)


def _cnb_logits(spark, sf, norm):
    """(doc_id, lang, labels, logits, pred) of every test document; one without any vocabulary term scores 0 everywhere."""
    fit, test = _fit_test(spark, sf)
    idf = stage(_idf(fit), "idf")
    # terms are counted again rather than written: they are several times the text, and counted they lie by document
    train = _weights(fit, idf).join(fit.select("doc_id", "label"), "doc_id")
    classes = md.class_names(fit)
    pred = md.cnb_sql(train, _weights(test, idf), alpha=1.0, norm=norm, classes=classes)
    return test.select("doc_id", F.col("label").alias("lang")).join(pred, "doc_id", "left").select(
        "doc_id", "lang", F.array(*[F.lit(c) for c in classes]).alias("labels"),
        F.coalesce("logits", F.array(*[F.lit(0.0) for _ in classes])).alias("logits"),
        F.coalesce("pred", F.lit(classes[0])).alias("pred"))


def _cnb(spark, sf, norm):
    return _cnb_logits(spark, sf, norm).select("doc_id", "lang", "pred")


def q_batch_score(spark, sf):
    """Logits per row and class, predicted class id and name, keyed by (model, field, dataset, row)."""
    d = _cnb_logits(spark, sf, norm=False)
    return d.select(F.lit("cnb").alias("model"), F.lit("text").alias("field"), F.lit("test").alias("dataset"),
                    F.col("doc_id").alias("row_id"), F.transform("logits", lambda x: round_sig(x, 8)).alias("logits"),
                    ev.argmax("logits").cast("int").alias("label_id"), F.col("pred").alias("label"))


def _cnb_report(spark, sf):
    ct = ev.contingency(_cnb(spark, sf, norm=False), "lang", "pred")
    return _rounded(ev.report(ct))


def _rounded(rep):
    return rep.select("class", *[round_sig(F.col(c), 9).alias(c) for c in ("precision", "recall", "f1")], "support")


def q_cnb_report(spark, sf):
    """K2 on a model's predictions: report of the relational complement NB."""
    return _cnb_report(spark, sf)


def _folded(spark, sf):
    fit, _ = _fit_test(spark, sf)
    w = _weights(fit, stage(_idf(fit), "idf"))
    folds = ds.stratified_folds(fit.select("doc_id", "label"), "doc_id", "label", md.N_FOLDS)
    return folds, w.join(folds, "doc_id")


def q_folds(spark, sf):
    """Documents per fold and class."""
    folds, _ = _folded(spark, sf)
    return folds.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"))


def q_cnb_grid(spark, sf):
    """Mean weighted F1 over five folds for every alpha and norm, best first."""
    _, train = _folded(spark, sf)
    pred = md.cnb_grid(stage(train, "cnb_folds"))
    by = ["alpha", "norm", "fold"]
    cells = pred.groupBy(*by, "label", "pred").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    rows = cells.select(*by, F.explode(F.array(
        F.struct(F.col("label").alias("c"), F.col("n").alias("sup"), F.lit(0).cast("bigint").alias("prd"), hit.alias("tp")),
        F.struct(F.col("pred").alias("c"), F.lit(0).cast("bigint").alias("sup"), F.col("n").alias("prd"),
                 F.lit(0).cast("bigint").alias("tp")))).alias("x")).select(*by, "x.*")
    per = rows.groupBy(*by, "c").agg(*[F.sum(c).alias(c) for c in ("sup", "prd", "tp")])
    f1 = per.groupBy(*by).agg((F.sum(2 * F.col("tp") / (F.col("sup") + F.col("prd")) * F.col("sup")) / F.sum("sup")).alias("f1"))
    mean = f1.groupBy("alpha", "norm").agg(round_sig(F.avg("f1"), 9).alias("mean_f1"))
    # one row per grid point
    rank = F.row_number().over(Window.orderBy(F.desc("mean_f1"), "alpha", "norm"))
    return mean.withColumn("rank", rank.cast("int"))


def q_cnb_sql(spark, sf):
    return _cnb(spark, sf, norm=False)


def q_cnb_sql_norm(spark, sf):
    return _cnb(spark, sf, norm=True)


def vectors(spark, sf):
    """Fit / test DataFrames with label index ``y``, weights ``w``, folds and TF-IDF ``features``."""
    fit, test = _fit_test(spark, sf)
    vec = md.tfidf_vectorizer(stage(_idf(fit), "idf")).fit(fit.limit(0).withColumn("tokens", tx.tokens("text")))
    enc = md.label_encoder("label", "y").fit(fit)
    def featured(docs):
        # cut before the folds' exchange: texts, tokens and counts are several times the vectors
        rows = vec.transform(enc.transform(md.with_tokens(tx.spread(docs))))
        return rows.select("doc_id", "label", "split", "y", "features")

    f = md.balanced_weights(featured(fit), "y", "w")
    f = ds.stratified_folds(f, "doc_id", "label", md.N_FOLDS)
    return f, featured(test), enc


def _report(spark, pred, enc):
    dec = md.label_decoder(enc, "prediction", "pred_label").transform(pred)
    ct = ev.contingency(dec, "label", "pred_label")
    return ev.report(ct)


def q_cnb_mllib(spark, sf):
    f, t, enc = vectors(spark, sf)
    m = md.cnb_mllib(1.0).fit(f)
    return _rounded(_report(spark, m.transform(t), enc))


# ---------------------------------------------------------------- DuckDB oracles

def _weight_ctes() -> dict:
    return {
        **tp._base(),
        "fit_terms": tp._terms_sql("fit", stop=True),
        "dfv": f"""SELECT term, count(*) AS df FROM fit_terms GROUP BY term
                   HAVING count(*) >= {MIN_DF} AND count(*) <= {MAX_DF!r} * (SELECT n FROM nfit)""",
        "idf": "SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM dfv, nfit",
        "wf0": "SELECT t.doc_id, t.term, t.tf * idf.idf AS w FROM fit_terms t JOIN idf USING (term)",
        "wf": "SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM wf0",
    }


def _cnb_ctes(norm: bool) -> dict:
    lp = "logged / sum(logged) OVER (PARTITION BY label)" if norm else "-logged"
    return {
        **_weight_ctes(),
        "wt0": "SELECT t.doc_id, t.term, t.tf * idf.idf AS w FROM (" + tp._terms_sql("tst", stop=True)
               + ") t JOIN idf USING (term)",
        "wt": "SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM wt0",
        "tr": "SELECT wf.*, fit.lang AS label FROM wf JOIN fit USING (doc_id)",
        "fc": "SELECT label, term, sum(weight) AS fc FROM tr GROUP BY label, term",
        "cls": "SELECT DISTINCT lang AS label FROM fit",
        "fullp": """SELECT v.term, c.label, coalesce(fc.fc, 0.0) AS fc FROM (SELECT DISTINCT term FROM tr) v, cls c
                   LEFT JOIN fc ON fc.label = c.label AND fc.term = v.term""",
        "comp": "SELECT *, sum(fc) OVER (PARTITION BY term) - fc + 1.0 AS comp FROM fullp",
        "lg": "SELECT label, term, ln(comp / sum(comp) OVER (PARTITION BY label)) AS logged FROM comp",
        "params": f"SELECT label, term, {lp} AS lp FROM lg",
        "sc": "SELECT wt.doc_id, p.label, sum(wt.weight * p.lp) AS jll FROM wt JOIN params p USING (term) GROUP BY ALL",
        "allc": "SELECT d.doc_id, d.lang, c.label FROM tst d, cls c",
        "sc2": "SELECT a.doc_id, a.lang, a.label, coalesce(sc.jll, 0.0) AS jll FROM allc a LEFT JOIN sc USING (doc_id, label)",
        "best": """SELECT doc_id, lang, label AS pred FROM (SELECT *, row_number() OVER (PARTITION BY doc_id
                   ORDER BY jll DESC, label) AS r FROM sc2) WHERE r = 1""",
    }


def _cnb_sql_text(norm: bool) -> str:
    return tp._with(_cnb_ctes(norm), "SELECT doc_id, lang, pred FROM best")


def _batch_sql() -> str:
    return tp._with(_cnb_ctes(False), f"""SELECT 'cnb' AS model, 'text' AS field, 'test' AS dataset, s.doc_id AS row_id,
        list({sql_round_sig('s.jll', 8)} ORDER BY s.label) AS logits,
        CAST((SELECT count(*) FROM cls c WHERE c.label < any_value(b.pred)) AS INTEGER) AS label_id, any_value(b.pred) AS label
        FROM sc2 s JOIN best b USING (doc_id) GROUP BY s.doc_id""")


def report_ctes() -> dict:
    """Per-class counts and scores of a table ``best`` (lang, pred)."""
    return {
        "cell": "SELECT lang AS y, pred AS p, count(*) AS n FROM best GROUP BY ALL",
        "pc": """SELECT c, sum(sup) AS support, sum(prd) AS predicted, sum(tp) AS tp FROM (
                 SELECT y AS c, n AS sup, 0 AS prd, CASE WHEN y = p THEN n ELSE 0 END AS tp FROM cell
                 UNION ALL SELECT p, 0, n, 0 FROM cell) GROUP BY c""",
        "st": """SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS pr,
                 CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS rc,
                 CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2 * tp / (support + predicted) END AS f FROM pc""",
    }


def _rounded_sql(e: str) -> str:
    return sql_round_sig(e, 9)


REPORT_ROWS = f"""SELECT CAST(c AS VARCHAR) AS class, {_rounded_sql('pr')} AS precision, {_rounded_sql('rc')} AS recall, {_rounded_sql('f')} AS f1,
        CAST(support AS BIGINT) AS support FROM st
        UNION ALL SELECT 'accuracy', NULL, NULL, {_rounded_sql('sum(tp) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM st
        UNION ALL SELECT 'macro avg', {_rounded_sql('avg(pr)')}, {_rounded_sql('avg(rc)')}, {_rounded_sql('avg(f)')}, CAST(sum(support) AS BIGINT) FROM st
        UNION ALL SELECT 'weighted avg', {_rounded_sql('sum(pr * support) / sum(support)')}, {_rounded_sql('sum(rc * support) / sum(support)')},
        {_rounded_sql('sum(f * support) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM st"""


def _report_sql() -> str:
    return tp._with({**_cnb_ctes(False), **report_ctes()}, REPORT_ROWS)


_FOLDS = f"""SELECT doc_id, lang AS label, CAST((row_number() OVER (PARTITION BY lang
    ORDER BY md5('{ds.SEED}|' || CAST(doc_id AS VARCHAR)), doc_id) - 1) % {md.N_FOLDS} AS INTEGER) AS fold FROM fit"""


def _grid_sql() -> str:
    alphas = ", ".join(f"({float(a)!r})" for a in md.CNB_ALPHA)
    return tp._with({
        **_weight_ctes(),
        "fl": _FOLDS,
        "tr": "SELECT wf.*, fl.label, fl.fold FROM wf JOIN fl USING (doc_id)",
        "own": "SELECT fold, label, term, sum(weight) AS f FROM tr GROUP BY ALL",
        "evr": "SELECT label, term, sum(f) AS a FROM own GROUP BY ALL",
        "fcx": """SELECT k.fold, v.term, c.label, coalesce(evr.a, 0.0) - coalesce(own.f, 0.0) AS fc
                  FROM (SELECT DISTINCT fold FROM tr) k CROSS JOIN (SELECT DISTINCT term FROM tr) v
                  CROSS JOIN (SELECT DISTINCT label FROM tr) c LEFT JOIN evr ON evr.term = v.term AND evr.label = c.label
                  LEFT JOIN own ON own.fold = k.fold AND own.term = v.term AND own.label = c.label""",
        "al": f"SELECT CAST(alpha AS DOUBLE) AS alpha FROM (VALUES {alphas}) x(alpha)",
        "cmp": "SELECT fold, alpha, term, label, sum(fc) OVER (PARTITION BY fold, alpha, term) - fc + alpha AS comp FROM fcx, al",
        "lg": "SELECT *, ln(comp / sum(comp) OVER (PARTITION BY fold, alpha, label)) AS logged FROM cmp",
        "pr": "SELECT *, sum(logged) OVER (PARTITION BY fold, alpha, label) AS tot FROM lg",
        "sc": """SELECT tr.fold, tr.doc_id, tr.label AS truth, p.alpha, p.label, sum(tr.weight * p.logged) AS s,
                 any_value(p.tot) AS tot FROM tr JOIN pr p ON p.fold = tr.fold AND p.term = tr.term GROUP BY ALL""",
        "lo": "SELECT *, CASE WHEN norm THEN s / tot ELSE -s END AS jll FROM sc, (VALUES (true), (false)) n(norm)",
        "pd": """SELECT fold, alpha, norm, truth, label AS pred FROM (SELECT *, row_number() OVER (
                 PARTITION BY fold, alpha, norm, doc_id ORDER BY jll DESC, label) AS r FROM lo) WHERE r = 1""",
        "cell": "SELECT fold, alpha, norm, truth AS y, pred AS p, count(*) AS n FROM pd GROUP BY ALL",
        "pc": """SELECT fold, alpha, norm, c, sum(sup) AS sup, sum(prd) AS prd, sum(tp) AS tp FROM (
                 SELECT fold, alpha, norm, y AS c, n AS sup, 0 AS prd, CASE WHEN y = p THEN n ELSE 0 END AS tp FROM cell
                 UNION ALL SELECT fold, alpha, norm, p, 0, n, 0 FROM cell) GROUP BY ALL""",
        "ff": "SELECT alpha, norm, fold, sum(2 * tp / (sup + prd) * sup) / sum(sup) AS f1 FROM pc GROUP BY ALL",
        "mn": f"SELECT alpha, norm, {sql_round_sig('avg(f1)', 9)} AS mean_f1 FROM ff GROUP BY ALL",
    }, "SELECT *, CAST(row_number() OVER (ORDER BY mean_f1 DESC, alpha, norm) AS INTEGER) AS rank FROM mn")


QUERIES = {
    "q_cnb_sql": q_cnb_sql,
    "q_cnb_sql_norm": q_cnb_sql_norm,
    "q_cnb_mllib": q_cnb_mllib,
    "q_cnb_report": q_cnb_report,
    "q_cnb_grid": q_cnb_grid,
    "q_folds": q_folds,
    "q_batch_score": q_batch_score,
}

ORACLE = {
    "q_cnb_sql": _cnb_sql_text(False),
    "q_cnb_sql_norm": _cnb_sql_text(True),
    "q_cnb_mllib": _report_sql(),
    "q_cnb_report": _report_sql(),
    "q_cnb_grid": _grid_sql(),
    "q_folds": tp._with({**tp._base(), "fl": _FOLDS}, "SELECT fold, label, CAST(count(*) AS BIGINT) AS n FROM fl GROUP BY ALL"),
    "q_batch_score": _batch_sql(),
}
