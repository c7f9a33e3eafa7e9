"""Registered evaluation queries (K1-K8, G3) with DuckDB oracles.

Predictions are a deterministic rule on ``embeddings``: the first ten
components are the logits of a 10-class scorer (true class = ``label``), the
first three the scores of a 3-cluster assignment.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions.numeric import round_sig, sql_round_sig
from quillmark.operators import evaluate as ev
from quillmark.sources import tables

DIG = 10
N_CLASSES, N_CLUSTERS = 10, 3
CLASSES = list(range(N_CLASSES))


def predictions(spark, sf):
    e = tables.table(spark, sf, "embeddings")
    logits = F.slice("embedding", 1, N_CLASSES)
    return e.select("vec_id", F.col("label").alias("y"), logits.alias("logits"),
                    ev.argmax(logits).alias("p"),
                    ev.argmax(F.slice("embedding", 1, N_CLUSTERS)).alias("cluster"))


def _r(df, cols):
    return df.select(*[round_sig(F.col(c), DIG).alias(c) if c in cols else F.col(c) for c in df.columns])


def q_weighted_scores(spark, sf):
    ct = ev.contingency(predictions(spark, sf), "y", "p")
    return _r(ev.weighted_scores(ct), ["accuracy", "precision", "recall", "f1"])


def q_report(spark, sf):
    ct = ev.contingency(predictions(spark, sf), "y", "p")
    return _r(ev.report(ct), ["precision", "recall", "f1"])


def q_confusion(spark, sf):
    ct = ev.contingency(predictions(spark, sf), "y", "p")
    return ev.confusion(ct, CLASSES)


def q_confusion_share(spark, sf):
    ct = ev.contingency(predictions(spark, sf), "y", "p")
    return _r(ev.confusion_share(ct), ["share"])


def q_cluster_scores(spark, sf):
    ct = ev.contingency(predictions(spark, sf), "y", "cluster")
    return _r(ev.cluster_scores(ct), ["homogeneity", "completeness", "v_measure", "ari"])


def q_silhouette_label(spark, sf):
    ct = ev.contingency(predictions(spark, sf), "y", "cluster")
    return _r(ev.silhouette_on_codes(ct), ["silhouette"])


def q_cluster_report(spark, sf):
    """K8: cluster ids reported directly as class ids (no alignment)."""
    ct = ev.contingency(predictions(spark, sf), "y", "cluster")
    return _r(ev.report(ct), ["precision", "recall", "f1"])


# ---------------------------------------------------------------- DuckDB oracles

def R(e):
    return sql_round_sig(e, DIG)


def _preds(pcol: str) -> str:
    return f"""preds AS (SELECT vec_id, label AS y,
        list_position(embedding[1:{N_CLASSES}], list_max(embedding[1:{N_CLASSES}])) - 1 AS p,
        list_position(embedding[1:{N_CLUSTERS}], list_max(embedding[1:{N_CLUSTERS}])) - 1 AS cluster
        FROM embeddings),
    ct AS (SELECT y, {pcol} AS p, count(*) AS n FROM preds GROUP BY 1, 2)"""


_STATS = """, cls AS (SELECT c, sum(sup) AS support, sum(prd) AS predicted, sum(tp) AS tp FROM (
        SELECT y AS c, n AS sup, 0 AS prd, CASE WHEN y = p THEN n ELSE 0 END AS tp FROM ct
        UNION ALL SELECT p, 0, n, 0 FROM ct) GROUP BY c),
    st AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
                     CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall,
                     CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2 * tp / (support + predicted) END AS f1 FROM cls)"""


def _report_sql(pcol):
    return f"""WITH {_preds(pcol)}{_STATS}
    SELECT CAST(c AS VARCHAR) AS class, {R('precision')} AS precision, {R('recall')} AS recall, {R('f1')} AS f1,
           CAST(support AS BIGINT) AS support FROM st
    UNION ALL SELECT 'accuracy', NULL, NULL, {R('sum(tp) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM st
    UNION ALL SELECT 'macro avg', {R('avg(precision)')}, {R('avg(recall)')}, {R('avg(f1)')}, CAST(sum(support) AS BIGINT) FROM st
    UNION ALL SELECT 'weighted avg', {R('sum(precision * support) / sum(support)')}, {R('sum(recall * support) / sum(support)')},
           {R('sum(f1 * support) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM st"""


_CLUSTER = f"""WITH {_preds('cluster')},
    tot AS (SELECT sum(n) AS tot_n FROM ct),
    ra AS (SELECT y, sum(n) AS a FROM ct GROUP BY y),
    cb AS (SELECT p, sum(n) AS b FROM ct GROUP BY p),
    m AS (SELECT sum(n * ln(n * tot_n / (a * b))) / any_value(tot_n) AS mi, sum(n * (n - 1) / 2) AS sc, any_value(tot_n) AS tot_n
          FROM ct JOIN ra USING (y) JOIN cb USING (p), tot),
    hc AS (SELECT -sum(a / tot_n * ln(a / tot_n)) AS hc, sum(a * (a - 1) / 2) AS sa FROM ra, tot),
    hk AS (SELECT -sum(b / tot_n * ln(b / tot_n)) AS hk, sum(b * (b - 1) / 2) AS sb FROM cb, tot),
    hcv AS (SELECT *, CASE WHEN hc = 0 THEN 1.0 ELSE mi / hc END AS homogeneity,
                      CASE WHEN hk = 0 THEN 1.0 ELSE mi / hk END AS completeness,
                      sa * sb / (tot_n * (tot_n - 1) / 2) AS expected, (sa + sb) / 2 AS mx FROM m, hc, hk)
    SELECT {R('homogeneity')} AS homogeneity, {R('completeness')} AS completeness,
           {R('CASE WHEN homogeneity + completeness = 0 THEN 0.0 ELSE 2 * homogeneity * completeness / (homogeneity + completeness) END')} AS v_measure,
           {R('CASE WHEN mx = expected THEN 1.0 ELSE (sc - expected) / (mx - expected) END')} AS ari FROM hcv"""

_SIL = f"""WITH {_preds('cluster')},
    cl AS (SELECT p, sum(n) AS nj FROM ct GROUP BY p),
    d AS (SELECT c.y, c.p, c.n, cl.nj, o.p AS p2, sum(o.n * abs(c.y - o.y)) AS dsum
          FROM ct c JOIN cl USING (p), ct o GROUP BY ALL),
    per AS (SELECT d.y, d.p, d.n, d.nj,
              max(CASE WHEN d.p2 = d.p THEN (CASE WHEN d.nj - 1 = 0 THEN NULL ELSE d.dsum / (d.nj - 1) END) END) AS a,
              min(CASE WHEN d.p2 <> d.p THEN d.dsum / c2.nj END) AS b
            FROM d JOIN cl c2 ON c2.p = d.p2 GROUP BY d.y, d.p, d.n, d.nj)
    SELECT {R('sum(n * CASE WHEN nj <= 1 OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END) / sum(n)')} AS silhouette
    FROM per"""

QUERIES = {
    "q_weighted_scores": q_weighted_scores,
    "q_report": q_report,
    "q_confusion": q_confusion,
    "q_confusion_share": q_confusion_share,
    "q_cluster_scores": q_cluster_scores,
    "q_silhouette_label": q_silhouette_label,
    "q_cluster_report": q_cluster_report,
}

ORACLE = {
    "q_weighted_scores": f"""WITH {_preds('p')}{_STATS}
        SELECT {R('sum(tp) / sum(support)')} AS accuracy, {R('sum(precision * support) / sum(support)')} AS precision,
               {R('sum(recall * support) / sum(support)')} AS recall, {R('sum(f1 * support) / sum(support)')} AS f1 FROM st""",
    "q_report": _report_sql("p"),
    "q_confusion": f"""WITH {_preds('p')} SELECT y, """
    + ", ".join(f'CAST(sum(CASE WHEN p = {c} THEN n ELSE 0 END) AS BIGINT) AS "{c}"' for c in CLASSES)
    + " FROM ct GROUP BY y",
    "q_confusion_share": f"""WITH {_preds('p')} SELECT y, p, CAST(n AS BIGINT) AS n, {R('n / sum(n) OVER ()')} AS share FROM ct""",
    "q_cluster_scores": _CLUSTER,
    "q_silhouette_label": _SIL,
    "q_cluster_report": _report_sql("cluster"),
}
