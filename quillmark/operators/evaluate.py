"""Classification and clustering metrics as aggregations over a contingency table.

Every metric is computed from ``(y, p, n)``: the number of rows with true
class ``y`` and predicted class / cluster ``p``.  Building it is one
partially-aggregated ``groupBy``; everything after works on at most
(#classes x #clusters) cells, never on pairs of data rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.numeric import safe_div


def argmax(arr) -> Column:
    """0-based index of the first maximum of an array (numpy ``argmax``)."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.array_position(a, F.array_max(a)) - 1


def contingency(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def class_stats(ct: DataFrame) -> DataFrame:
    """Per class (union of true and predicted): support, predicted, true positives, P, R, F1."""
    rows = ct.select(F.col("y").alias("c"), F.col("n").alias("sup"), F.lit(0).cast("bigint").alias("prd"),
                     F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp")).unionByName(
        ct.select(F.col("p").alias("c"), F.lit(0).cast("bigint").alias("sup"), F.col("n").alias("prd"),
                  F.lit(0).cast("bigint").alias("tp")))
    s = rows.groupBy("c").agg(F.sum("sup").alias("support"), F.sum("prd").alias("predicted"), F.sum("tp").alias("tp"))
    zero = F.lit(0.0)
    return s.withColumns({
        "precision": F.coalesce(safe_div(F.col("tp"), F.col("predicted")), zero),
        "recall": F.coalesce(safe_div(F.col("tp"), F.col("support")), zero),
        "f1": F.coalesce(safe_div(2 * F.col("tp"), F.col("support") + F.col("predicted")), zero),
    })


def weighted_scores(ct: DataFrame) -> DataFrame:
    """K1: accuracy and support-weighted precision / recall / F1 (zero division -> 0)."""
    s = class_stats(ct)
    return s.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"),
    )


def weighted_f1(cells: DataFrame, by: list[str]) -> DataFrame:
    """K1 for many predictions at once: (*by, f1) from cells (*by, y, p, n)."""
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    none = F.lit(0).cast("bigint")
    rows = cells.select(*by, F.explode(F.array(
        F.struct(F.col("y").alias("c"), F.col("n").alias("sup"), none.alias("prd"), hit.alias("tp")),
        F.struct(F.col("p").alias("c"), none.alias("sup"), F.col("n").alias("prd"), none.alias("tp")))).alias("x")).select(*by, "x.*")
    per = rows.groupBy(*by, "c").agg(*[F.sum(c).alias(c) for c in ("sup", "prd", "tp")])
    share = 2 * F.col("tp") / (F.col("sup") + F.col("prd")) * F.col("sup")
    return per.groupBy(*by).agg((F.sum(share) / F.sum("sup")).alias("f1"))


def report(ct: DataFrame) -> DataFrame:
    """K2: per-class rows plus accuracy, macro avg and weighted avg (classification report)."""
    s = class_stats(ct)
    per = s.select(F.col("c").cast("string").alias("class"), "precision", "recall", "f1", "support")
    tot = s.agg(
        F.sum("support").alias("n"), F.sum("tp").alias("tp"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"),
    )
    null = F.lit(None).cast("double")
    summary = tot.select(F.inline(F.array(
        F.struct(F.lit("accuracy").alias("class"), null.alias("precision"), null.alias("recall"),
                 (F.col("tp") / F.col("n")).alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"), F.col("wr").alias("recall"),
                 F.col("wf").alias("f1"), F.col("n").alias("support")),
    )))
    return per.unionByName(summary)


def confusion(ct: DataFrame, labels: list) -> DataFrame:
    """K3: confusion matrix with a fixed label order; absent cells are 0."""
    return ct.groupBy("y").pivot("p", labels).agg(F.sum("n")).na.fill(0)


def confusion_share(ct: DataFrame) -> DataFrame:
    """K4: each cell as a share of all rows."""
    return ct.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def cluster_scores(ct: DataFrame) -> DataFrame:
    """K5/K6: homogeneity, completeness, V-measure and adjusted Rand index (natural log)."""
    rows = ct.groupBy("y").agg(F.sum("n").alias("a"))
    cols = ct.groupBy("p").agg(F.sum("n").alias("b"))
    n = ct.agg(F.sum("n").alias("_tot"))
    cells = ct.join(rows, "y").join(cols, "p")
    k = F.lit(1)
    cells = cells.withColumn("_k", k).join(n.withColumn("_k", k), "_k")
    agg = cells.agg(
        (F.sum(F.col("n") * F.log(F.col("n") * F.col("_tot") / (F.col("a") * F.col("b")))) / F.first("_tot")).alias("mi"),
        F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("sc"),
        F.first("_tot").alias("_tot"),
    )
    hc = rows.withColumn("_k", k).join(n.withColumn("_k", k), "_k").agg(
        (-F.sum(F.col("a") / F.col("_tot") * F.log(F.col("a") / F.col("_tot")))).alias("hc"),
        F.sum(F.col("a") * (F.col("a") - 1) / 2).alias("sa"))
    hk = cols.withColumn("_k", k).join(n.withColumn("_k", k), "_k").agg(
        (-F.sum(F.col("b") / F.col("_tot") * F.log(F.col("b") / F.col("_tot")))).alias("hk"),
        F.sum(F.col("b") * (F.col("b") - 1) / 2).alias("sb"))
    t = (agg.withColumn("_k", k).join(hc.withColumn("_k", k), "_k").join(hk.withColumn("_k", k), "_k"))
    h = F.when(F.col("hc") == 0, 1.0).otherwise(F.col("mi") / F.col("hc"))
    c = F.when(F.col("hk") == 0, 1.0).otherwise(F.col("mi") / F.col("hk"))
    t = t.withColumns({"homogeneity": h, "completeness": c})
    v = F.when(F.col("homogeneity") + F.col("completeness") == 0, 0.0).otherwise(
        2 * F.col("homogeneity") * F.col("completeness") / (F.col("homogeneity") + F.col("completeness")))
    expected = F.col("sa") * F.col("sb") / (F.col("_tot") * (F.col("_tot") - 1) / 2)
    mx = (F.col("sa") + F.col("sb")) / 2
    ari = F.when(mx == expected, 1.0).otherwise((F.col("sc") - expected) / (mx - expected))
    return t.select("homogeneity", "completeness", v.alias("v_measure"), ari.alias("ari"))


def silhouette_on_codes(ct: DataFrame) -> DataFrame:
    """K7: silhouette where each point is its 1-D true class code and the cluster id is the label.

    Exact from the contingency table: for a cell (i, j),
    a = sum_i' n(i',j)|i-i'| / (n_j - 1), b = min over j' != j of sum_i' n(i',j')|i-i'| / n_j';
    s = (b-a)/max(a,b), 0 for singleton clusters; mean weighted by n(i,j).
    """
    cl = ct.groupBy("p").agg(F.sum("n").alias("nj"))
    cells = ct.join(cl, "p")
    # distance sums D(i, j') for each cell's class i and every cluster j' (cells x cells: tiny)
    other = ct.select(F.col("y").alias("y2"), F.col("p").alias("p2"), F.col("n").alias("n2"))
    k = F.lit(1)
    pairs = cells.select("y", "p", "n", "nj").distinct().withColumn("_k", k).join(other.withColumn("_k", k), "_k")
    d = pairs.groupBy("y", "p", "n", "nj", "p2").agg(
        F.sum(F.col("n2") * F.abs(F.col("y").cast("double") - F.col("y2").cast("double"))).alias("dsum"))
    d = d.join(cl.select(F.col("p").alias("p2"), F.col("nj").alias("nj2")), "p2")
    per = d.groupBy("y", "p", "n", "nj").agg(
        F.max(F.when(F.col("p2") == F.col("p"), safe_div(F.col("dsum"), F.col("nj") - 1))).alias("a"),
        F.min(F.when(F.col("p2") != F.col("p"), F.col("dsum") / F.col("nj2"))).alias("b"),
    )
    s = F.when((F.col("nj") <= 1) | (F.greatest("a", "b") == 0), 0.0).otherwise(
        (F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return per.agg((F.sum(F.col("n") * s) / F.sum("n")).alias("silhouette"))
