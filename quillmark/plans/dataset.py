"""Registered queries for the labelled message dataset (B*, C1-C3, F1-F3, H*, D3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.calendar import sql_after_close, sql_business_day_target
from quillmark.operators import dataset as ds
from quillmark.operators.prices import price_features
from quillmark.plans.history import _ewm_ctes, _hist_base
from quillmark.session import stage
from quillmark.sources import tables
from quillmark.sources.oracle import with_views

K = 3  # EWM span used for the label threshold

HIST_COLS = ["open", "high", "low", "close", "volume", "dol_volume", "intra_day_high_low_pct",
             "intra_day_open_close_pct", "gap_pct", f"ewm_{K}", f"ewm_std_{K}", f"d{K}_avg_pct"]
# B1: projection of the labelled table (message, issuer, trading-day, history and label columns).
LABELLED_COLS = ["id", "title", "body", "category", "issuerId", "publishedTime", "weighted_label", "symbol", "name",
                 "is_next_day", "next_day", *HIST_COLS, "is_positive", "is_negative", "label"]


def history(spark, sf, scale: float = 1.0) -> DataFrame:
    return price_features(tables.bars(spark, sf), spans=[K], scale=scale, series=("px",))


def messages_with_symbol(spark, sf) -> DataFrame:
    return ds.attach_symbol(tables.messages(spark, sf), tables.issuers(spark, sf))


def labelled_rows(spark, sf, scale: float = 1.0, lower: bool = True) -> DataFrame:
    """Messages of known symbols joined to the trading day they can affect, labelled; what comes from documents is not joined yet.

    The inner join on (symbol, day) already drops unknown symbols (B2), so no separate filter runs.
    """
    m = ds.with_trading_day(ds.attach_symbol(tables.message_rows(spark, sf), tables.issuers(spark, sf)))
    j = ds.join_history(m, history(spark, sf, scale))
    return ds.label(ds.ground_truth(j, k=K, lower=lower, scale=scale), lower=lower)


def labelled(spark, sf, scale: float = 1.0, lower: bool = True) -> DataFrame:
    """The labelled messages with their texts, which join last: no other join moves a text a message.

    Lazy: a query that reads no text carries none through its joins.
    """
    return tables.with_texts(labelled_rows(spark, sf, scale, lower), tables.texts(spark, sf)).select(*LABELLED_COLS)


def q_msg_issuer(spark, sf):
    return messages_with_symbol(spark, sf).select("id", "issuerId", "symbol", "name")


def q_known_symbols(spark, sf):
    return ds.known_symbols(messages_with_symbol(spark, sf), tables.bars(spark, sf)).select("id", "symbol")


def q_unknown_symbols(spark, sf):
    return ds.known_symbols(messages_with_symbol(spark, sf), tables.bars(spark, sf), known=False).select("id", "symbol")


def q_business_day(spark, sf):
    m = ds.with_trading_day(tables.messages(spark, sf))
    return m.select("id", F.date_format("publishedTime", "yyyy-MM-dd HH:mm:ss").alias("published"),
                    "is_next_day", "next_day")


def q_msg_history(spark, sf):
    m = ds.with_trading_day(messages_with_symbol(spark, sf))
    return ds.join_history(m, tables.bars(spark, sf)).select("id", "symbol", "next_day", "open", "high", "low", "close", "volume")


def q_ground_truth(spark, sf):
    return labelled(spark, sf).select("id", "symbol", "next_day", "is_positive", "is_negative", "label")


def q_ground_truth_pct(spark, sf):
    return labelled(spark, sf, scale=100.0, lower=False).select(
        "id", "symbol", "next_day", "intra_day_open_close_pct", "is_positive", "is_negative", "label")


def q_label_counts(spark, sf):
    """D3/G1: label frequencies, descending (ties by label)."""
    return (labelled(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "label"))


def q_label_counts_by_symbol(spark, sf):
    """Flagship: labels per symbol after the trading-day join."""
    return (labelled(spark, sf).groupBy("symbol", "label").agg(F.count(F.lit(1)).alias("n"))
            .orderBy("symbol", "label"))


VIEW_COLS = ["id", "symbol", "weighted_label", "label"]


def _views(spark, sf):
    """H5: the language views; keys and labels only are staged once for all of them, texts are joined back where needed."""
    return ds.language_views(stage(labelled(spark, sf).select(*VIEW_COLS), "labelled"))


def q_language_views(spark, sf):
    """Rows per view and language, plus the view without the 'None' sentinel."""
    views = _views(spark, sf)
    views["msg_all_no_sentinel"] = ds.drop_none_sentinel(views["msg_all"])
    parts = [v.groupBy("weighted_label").agg(F.count(F.lit(1)).alias("n")).withColumn("dataset", F.lit(k))
             for k, v in views.items()]
    return reduce(DataFrame.unionByName, parts)


def q_rare_strata(spark, sf):
    """Languages kept per view (more than two rows, missing dropped)."""
    parts = [ds.keep_common_strata(v).groupBy("weighted_label").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("dataset", F.lit(k)) for k, v in _views(spark, sf).items()]
    return reduce(DataFrame.unionByName, parts)


def split_view(df: DataFrame, name: str) -> DataFrame:
    """H4/H5: plain split for the English view, stratified by language otherwise."""
    base = ds.keep_common_strata(df)
    return ds.exact_split(base, stratum=None if name == "msg_en" else "weighted_label")


def q_split_plain(spark, sf):
    return split_view(_views(spark, sf)["msg_en"], "msg_en").select("id", "weighted_label", "label", "split")


def q_split_stratified(spark, sf):
    return split_view(_views(spark, sf)["msg_all"], "msg_all").select("id", "weighted_label", "label", "split")


def q_split_sizes(spark, sf):
    parts = [split_view(v, k).groupBy("weighted_label", "split").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("dataset", F.lit(k)) for k, v in _views(spark, sf).items()]
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- DuckDB oracles

def _labelled_ctes(scale: float = 1.0, lower: bool = True) -> dict[str, str]:
    pos, neg, neu = ds.LABELS if lower else tuple(x.upper() for x in ds.LABELS)
    s = repr(float(scale))
    hist_cols = ", ".join(f"h.{c}" for c in HIST_COLS)
    return {
        **_hist_base(scale, spans=[K]),
        **_ewm_ctes(spans=[K], series={"px": "pm"}),
        "hist": f"SELECT hf.*, eo.ewm_{K}, eo.ewm_std_{K} FROM hf JOIN eo USING (symbol, date)",
        "mi": "SELECT m.*, i.symbol, i.name FROM messages m JOIN issuers i USING (issuerId)",
        "td": f"""SELECT *, {sql_after_close('publishedTime')} AS is_next_day,
                  {sql_business_day_target('publishedTime')} AS next_day
                  FROM mi WHERE symbol IN (SELECT DISTINCT symbol FROM bars)""",
        "mh": f"SELECT td.*, {hist_cols} FROM td JOIN hist h ON td.symbol = h.symbol AND td.next_day = h.date",
        "gt": f"""SELECT *,
            CASE WHEN intra_day_open_close_pct > (CASE WHEN ewm_{K} = 0 THEN NULL ELSE ewm_std_{K} / ewm_{K} END) * {s}
                 THEN '{pos}' END AS is_positive,
            CASE WHEN intra_day_open_close_pct < (CASE WHEN ewm_{K} = 0 THEN NULL ELSE ewm_std_{K} / ewm_{K} END) * {s}
                 THEN '{neg}' END AS is_negative FROM mh""",
        "lab": f"SELECT *, coalesce(is_positive, is_negative, '{neu}') AS label FROM gt",
    }


def _sql_lab(body, scale=1.0, lower=True, extra=None):
    return with_views(body, "bars", "issuers", "messages", extra={**_labelled_ctes(scale, lower), **(extra or {})})


VIEW_WHERE = {
    "msg_en": "weighted_label = '__label__en'",
    "msg_all": "TRUE",
    "msg_no": "weighted_label IS DISTINCT FROM '__label__en'",
}


def split_ctes(v: str, base: str, key: str = "id", stratum: str | None = "weighted_label") -> dict[str, str]:
    """DuckDB text of :func:`quillmark.operators.dataset.exact_split` over CTE ``base`` -> CTE ``v``."""
    r = ds.VAL / (ds.VAL + (1 - ds.VAL - ds.TEST))
    strat = stratum or "''"
    return {
        f"{v}_h": f"SELECT *, {strat} AS s, md5('{ds.SEED}|' || CAST({key} AS VARCHAR)) AS hh FROM {base}",
        f"{v}_st": f"""SELECT s, count(*) AS ns, sum(count(*)) OVER () AS n,
              ceil(CAST({ds.TEST!r} AS DOUBLE) * sum(count(*)) OVER ()) AS n_test FROM {v}_h GROUP BY s""",
        f"{v}_q1": f"""SELECT *, ceil(CAST({r!r} AS DOUBLE) * (n - n_test)) AS n_val,
              floor(ns * n_test / n) AS fl, ns * n_test / n - floor(ns * n_test / n) AS rem FROM {v}_st""",
        f"{v}_q2": f"""SELECT *, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, s)
              <= n_test - sum(fl) OVER () THEN 1 ELSE 0 END AS qt FROM {v}_q1""",
        f"{v}_q3": f"""SELECT s, qt, n_val, ns - qt AS lft, floor((ns - qt) * n_val / sum(ns - qt) OVER ()) AS fl2,
              (ns - qt) * n_val / sum(ns - qt) OVER () - floor((ns - qt) * n_val / sum(ns - qt) OVER ()) AS rem2
              FROM {v}_q2""",
        f"{v}_q": f"""SELECT s, qt, fl2 + CASE WHEN row_number() OVER (ORDER BY rem2 DESC, s)
              <= n_val - sum(fl2) OVER () THEN 1 ELSE 0 END AS qv FROM {v}_q3""",
        v: f"""SELECT h.* EXCLUDE (s, hh, rk), CASE WHEN rk <= qt THEN 'test' WHEN rk <= qt + qv THEN 'val' ELSE 'train' END AS split
              FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY hh, {key}) AS rk FROM {v}_h) h
              JOIN {v}_q q USING (s)""",
    }


def _split_ctes(view: str) -> dict[str, str]:
    v = f"sv_{view}"
    base = {
        f"{v}_b": f"""SELECT * FROM lab WHERE {VIEW_WHERE[view]} AND weighted_label IN
              (SELECT weighted_label FROM lab WHERE {VIEW_WHERE[view]} AND weighted_label IS NOT NULL
               GROUP BY 1 HAVING count(*) > 2)""",
    }
    return {**base, **split_ctes(v, f"{v}_b", "id", None if view == "msg_en" else "weighted_label")}


def _count_union(views, src):
    return " UNION ALL ".join(
        f"SELECT '{k}' AS dataset, weighted_label, CAST(count(*) AS BIGINT) AS n FROM {src(k)} GROUP BY weighted_label"
        for k in views)


QUERIES = {
    "q_msg_issuer": q_msg_issuer,
    "q_known_symbols": q_known_symbols,
    "q_unknown_symbols": q_unknown_symbols,
    "q_business_day": q_business_day,
    "q_msg_history": q_msg_history,
    "q_ground_truth": q_ground_truth,
    "q_ground_truth_pct": q_ground_truth_pct,
    "q_label_counts": q_label_counts,
    "q_label_counts_by_symbol": q_label_counts_by_symbol,
    "q_language_views": q_language_views,
    "q_rare_strata": q_rare_strata,
    "q_split_plain": q_split_plain,
    "q_split_stratified": q_split_stratified,
    "q_split_sizes": q_split_sizes,
}

_KNOWN = "SELECT id, symbol FROM (SELECT m.id, i.symbol FROM messages m JOIN issuers i USING (issuerId)) WHERE symbol {op} (SELECT DISTINCT symbol FROM bars)"

ORACLE = {
    "q_msg_issuer": with_views("SELECT m.id, m.issuerId, i.symbol, i.name FROM messages m JOIN issuers i USING (issuerId)",
                               "issuers", "messages"),
    "q_known_symbols": with_views(_KNOWN.format(op="IN"), "bars", "issuers", "messages"),
    "q_unknown_symbols": with_views(_KNOWN.format(op="NOT IN"), "bars", "issuers", "messages"),
    "q_business_day": with_views(
        f"SELECT id, strftime(publishedTime, '%Y-%m-%d %H:%M:%S') AS published, {sql_after_close('publishedTime')} AS is_next_day, "
        f"{sql_business_day_target('publishedTime')} AS next_day FROM messages", "messages"),
    "q_msg_history": with_views(
        f"""SELECT td.id, td.symbol, td.next_day, b.open, b.high, b.low, b.close, b.volume
        FROM (SELECT m.id, i.symbol, {sql_business_day_target('m.publishedTime')} AS next_day
              FROM messages m JOIN issuers i USING (issuerId) WHERE i.symbol IN (SELECT DISTINCT symbol FROM bars)) td
        JOIN bars b ON td.symbol = b.symbol AND td.next_day = b.date""", "bars", "issuers", "messages"),
    "q_ground_truth": _sql_lab("SELECT id, symbol, next_day, is_positive, is_negative, label FROM lab"),
    "q_ground_truth_pct": _sql_lab(
        "SELECT id, symbol, next_day, intra_day_open_close_pct, is_positive, is_negative, label FROM lab",
        scale=100.0, lower=False),
    "q_label_counts": _sql_lab("SELECT label, CAST(count(*) AS BIGINT) AS n FROM lab GROUP BY label ORDER BY n DESC, label"),
    "q_label_counts_by_symbol": _sql_lab(
        "SELECT symbol, label, CAST(count(*) AS BIGINT) AS n FROM lab GROUP BY symbol, label ORDER BY symbol, label"),
    "q_language_views": _sql_lab(
        _count_union(list(VIEW_WHERE) + ["msg_all_no_sentinel"],
                     lambda k: "(SELECT * FROM lab WHERE weighted_label IS DISTINCT FROM 'None')"
                     if k == "msg_all_no_sentinel" else f"(SELECT * FROM lab WHERE {VIEW_WHERE[k]})")),
    "q_rare_strata": _sql_lab(_count_union(list(VIEW_WHERE), lambda k: f"sv_{k}_b"),
                              extra={k: v for view in VIEW_WHERE for k, v in _split_ctes(view).items()}),
    "q_split_plain": _sql_lab("SELECT id, weighted_label, label, split FROM sv_msg_en", extra=_split_ctes("msg_en")),
    "q_split_stratified": _sql_lab("SELECT id, weighted_label, label, split FROM sv_msg_all",
                                   extra=_split_ctes("msg_all")),
    "q_split_sizes": _sql_lab(
        " UNION ALL ".join(
            f"SELECT '{k}' AS dataset, weighted_label, split, CAST(count(*) AS BIGINT) AS n FROM sv_{k} GROUP BY ALL"
            for k in VIEW_WHERE),
        extra={k: v for view in VIEW_WHERE for k, v in _split_ctes(view).items()}),
}
