"""Language identification as relational operators.

A character-trigram multinomial model is fit with ``groupBy(lang, trigram)``
on labelled documents; paragraphs are scored by joining their trigram counts
to the model table and summing log probabilities per language.  Document
scores weight paragraph labels by paragraph length.  Trigrams are counted a batch of
paragraphs at a time, in time linear in their length, and named by their three code points
in one number; every step between is a join or an aggregate, so it runs over
whole texts on any number of executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.session import stage

PARAGRAPH_RE = r"\r?\n+"
# Language sets of the reference's language audit (top-1 and top-3 checks).
TOP_LANGS = ["en", "no"]
TOP3_LANGS = ["en", "no", "sv"]
NO_LABEL = "None"
CHAR_BITS = 21              # a code point
AT_ONCE = 2_000_000         # characters counted at a time
SENT_TRIGRAMS = 500_000     # a model of up to so many trigrams is sent to all tasks


def count_trigrams(texts: list[str], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, trigram, count) of the overlapping 3-character pieces of texts; ``owner`` names who a text counts for."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    chars, at = np.unique(np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4"), return_inverse=True)
    k, owners = len(chars), int(owner.max(initial=0)) + 1
    if owners * k ** 3 >= 2 ** 63 and len(texts) > 1:  # the numbers below would not fit
        names, own = np.unique(owner, return_inverse=True)
        if len(names) < owners:
            found, tri, n = count_trigrams(texts, own)
            return names[found], tri, n
        half = len(texts) // 2
        parts = [count_trigrams(texts[:half], owner[:half]), count_trigrams(texts[half:], owner[half:])]
        return tuple(np.concatenate(x) for x in zip(*parts))
    inside, stop = np.ones(len(at), dtype=bool), np.cumsum(size)
    inside[stop[size > 0] - 1] = False
    inside[stop[size > 1] - 2] = False
    first = np.flatnonzero(inside)
    number = ((np.repeat(owner, size)[first] * k + at[first]) * k + at[first + 1]) * k + at[first + 2]
    number, n = np.unique(number, return_counts=True)
    chars, k = chars.astype(np.int64), max(k, 1)
    tri = chars[number // k ** 2 % k] << 2 * CHAR_BITS | chars[number // k % k] << CHAR_BITS | chars[number % k]
    return number // k ** 3, tri, n


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep=()) -> DataFrame:
    """(id, *keep, par, ptext, par_len): non-empty paragraphs split at line breaks (``\\r\\n`` or ``\\n``)."""
    return (docs.select(id_col, *keep, F.posexplode(F.split(F.col(text), PARAGRAPH_RE)).alias("par", "ptext"))
            .where(F.length("ptext") > 0).withColumn("par_len", F.length("ptext")))


def trigram_parts(paras: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, tri, n): trigram counts per paragraph key; a key has a row for each batch that holds it."""
    low = paras.select(*keys, F.lower("ptext").alias("_p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("_p").to_pylist()
            place: dict[tuple, int] = {}
            owner = np.array([place.setdefault(k, len(place)) for k in zip(*[b.column(k).to_pylist() for k in keys])], dtype=np.int64)
            first = np.unique(owner, return_index=True)[1]
            cut = np.cumsum([len(t) for t in texts]) // AT_ONCE
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(cut)) + 1):
                if len(part):
                    own, tri, n = count_trigrams(texts[part[0]: part[-1] + 1], owner[part])
                    at = pa.array(first[own])
                    yield pa.RecordBatch.from_arrays([*[b.column(k).take(at) for k in keys], pa.array(tri), pa.array(n)],
                                                     names=[*keys, "tri", "n"])

    kinds = [f"`{k}` {low.schema[k].dataType.simpleString()}" for k in keys]
    return low.mapInArrow(run, ", ".join([*kinds, "tri long", "n long"]))


def trigram_counts(paras: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, tri, n): trigram counts per paragraph key (counted in batches before the shuffle)."""
    return trigram_parts(paras, keys).groupBy(*keys, "tri").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang"):
    """Multinomial trigram model with add-one smoothing.

    Returns ``(model, priors)``: ``model(tri, lang, logp)`` over the whole
    trigram vocabulary and every class, ``priors(lang, logprior)``.  The class
    list is collected (one row per language) to zero-fill the vocabulary.
    """
    paras = paragraphs(docs, id_col, text, keep=[lang])
    # the counts feed the class list, the vocabulary size and the model: materialise them once
    counts = stage(trigram_counts(paras, [lang]).withColumnRenamed("n", "c"), "trigram_counts")
    stats = counts.groupBy(lang).agg(F.sum("c").alias("n_lang"))
    langs = sorted(r[lang] for r in stats.select(lang).collect())
    v = counts.select("tri").distinct()
    n_vocab = v.count()
    full = (v.select("tri", F.explode(F.array(*[F.lit(x) for x in langs])).alias(lang))
            .join(counts, ["tri", lang], "left").join(F.broadcast(stats), lang))
    model = full.select("tri", lang, F.log((F.coalesce("c", F.lit(0)) + 1) / (F.col("n_lang") + F.lit(n_vocab)))
                        .alias("logp"))
    n_docs = docs.groupBy(lang).agg(F.count(F.lit(1)).alias("nd"))
    priors = n_docs.select(lang, F.log(F.col("nd") / F.sum("nd").over(_all())).alias("logprior"))
    return model, priors


def _all():
    from pyspark.sql import Window
    return Window.partitionBy()


def score_paragraphs(paras: DataFrame, model: DataFrame, priors: DataFrame, id_col: str = "doc_id",
                     lang: str = "lang") -> DataFrame:
    """(id, par, par_len, par_label, par_label_score) for paragraphs with a known trigram.

    ``par_label_score`` is the posterior of the best language.  Trigrams
    outside the vocabulary are ignored; a paragraph without any known trigram
    gets no label.
    """
    keys = [id_col, "par"]
    prior = {r[lang]: r["logprior"] for r in priors.collect()}  # one row a language
    names = sorted(r[lang] for r in model.select(lang).distinct().where(F.col(lang).isNotNull()).collect() if r[lang] in prior) or [NO_LABEL]
    # one row a trigram with all languages
    wide = stage(model.groupBy("tri").agg(*[F.max(F.when(F.col(lang) == x, F.col("logp"))).alias(f"l{i}") for i, x in enumerate(names)]),
                 "trigram_model")
    if wide.count() <= SENT_TRIGRAMS:
        wide = F.broadcast(wide)
    per = trigram_parts(paras, keys).join(wide, "tri").groupBy(*keys).agg(
        *[F.sum(F.col("n") * F.col(f"l{i}")).alias(f"l{i}") for i in range(len(names))])
    scores = F.array(*[F.struct((F.col(f"l{i}") + F.lit(prior.get(x, 0.0))).alias("score"), F.lit(x).alias("lang"))
                       for i, x in enumerate(names)])
    best = per.select(*keys, F.filter(scores, lambda x: x["score"].isNotNull()).alias("_s")).withColumn("_b", F.array_max("_s"))
    post = F.lit(1.0) / F.aggregate("_s", F.lit(0.0), lambda acc, x: acc + F.exp(x["score"] - F.col("_b.score")))
    return (best.where("_b is not null").select(*keys, F.col("_b.lang").alias("par_label"), post.alias("par_label_score"))
            .join(paras.select(*keys, "par_len"), keys))


def document_language(scored: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Length-weighted language scores per document, label = max, confidence, paragraph count.

    A document without a scored paragraph keeps its row: label ``"None"`` (the sentinel of B4), no
    scores, count 0.
    """
    per = scored.groupBy(id_col, "par_label").agg(
        F.sum(F.col("par_len") * F.col("par_label_score")).alias("ws"), F.sum("par_len").alias("ln"),
        F.count(F.lit(1)).alias("np"))
    doc = per.groupBy(id_col).agg(
        F.map_from_entries(F.collect_list(F.struct("par_label", "ws"))).alias("_ws"),
        F.sum("ln").alias("_len"), F.sum("np").alias("n_paragraphs"),
        F.max_by("par_label", F.struct("ws", "par_label")).alias("weighted_label"),
        F.max("ws").alias("_best"))
    doc = docs.select(id_col).join(doc, id_col, "left")
    scores = F.transform_values("_ws", lambda k, v: v / F.col("_len"))
    return doc.select(
        id_col, F.coalesce(scores, F.create_map().cast("map<string,double>")).alias("weighted_scores"),
        F.coalesce("weighted_label", F.lit(NO_LABEL)).alias("weighted_label"),
        (F.col("_best") / F.col("_len")).alias("weighted_label_conf"),
        F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"))


def top_languages(scores: Column, n: int = 3) -> Column:
    """The ``n`` languages with the highest score (ties by name), best first."""
    ent = F.map_entries(scores)
    srt = F.array_sort(ent, lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1)
                       .when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return F.transform(F.slice(srt, 1, n), lambda e: e["key"])


def language_mix(doc_lang: DataFrame, top_set=TOP_LANGS, top3_set=TOP3_LANGS) -> DataFrame:
    """Rows whose top language is outside ``top_set``; rows with none of ``top3_set`` in the top 3."""
    top3 = top_languages(F.col("weighted_scores"), 3)
    return doc_lang.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~F.col("weighted_label").isin(*top_set)).alias("n_top_outside"),
        F.count_if(~F.arrays_overlap(top3, F.array(*[F.lit(x) for x in top3_set]))).alias("n_top3_none"))


def clean_title(c: Column) -> Column:
    """Lower-case, every run of non letters / digits to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def language_columns(rows: DataFrame, model: DataFrame, priors: DataFrame, texts: DataFrame | None = None,
                     id_col: str = "id", title: str = "title", body: str = "body", bodies: DataFrame | None = None,
                     attach: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """B1: ``rows`` with the language columns of their titles and bodies.

    Adds title_clean, title_lang, title_lang_score; par_len, par_label, par_label_score (arrays over the scored paragraphs in
    order); weighted_scores, weighted_label, weighted_label_conf, n_paragraphs.  Texts are taken from ``texts`` (default: the
    rows), named by their SHA-256 and scored once each, however many messages carry them.  A missing or unscored title or
    body has the label ``"None"``, no scores and 0 paragraphs.

    Where the bodies lie in a table of their own, ``bodies`` (text, ...) is that table and ``attach(rows, bodies)`` gives rows
    without ``body`` theirs; columns of ``bodies`` named ``_...`` stay.  That is the last join: the others move no text a message.
    """
    texts = rows if texts is None else texts

    def distinct(texts: DataFrame, col: str) -> DataFrame:
        named = texts.where(F.col(col).isNotNull()).select(F.sha2(F.col(col), 256).alias("_key"), F.col(col).alias("_text"))
        return named.groupBy("_key").agg(F.any_value("_text").alias("_text"))

    titles = distinct(texts, title).select("_key", clean_title(F.col("_text")).alias("title_clean"))
    lines = titles.select("_key", F.lit(0).alias("par"), F.col("title_clean").alias("ptext"),
                          F.length("title_clean").alias("par_len"))
    found = score_paragraphs(lines, model, priors, id_col="_key").select(
        "_key", F.col("par_label").alias("title_lang"), F.col("par_label_score").alias("title_lang_score"))
    titles = titles.join(found, "_key", "left").withColumnRenamed("_key", "_title")

    # both sides of the scoring and the documents read them
    each = stage(distinct(texts, body) if attach is None else distinct(bodies, "text"), "bodies")
    scored = stage(score_paragraphs(paragraphs(each, "_key", "_text"), model, priors, id_col="_key"), "scored_paragraphs")
    in_order = F.array_sort(F.collect_list(F.struct("par", "par_len", "par_label", "par_label_score")))
    parts = scored.groupBy("_key").agg(in_order.alias("_p")).select("_key", "_p.par_len", "_p.par_label", "_p.par_label_score")
    docs = document_language(scored, each, id_col="_key").join(parts, "_key", "left").withColumnRenamed("_key", "_body")

    # a missing text has a key of its own that matches nothing, so such rows do not meet in one partition
    def key(col: str, own: str) -> Column:
        return F.coalesce(F.sha2(F.col(col), 256), F.concat(F.lit("-"), F.col(own).cast("string")))

    out = rows.withColumn("_title", key(title, id_col)).join(titles, "_title", "left").drop("_title")
    if attach is None:
        out = out.withColumn("_body", key(body, id_col)).join(docs, "_body", "left").drop("_body")
    else:
        columns = [c for c in docs.columns if c != "_body"]
        named = docs.select("_body", *[F.col(c).alias(f"_{c}") for c in columns])
        out = attach(out, bodies.withColumn("_body", key("text", "doc_id")).join(named, "_body", "left").drop("_body"))
        carried = F.col(body).isNotNull()
        out = out.withColumns({c: F.when(carried, F.col(f"_{c}")) for c in columns}).drop(*[f"_{c}" for c in columns])
    none = {"title_lang": F.lit(NO_LABEL), "weighted_label": F.lit(NO_LABEL), "n_paragraphs": F.lit(0),
            "weighted_scores": F.create_map().cast("map<string,double>"), "par_len": F.array().cast("array<int>"),
            "par_label": F.array().cast("array<string>"), "par_label_score": F.array().cast("array<double>")}
    return out.withColumns({c: F.coalesce(c, v) for c, v in none.items()})
