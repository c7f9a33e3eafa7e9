"""Relational text features.

The source of truth is the long table ``(doc_id, term, weight)``; vectors
appear only at the MLlib boundary.  Every step is an explode, a ``groupBy``
on (doc, term) with map-side combine, or an equi-join with a document-
frequency table, so work is spread by term and by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.session import stage

# sklearn-style default token pattern: runs of 2+ word characters after lower-casing.
TOKEN_RE = r"[\p{L}\p{N}_]{2,}"
# A short English stop-word list used by the min/max-df vectoriser (a parameter).
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both "
    "but by can could did do does doing down during each few for from further had has have having he her here hers "
    "him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our "
    "out over own same she should so some such than that the their them then there these they this those through to "
    "too under until up very was we were what when where which while who whom why will with would you your"
).split()
HASH_FEATURES = 100_000
PART_BYTES = 8_000_000  # text bytes a partition that terms are counted in
PAD_ID, UNK_ID = 0, 1
BLOCK_TOKENS = 512
PACK_BATCH = 1000


def tokens(c) -> Column:
    """Lower-case word tokens of two or more word characters."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_RE), 0)


def spread(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` dealt by ``key`` to partitions of about ``PART_BYTES`` of text.

    Their number follows the input, so what a task holds does not; what is then counted, normalised or summed by
    ``key`` needs no further exchange.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return docs.repartition(max(1, -(-size // PART_BYTES)), key)


def doc_terms(docs: DataFrame, id_col: str = "doc_id", text: str = "text", stop_words=None) -> DataFrame:
    """(doc_id, term, tf): raw term counts per document, partitioned by document."""
    t = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")))
    t = t.select("doc_id", F.explode(tokens("text")).alias("term"))
    if stop_words:
        t = t.where(~F.col("term").isin(stop_words))
    return t.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def lexicon(terms: DataFrame, flags: DataFrame, flag_cols: list[str]) -> DataFrame:
    """Words whose dictionary row has any non-zero category flag, lower-cased.

    ``flags`` is a dictionary-like table ``(term, flag_cols...)``.
    """
    nz = F.exists(F.array(*[F.col(c) for c in flag_cols]), lambda x: x != 0)
    return flags.where(nz).select(F.lower("term").alias("term")).distinct()


def document_frequency(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _l2(weighted: DataFrame, value: str = "w") -> DataFrame:
    norm = F.sqrt(F.sum(F.col(value) * F.col(value)).over(Window.partitionBy("doc_id")))
    return weighted.withColumn("weight", F.col(value) / norm).drop(value)


def idf_table(train_terms: DataFrame, n_train: Column, vocab: DataFrame | None = None,
              min_df: int | None = None, max_df: float | None = None) -> DataFrame:
    """(term, idf) with smooth idf ``ln((1+n)/(1+df)) + 1`` fit on the training documents.

    With a fixed ``vocab`` every vocabulary term gets an idf (df may be 0) and
    min/max df do not apply; otherwise the vocabulary is the training terms with
    ``min_df <= df`` and ``df <= max_df * n`` (float share of documents).
    """
    df = document_frequency(train_terms)
    if vocab is not None:
        v = vocab.select("term").distinct().join(df, "term", "left").fillna(0, ["df"])
    else:
        v = df
        if min_df is not None:
            v = v.where(F.col("df") >= min_df)
        if max_df is not None:
            v = v.where(F.col("df") <= F.lit(max_df) * n_train)
    return v.select("term", (F.log((1 + n_train) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(apply_terms: DataFrame, idf: DataFrame) -> DataFrame:
    """(doc_id, term, weight): tf x idf over the vocabulary, L2-normalised per document."""
    w = apply_terms.join(idf, "term").select("doc_id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    return _l2(w)


def hash_bucket(term: Column, n_features: int = HASH_FEATURES) -> Column:
    """md5-derived 32-bit hash: bucket = h mod n (reproducible in any SQL engine)."""
    h = F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("bigint")
    return h % n_features


def hash_sign(term: Column) -> Column:
    """+1 / -1 from the 9th hex digit of the md5 (alternate-sign hashing)."""
    d = F.conv(F.substring(F.md5(term), 9, 1), 16, 10).cast("int")
    return F.when(d < 8, 1.0).otherwise(-1.0)


def hashed(terms: DataFrame, n_features: int = HASH_FEATURES) -> DataFrame:
    """Signed hashing of term counts into ``n_features`` buckets, L2-normalised.

    Colliding terms add up with their signs; buckets that cancel to 0 are dropped.
    """
    b = terms.select("doc_id", hash_bucket(F.col("term"), n_features).alias("term"),
                     (hash_sign(F.col("term")) * F.col("tf")).alias("v"))
    b = b.groupBy("doc_id", "term").agg(F.sum("v").alias("w")).where(F.col("w") != 0)
    return _l2(b)


def tfidf_transform(train: DataFrame, apply: DataFrame, n_train: Column) -> DataFrame:
    """Smooth-idf re-weighting of an already weighted long table, then L2 norm."""
    df = train.where(F.col("weight") != 0).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = stage(df.select("term", (F.log((1 + n_train) / (1 + F.col("df"))) + 1).alias("idf")), "transform_idf")
    w = apply.join(idf, "term").select("doc_id", "term", (F.col("weight") * F.col("idf")).alias("w"))
    return _l2(w)


def term_ids(vocab_terms: DataFrame, first_id: int = 2) -> DataFrame:
    """Dense ids for a vocabulary in (md5(term), term) order without a single-task window.

    Terms are bucketed by a 4-hex-digit md5 prefix; bucket sizes (small) are
    prefix-summed and terms are numbered inside their bucket.
    """
    v = vocab_terms.select("term").distinct().withColumn("_h", F.md5("term")).withColumn("_bk", F.substring("_h", 1, 4))
    counts = v.groupBy("_bk").agg(F.count(F.lit(1)).alias("_n"))
    # at most 65,536 bucket rows: the running sum over buckets is a tiny window
    offs = counts.select("_bk", (F.sum("_n").over(Window.orderBy("_bk")) - F.col("_n")).alias("_off"))
    rn = F.row_number().over(Window.partitionBy("_bk").orderBy("_h", "term"))
    return (v.join(offs, "_bk").select("term", (F.col("_off") + rn - 1 + first_id).cast("int").alias("token_id")))


def encode(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text: str = "text",
           max_len: int = BLOCK_TOKENS, truncate: bool = True) -> DataFrame:
    """Token ids in text order, truncated to ``max_len`` (when asked), padded with 0 + mask.

    A text without a token is all padding.  Texts are cut before the join, and a term is looked up
    once per document: (document, term) with its positions, so a frequent word costs a row a document.  Documents are
    dealt by id as texts: where ``ids`` is small enough to send, no row of a token moves.
    """
    words = tokens("text")
    if truncate:
        words = F.slice(words, 1, max_len)
    t = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")))
    t = t.select("doc_id", F.posexplode(words).alias("pos", "term"))
    t = t.groupBy("doc_id", "term").agg(F.collect_list("pos").alias("at")).join(ids, "term", "left")
    pairs = F.transform("at", lambda p: F.struct(p.alias("pos"), F.coalesce("token_id", F.lit(UNK_ID)).alias("tid")))
    seq = t.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list(pairs))).alias("_s"))
    seq = (docs.select(F.col(id_col).alias("doc_id")).join(seq, "doc_id", "left")
           .select("doc_id", F.coalesce(F.transform("_s", lambda s: s["tid"]), F.array().cast("array<int>")).alias("ids")))
    n = F.size("ids")
    pad = F.greatest(F.lit(max_len) - n, F.lit(0))
    return seq.select(
        "doc_id",
        F.concat("ids", F.array_repeat(F.lit(PAD_ID), pad)).alias("input_ids"),
        F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(max_len)) - 1),
                    lambda i: F.when(i < n, 1).otherwise(0)).alias("attention_mask"),
    )


def pack_blocks(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text: str = "text",
                block: int = BLOCK_TOKENS, batch: int = PACK_BATCH) -> DataFrame:
    """Concatenate token streams of each batch of ``batch`` consecutive documents and cut
    them into blocks of ``block`` tokens; the incomplete last block of a batch is dropped.

    Document offsets come from a window over at most ``batch`` documents and join the texts; a term is looked up once per
    document, and a token goes to its (batch, block) as one number, its place and its id, so no group exceeds ``block`` numbers.
    """
    d = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")))
    lens = docs.select(F.col(id_col).alias("doc_id"), F.size(tokens(text)).alias("len")) \
        .withColumn("batch", F.floor(F.col("doc_id") / batch))
    offs = lens.select("doc_id", "batch", (F.sum("len").over(Window.partitionBy("batch").orderBy("doc_id")) - F.col("len"))
                       .alias("off"))
    t = d.join(offs, "doc_id").select("doc_id", "batch", "off", F.posexplode(tokens("text")).alias("pos", "term"))
    t = t.groupBy("doc_id", "batch", "off", "term").agg(F.collect_list("pos").alias("at")).join(ids, "term", "left")
    t = t.select("batch", F.coalesce("token_id", F.lit(UNK_ID)).cast("long").alias("tid"), "off", F.explode("at").alias("pos"))
    t = t.withColumn("gpos", F.col("off") + F.col("pos")).withColumn("block", F.floor(F.col("gpos") / block))
    placed = F.shiftleft(F.col("gpos") - F.col("block") * block, 32) + F.col("tid")
    g = t.groupBy("batch", "block").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(placed)).alias("_s"))
    return g.where(F.col("n") == block).select("batch", "block", F.transform("_s", lambda x: (x % 2 ** 32).cast("int")).alias("input_ids"))
