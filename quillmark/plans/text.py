"""Registered text-feature queries (I1-I6, I9, I10, B7, S1) with DuckDB oracles.

Documents are split train / val / test with the exact stratified split (by
``lang``); vectorisers are fit on train + val (S1) and applied to test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions.numeric import round_sig, sql_round_sig
from quillmark.operators import dataset as ds
from quillmark.operators import text as tx
from quillmark.plans.dataset import split_ctes
from quillmark.session import stage
from quillmark.sources import tables

DIG = 10
MIN_DF, MAX_DF = 5, 0.5
FLAG_COLS = ["n_toxic", "n_low_quality"]


def doc_split(spark, sf):
    d = tables.table(spark, sf, "documents").select("doc_id", "text", "lang")
    # fit and test sides, their counts and vocabularies all read the split: materialise it once
    return stage(ds.exact_split(d, key="doc_id", stratum="lang"), "doc_split")


def _fit_apply(spark, sf):
    s = doc_split(spark, sf)
    fit = s.where(F.col("split").isin("train", "val"))
    test = s.where(F.col("split") == "test")
    return fit, test


def _n(df):
    return df.select(F.count(F.lit(1))).scalar()


def _flags(spark, sf):
    """Dictionary-like table: per term, counts of labelled documents by category."""
    lab = tables.table(spark, sf, "labels")
    labelled = tables.table(spark, sf, "documents").select("doc_id", "text").join(lab.select("doc_id"), "doc_id", "left_semi")
    return tx.doc_terms(labelled).join(lab, "doc_id").groupBy("term").agg(
        F.count_if(F.col("quality") == 1).alias("n_high_quality"),
        F.count_if(F.col("toxic") == 1).alias("n_toxic"),
        F.count_if(F.col("quality") == 0).alias("n_low_quality"))


def q_lexicon(spark, sf):
    return tx.lexicon(None, _flags(spark, sf), FLAG_COLS)


def _rw(df):
    return df.select("doc_id", "term", round_sig(F.col("weight"), DIG).alias("weight"))


def q_tfidf_vocab(spark, sf):
    fit, test = _fit_apply(spark, sf)
    vocab = tx.lexicon(None, _flags(spark, sf), FLAG_COLS)
    idf = stage(tx.idf_table(tx.doc_terms(fit), _n(fit), vocab=vocab), "idf")
    return _rw(tx.tfidf(tx.doc_terms(test), idf))


def q_tfidf_df(spark, sf):
    fit, test = _fit_apply(spark, sf)
    # its size is known once it is written, so the terms of the test documents move only if it is too large to send
    idf = stage(tx.idf_table(tx.doc_terms(fit, stop_words=tx.STOP_WORDS), _n(fit), min_df=MIN_DF, max_df=MAX_DF), "idf")
    return _rw(tx.tfidf(tx.doc_terms(test, stop_words=tx.STOP_WORDS), idf))


def q_hash_features(spark, sf):
    d = tables.table(spark, sf, "documents")
    return _rw(tx.hashed(tx.doc_terms(d, stop_words=tx.STOP_WORDS)))


def q_hash_tfidf(spark, sf):
    fit, test = _fit_apply(spark, sf)
    h_fit = tx.hashed(tx.doc_terms(fit, stop_words=tx.STOP_WORDS))
    h_test = tx.hashed(tx.doc_terms(test, stop_words=tx.STOP_WORDS))
    return _rw(tx.tfidf_transform(h_fit, h_test, _n(fit)))


def _ids(spark, sf):
    fit, _ = _fit_apply(spark, sf)
    # its size is known once it is written, so tokens move only if it is too large to send
    return stage(tx.term_ids(tx.doc_terms(fit)), "token_ids")


def q_encode_pad(spark, sf):
    d = tables.table(spark, sf, "documents")
    return tx.encode(d, _ids(spark, sf), truncate=True)


def q_encode_title(spark, sf):
    """I9, title path: no truncation (short texts), padded to the block length."""
    m = tables.messages(spark, sf)
    return tx.encode(m, _ids(spark, sf), id_col="id", text="title", truncate=False)


def q_pack_blocks(spark, sf):
    d = tables.table(spark, sf, "documents")
    return tx.pack_blocks(d, _ids(spark, sf))


def q_doc_splits(spark, sf):
    """H4 on documents + S1: split sizes per language (train and val together form the fit set)."""
    s = doc_split(spark, sf)
    return s.groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n"),
                                          F.count_if(F.col("split").isin("train", "val")).alias("n_fit"))


# ---------------------------------------------------------------- DuckDB oracles

def R(e):
    return sql_round_sig(e, DIG)


TOK = f"regexp_extract_all(lower(text), '{tx.TOKEN_RE}')"
SW = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


def _terms_sql(src: str, stop: bool = False) -> str:
    where = f" WHERE term NOT IN ({SW})" if stop else ""
    return (f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOK}) AS term FROM {src}){where} "
            "GROUP BY doc_id, term")


def _l2_sql(src: str) -> str:
    return f"SELECT doc_id, term, {R('w / sqrt(sum(w * w) OVER (PARTITION BY doc_id))')} AS weight FROM {src}"


def _with(ctes: dict, body: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ctes.items()) + "\n" + body


def _base() -> dict:
    return {
        "docs": "SELECT doc_id, text, lang FROM documents",
        **split_ctes("dsp", "docs", key="doc_id", stratum="lang"),
        "fit": "SELECT * FROM dsp WHERE split IN ('train', 'val')",
        "tst": "SELECT * FROM dsp WHERE split = 'test'",
        "nfit": "SELECT count(*) AS n FROM fit",
    }


_FLAGS = {
    "all_terms": _terms_sql("documents"),
    "flags": """SELECT t.term, count_if(l.quality = 1) AS n_high_quality, count_if(l.toxic = 1) AS n_toxic,
                count_if(l.quality = 0) AS n_low_quality FROM all_terms t JOIN labels l USING (doc_id) GROUP BY t.term""",
    "lex": "SELECT DISTINCT lower(term) AS term FROM flags WHERE n_toxic <> 0 OR n_low_quality <> 0",
}


def _hash_sql(src_terms: str) -> str:
    b = f"CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % {tx.HASH_FEATURES}"
    sign = "CASE WHEN CAST(('0x' || substr(md5(term), 9, 1)) AS INTEGER) < 8 THEN 1.0 ELSE -1.0 END"
    return (f"SELECT doc_id, term, w FROM (SELECT doc_id, {b} AS term, sum({sign} * tf) AS w FROM {src_terms} "
            "GROUP BY ALL) WHERE w <> 0")


def _ids_ctes() -> dict:
    return {
        **_base(),
        "fit_terms": _terms_sql("fit"),
        "vocab": "SELECT DISTINCT term FROM fit_terms",
        "ids": "SELECT term, CAST(row_number() OVER (ORDER BY md5(term), term) + 1 AS INTEGER) AS token_id FROM vocab",
    }


def _encode_sql(src: str, key: str, text: str, truncate: bool) -> str:
    L = tx.BLOCK_TOKENS
    ids = "ids[1:%d]" % L if truncate else "ids"
    return _with({
        **_ids_ctes(),
        "toks": f"""SELECT {key} AS doc_id, unnest(regexp_extract_all(lower({text}), '{tx.TOKEN_RE}')) AS term,
                    unnest(range(len(regexp_extract_all(lower({text}), '{tx.TOKEN_RE}')))) AS pos FROM {src}""",
        "seq": f"""SELECT doc_id, {ids} AS ids FROM (SELECT t.doc_id, list(coalesce(i.token_id, {tx.UNK_ID}) ORDER BY t.pos) AS ids
                   FROM toks t LEFT JOIN ids i USING (term) WHERE t.term IS NOT NULL GROUP BY t.doc_id)""",
        "every": f"""SELECT x.{key} AS doc_id, coalesce(s.ids, CAST([] AS INTEGER[])) AS ids
                   FROM {src} x LEFT JOIN seq s ON s.doc_id = x.{key}""",
    }, f"""SELECT doc_id, list_concat(ids, list_resize(CAST([] AS INTEGER[]), greatest({L} - len(ids), 0), {tx.PAD_ID})) AS input_ids,
          list_transform(range(greatest(len(ids), {L})), lambda i: CASE WHEN i < len(ids) THEN 1 ELSE 0 END) AS attention_mask
          FROM every""")


QUERIES = {
    "q_lexicon": q_lexicon,
    "q_tfidf_vocab": q_tfidf_vocab,
    "q_tfidf_df": q_tfidf_df,
    "q_hash_features": q_hash_features,
    "q_hash_tfidf": q_hash_tfidf,
    "q_encode_pad": q_encode_pad,
    "q_encode_title": q_encode_title,
    "q_pack_blocks": q_pack_blocks,
    "q_doc_splits": q_doc_splits,
}

ORACLE = {
    "q_lexicon": _with(_FLAGS, "SELECT term FROM lex"),
    "q_tfidf_vocab": _with({
        **_base(), **_FLAGS,
        "fit_terms": _terms_sql("fit"),
        "dfv": "SELECT lex.term, count(f.doc_id) AS df FROM lex LEFT JOIN fit_terms f USING (term) GROUP BY lex.term",
        "idf": "SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM dfv, nfit",
        "w": "SELECT t.doc_id, t.term, t.tf * idf.idf AS w FROM (" + _terms_sql("tst") + ") t JOIN idf USING (term)",
    }, _l2_sql("w")),
    "q_tfidf_df": _with({
        **_base(),
        "fit_terms": _terms_sql("fit", stop=True),
        "dfv": f"""SELECT term, count(*) AS df FROM fit_terms GROUP BY term
                   HAVING count(*) >= {MIN_DF} AND count(*) <= {MAX_DF!r} * (SELECT n FROM nfit)""",
        "idf": "SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM dfv, nfit",
        "w": "SELECT t.doc_id, t.term, t.tf * idf.idf AS w FROM (" + _terms_sql("tst", stop=True) + ") t JOIN idf USING (term)",
    }, _l2_sql("w")),
    "q_hash_features": _with({
        "t": _terms_sql("documents", stop=True),
        "h": _hash_sql("t"),
    }, _l2_sql("h")),
    "q_hash_tfidf": _with({
        **_base(),
        "tf_fit": _terms_sql("fit", stop=True), "tf_tst": _terms_sql("tst", stop=True),
        "hf0": _hash_sql("tf_fit"), "ht0": _hash_sql("tf_tst"),
        "hf": "SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM hf0",
        "ht": "SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM ht0",
        "idf": "SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM hf, nfit WHERE weight <> 0 GROUP BY term, n",
        "w": "SELECT ht.doc_id, ht.term, ht.weight * idf.idf AS w FROM ht JOIN idf USING (term)",
    }, _l2_sql("w")),
    "q_encode_pad": _encode_sql("documents", "doc_id", "text", True),
    "q_encode_title": _encode_sql(
        "(SELECT o_orderkey AS id, o_orderpriority AS title FROM orders)", "id", "title", False),
    "q_pack_blocks": _with({
        **_ids_ctes(),
        "lens": f"SELECT doc_id, floor(doc_id / {tx.PACK_BATCH}) AS batch, len({TOK}) AS len FROM documents",
        "offs": "SELECT doc_id, batch, sum(len) OVER (PARTITION BY batch ORDER BY doc_id) - len AS off FROM lens",
        "toks": f"SELECT doc_id, unnest({TOK}) AS term, unnest(range(len({TOK}))) AS pos FROM documents",
        "g": f"""SELECT o.batch, floor((o.off + t.pos) / {tx.BLOCK_TOKENS}) AS block, count(*) AS n,
                 list(coalesce(i.token_id, {tx.UNK_ID}) ORDER BY o.off + t.pos) AS input_ids
                 FROM toks t JOIN offs o USING (doc_id) LEFT JOIN ids i USING (term) GROUP BY ALL""",
    }, f"SELECT CAST(batch AS BIGINT) AS batch, CAST(block AS BIGINT) AS block, input_ids FROM g WHERE n = {tx.BLOCK_TOKENS}"),
    "q_doc_splits": _with(_base(), """SELECT lang, split, CAST(count(*) AS BIGINT) AS n,
        CAST(count_if(split IN ('train', 'val')) AS BIGINT) AS n_fit FROM dsp GROUP BY lang, split"""),
}
