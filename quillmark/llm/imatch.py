"""I-Match fingerprints over randomised lexicon subsets.

Terms (words as they stand) count when their inverse document frequency lies in a
band: ln(N / df) between ``idf_low`` and ``idf_high``.  The upper end is a fixed
number, so at most (distinct terms a document) * exp(idf_high) terms can lie
in the band however large the corpus is; they are held as a bit map over
``2**bits`` hash buckets, and a term's document frequency is its bucket's.

``SUBSETS`` lexicons are drawn from the band by hash: each level deals a random
share of it (all, a quarter, ...) to ten lexicons.  A fingerprint is one 32-bit hash per lexicon over the
sorted distinct terms of the document that the lexicon keeps; lexicons that keep no
term give zeros.  Equal texts have equal fingerprints; the classic I-Match test,
"some lexicon agrees", is ``likeness`` > 0.
Without any term in the band the hash of the whole text takes every place.

Only DataFrame and SQL functions are used.

Defined cases: a null text is an empty one; repeated rows are rows of their own;
the next document is the next row by (doc_id, text hash), nulls first, and the last row's is the
first row; a single row is its own next; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.common import parts, words_col

ZERO = "00000000"
LEVELS = 7       # level k deals a share of 4**-k of the band to its lexicons: for short to very long texts
PER_LEVEL = 10   # lexicons of a level; a term of the share belongs to one of them
SUBSETS = LEVELS * PER_LEVEL


def _bucket(term: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(term), 64 - bits).cast("int")


def band(docs: DataFrame, idf_low: float, idf_high: float, bits: int) -> DataFrame:
    """One row with the bit map of buckets whose inverse document frequency lies in the band (64 a word)."""
    n = docs.count()
    terms = F.array_distinct(F.transform(F.array_distinct(words_col(F.col("text"))), lambda w: _bucket(w, bits)))
    df = docs.select(F.explode(terms).alias("b")).groupBy("b").count()
    most, least = n * math.exp(-idf_low), n * math.exp(-idf_high)
    inside = df.where(F.col("count").between(least, most))
    words = (inside.groupBy(F.expr("b div 64").alias("word"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 AS int)))").alias("m")))
    # all words of the map in order, absent ones as 0: 2**(bits - 6) numbers whatever the corpus size
    every = docs.sparkSession.range(1 << (bits - 6)).withColumnRenamed("id", "word").join(words, "word", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("m", F.lit(0)).alias("m")))),
                                 lambda s: s["m"]).alias("map"))


def with_fingerprint(rows: DataFrame, text: str, out: str, lexicon: Column, bits: int) -> DataFrame:
    """Adds the fingerprint of column ``text``; ``lexicon`` is the band's bit map."""
    def inside(w: Column) -> Column:
        b = _bucket(w, bits)
        return F.getbit(F.element_at(lexicon, F.shiftright(b, 6) + 1), F.pmod(b, F.lit(64))) == 1

    terms = F.sort_array(F.filter(F.array_distinct(words_col(F.col(text))), inside))
    # one hash of a term says how many levels it takes part in (two bits a level) and in which lexicon of each
    rows = rows.withColumn("_h0", F.transform(terms, lambda w: F.xxhash64(F.lit(17), w)))
    for k in range(1, LEVELS):
        rows = rows.withColumn(f"_h{k}", _share(f"_h{k - 1}", k))

    def part(k: int, j: int) -> Column:
        kept = F.filter(f"_h{k}", lambda h: F.pmod(F.shiftright(h, 16), F.lit(PER_LEVEL)) == j)
        return F.when(F.size(kept) == 0, F.lit(ZERO)).otherwise(_hex(F.xxhash64(kept)))

    parts = [part(k, j) for k in range(LEVELS) for j in range(PER_LEVEL)]
    whole = F.repeat(_hex(F.xxhash64(text)), SUBSETS)
    mark = F.when(F.size("_h0") == 0, whole).otherwise(F.concat(*parts))
    return rows.withColumn(out, mark).drop(*[f"_h{k}" for k in range(LEVELS)])


def _share(hashes: str, k: int) -> Column:
    """The quarter of a level's terms that takes part in the next one."""
    return F.filter(hashes, lambda h: F.shiftright(h, 2 * k).bitwiseAND(F.lit(3)) == 0)


def _hex(h: Column) -> Column:
    return F.lpad(F.lower(F.hex(h.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")


def likeness(a: str, b: str, least: int = 3, dense: int = 3) -> Column:
    """Largest share of equal hashes over neighbouring levels or the sparsest one alone, among their lexicons of
    which either text has a term.

    The levels whose lexicons hold one or two terms of these texts tell most, two of them together against
    chance; with few such lexicons they count as if there were ``least``, from level ``dense`` on as if half had a
    term, as a chance term that both texts hold says little there.  Equal fingerprints give 1.
    """
    def share(k: int) -> Column:
        first, last = k * PER_LEVEL, min((k + 2) * PER_LEVEL, SUBSETS)
        at = F.sequence(F.lit(first), F.lit(last - 1))
        few = least if k < dense else (last - first) // 2
        pairs = F.transform(at, lambda i: F.struct(F.substring(F.col(a), i * 8 + 1, F.lit(8)).alias("x"),
                                                   F.substring(F.col(b), i * 8 + 1, F.lit(8)).alias("y")))
        return F.aggregate(pairs, F.struct(F.lit(0).alias("same"), F.lit(0).alias("used")), lambda s, p: F.struct(
            (s["same"] + ((p["x"] == p["y"]) & (p["x"] != ZERO)).cast("int")).alias("same"),
            (s["used"] + ((p["x"] != ZERO) | (p["y"] != ZERO)).cast("int")).alias("used")),
            lambda s: s["same"] / F.greatest(s["used"], F.lit(few)))

    return F.when(F.col(a) == F.col(b), 1.0).otherwise(F.greatest(*[share(k) for k in range(LEVELS)]))


def _ranges(docs: DataFrame, n: int) -> Column:
    """Number of the id range of a row, from about equal ranges; null ids come first."""
    at = [i / n for i in range(1, n)]
    cuts = docs.agg(F.percentile_approx("doc_id", at, 20 * n)).first()[0] if n > 1 else None
    if not cuts:
        return F.when(F.col("doc_id").isNull(), -1).otherwise(0)
    step = max(1, math.isqrt(len(cuts)))  # two short searches instead of one long
    coarse = F.lit(cuts[step - 1::step])
    block = F.size(F.filter(coarse, lambda c: c <= F.col("doc_id"))) * step
    rest = F.filter(F.slice(F.lit(cuts), block + 1, F.lit(step)), lambda c: c <= F.col("doc_id"))
    return F.when(F.col("doc_id").isNull(), -1).otherwise(block + F.size(rest))


def _with_first_of_next(rows: DataFrame) -> DataFrame:
    """Rows plus, at the end of each range, the first row of the next one (``extra``); the last range gets the first.

    What reaches the driver is one key per range.
    """
    key = F.struct("doc_id", "hash")
    first = sorted((r["range"], r["k"]["doc_id"], r["k"]["hash"]) for r in
                   rows.groupBy("range").agg(F.min(key).alias("k")).collect())
    follow = [(a[0], *b[1:]) for a, b in zip(first, first[1:] + first[:1])]
    keys = rows.sparkSession.createDataFrame(follow, "range int, _id long, _hash long")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    extra = (rows.drop("range").join(F.broadcast(keys), same).drop("_id", "_hash")  # one row per range
             .dropDuplicates(["range"]).withColumn("extra", F.lit(True)))
    return rows.withColumn("extra", F.lit(False)).unionByName(extra)


def fingerprints(docs: DataFrame, idf_low: float = math.log(5), idf_high: float = math.log(1000), bits: int = 20,
                 ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text replaces the last half of a text's code points by the first as many of the next document.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = band(rows, idf_low, idf_high, bits).first()[0]
    lexicon = F.lit(np.array(found, dtype=np.int64))
    n = ranges or parts(spark)
    rows = rows.withColumn("range", _ranges(rows, n)).withColumn("hash", F.xxhash64("text"))
    rows = with_fingerprint(_with_first_of_next(rows), "text", "fingerprint", lexicon, bits)
    order = Window.partitionBy("range").orderBy("extra", F.col("doc_id").asc_nulls_first(), "hash", "text")
    rows = (rows.withColumn("next_text", F.lead("text").over(order))
            .withColumn("next_fingerprint", F.lead("fingerprint").over(order)).where("not extra"))
    chars = F.char_length("text")
    half = F.floor(chars / 2).cast("int")
    rows = rows.select("doc_id", chars.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint",
                       F.concat(F.left("text", chars - half), F.left("next_text", half)).alias("edited"))
    rows = with_fingerprint(rows, "edited", "edited_fingerprint", lexicon, bits)
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint",
                       "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
                       likeness("fingerprint", "next_fingerprint").alias("near_next"))
