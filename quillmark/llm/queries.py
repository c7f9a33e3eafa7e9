"""Registered queries of the corpus operators: production parameters over the whole tables.

``ORACLE`` holds the DuckDB text where SQL expresses a query; the other
queries are compared with brute force in ``tests/llm``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.llm import (bin_slack, fim, imatch, language, merkle, mixing, ngram_join, packing, pitman_yor, quality, records,
                           secrets, suffix_dedup)
from quillmark.session import fresh_path
from quillmark.sources.tables import table


def op1_secret_forest(spark, sf):
    """Every candidate of every document with its score; values are given as digests."""
    found = secrets.scan(table(spark, sf, "documents"))
    return found.select("doc_id", "start", F.char_length("value").alias("length"),
                        F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


def op2_isolation_forest(spark, sf):
    """Rule numbers and verdict of every document."""
    return quality.rate(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op3_ftrl_language(spark, sf):
    """Predicted language of every document, learned from three of four folds."""
    return language.identify(table(spark, sf, "documents"))


def op4_token_records(spark, sf):
    """Digests of the ids of every document, read back from the written records."""
    return records.encode(table(spark, sf, "documents"), fresh_path(spark, "records"))


def op5_token_combinations(spark, sf):
    """Component of every document over links of three-word shingles at 90 %."""
    found = ngram_join.near_classes(table(spark, sf, "documents"), n=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id")


def op6_pitman_yor(spark, sf):
    """Log-probabilities of every document, learned from four of five folds."""
    return pitman_yor.score(table(spark, sf, "documents"))


def op7_vector_best_fit(spark, sf):
    """Every piece and its place in the packed sequences."""
    return packing.pack_documents(table(spark, sf, "documents"))


def op8_entropy_balancing(spark, sf):
    """Words that the mix takes of every document."""
    return mixing.mix_report(table(spark, sf, "documents"))


def op9_suffix_array(spark, sf):
    """Bytes removed from every document because a string of 400 bytes repeats."""
    return suffix_dedup.dedup(table(spark, sf, "documents")).drop("kept")


def op10_imatch(spark, sf):
    """Fingerprints of every document and of its edited text."""
    return imatch.fingerprints(table(spark, sf, "documents"))


def op11_merkle_manifest(spark, sf):
    """Leaf, proof and fold of every document; one id in five is verified with its text in lower case."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    text = F.when(hit, merkle.lowered(F.col("text"))).otherwise(F.col("text"))
    return merkle.manifest(table(spark, sf, "documents"), {"text": text})


def op12_bin_slack(spark, sf):
    """Every piece and its place in the sequences."""
    return bin_slack.pack_documents(table(spark, sf, "documents"))


def op13_fill_in_middle(spark, sf):
    """Form and digests of every document's output and of the text restored from it."""
    rows = fim.restore(fim.transform(table(spark, sf, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))


QUERIES = {
    "op1_secret_forest": op1_secret_forest,
    "op2_isolation_forest": op2_isolation_forest,
    "op3_ftrl_language": op3_ftrl_language,
    "op4_token_records": op4_token_records,
    "op5_token_combinations": op5_token_combinations,
    "op6_pitman_yor": op6_pitman_yor,
    "op7_vector_best_fit": op7_vector_best_fit,
    "op8_entropy_balancing": op8_entropy_balancing,
    "op9_suffix_array": op9_suffix_array,
    "op10_imatch": op10_imatch,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_bin_slack": op12_bin_slack,
    "op13_fill_in_middle": op13_fill_in_middle,
}


def base_rule_numbers(spark, sf):
    """The columns of op2 that SQL expresses."""
    return op2_isolation_forest(spark, sf).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                                  "base_failed")


def base_unigram(spark, sf):
    """The columns of op6 that SQL expresses; the base score to four places, as its sum runs in another order."""
    return op6_pitman_yor(spark, sf).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens",
                                            F.round("base_score", 4).alias("base_score"))


def base_mix_targets(spark, sf):
    """The columns of op8 that SQL expresses."""
    return op8_entropy_balancing(spark, sf).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def base_edits(spark, sf):
    """The columns of op10 that SQL expresses."""
    return op10_imatch(spark, sf).select("doc_id", "n_chars", "edited_sha256")


# the operators' own rows, cut to the columns that DuckDB can hold against them
BASE_QUERIES = {
    "base_rule_numbers": base_rule_numbers,
    "base_unigram": base_unigram,
    "base_mix_targets": base_mix_targets,
    "base_edits": base_edits,
}


# ---------------------------------------------------------------- DuckDB oracles

def _with(ctes: list[tuple[str, str]], last: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in ctes) + f"\n{last}"


def _hash(*parts: str) -> str:
    return "sha256(" + " || ".join(parts) + ")"


def _tree_ctes(name: str, lowest: str, levels: int) -> list[tuple[str, str]]:
    """Levels of the hash trees over ``lowest`` (src, pos, h); level k has (src, pos, h, sib), sib the digests of the node's run.

    A tree that is down to one node keeps it at every further level, with no run.
    """
    out = [(f"{name}0", f"SELECT src, pos, h, count(*) OVER (PARTITION BY src) AS n FROM ({lowest})")]
    for k in range(levels):
        out.append((f"{name}_run{k}", f"SELECT src, pos // 16 AS run, list(h ORDER BY pos) AS hs FROM {name}{k} WHERE n > 1 GROUP BY ALL"))
        out.append((f"{name}{k + 1}", f"""SELECT *, count(*) OVER (PARTITION BY src) AS n FROM (
            SELECT src, run AS pos, sha256(array_to_string(hs, '')) AS h FROM {name}_run{k}
            UNION ALL SELECT src, pos, h FROM {name}{k} WHERE n = 1)"""))
    return out


def _climb(source: str, name: str, levels: int, out: str) -> list[tuple[str, str]]:
    """``source`` (src, pos, cur, proof, ...) carried through the levels: cur folded with the siblings, proof appended."""
    ctes, at = [], source
    for k in range(levels):
        ctes.append((f"{out}{k}", f"""SELECT a.* REPLACE (a.pos // 16 AS pos,
              CASE WHEN r.hs IS NULL THEN a.cur ELSE sha256(array_to_string(list_concat(list_concat(
                   r.hs[1:a.pos % 16], [a.cur]), r.hs[a.pos % 16 + 2:]), '')) END AS cur,
              CASE WHEN r.hs IS NULL THEN a.proof ELSE a.proof || array_to_string(r.hs[1:a.pos % 16], '')
                   || array_to_string(r.hs[a.pos % 16 + 2:], '') END AS proof)
            FROM {at} a LEFT JOIN {name}_run{k} r ON r.src = a.src AND r.run = a.pos // 16"""))
        at = f"{out}{k}"
    return ctes


def _crc_ctes(parts: int, wanted: int) -> list[tuple[str, str]]:
    """``ids`` (doc_id, hit): whether the crc32 of the decimal id leaves ``wanted`` when divided by ``parts``."""
    return [
        ("crc_table", """WITH RECURSIVE b(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL
            SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM b WHERE k < 8)
            SELECT list(c ORDER BY i) AS t FROM b WHERE k = 8"""),
        ("ids", f"""SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
            string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
            lambda a, x: xor(a >> 8, t[xor(a, x) % 256 + 1])), 4294967295) % {parts} = {wanted} AS hit
            FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), crc_table"""),
    ]


def _merkle_sql(levels: int = 6, source_levels: int = 4) -> str:
    """Trees of up to 16 ** levels documents a source and 16 ** source_levels sources."""
    def framed(c: str, value: str | None = None) -> str:
        value = value or f"CAST({c} AS VARCHAR)"
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({value}) || ':' || {value} END"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head = [framed(c) for c in merkle.COLUMNS[:-1]]
    return _with([
        *_crc_ctes(5, 0),
        ("leaves", f"""SELECT d.doc_id, coalesce('=' || source, '') AS src, {_hash(*head, framed('text'))} AS h,
            CASE WHEN coalesce(hit, false) THEN {_hash(*head, framed('text', lower))} ELSE {_hash(*head, framed('text'))} END AS other
            FROM documents d LEFT JOIN ids USING (doc_id)"""),
        ("placed", "SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM leaves"),
        *_tree_ctes("a", "SELECT src, pos, h FROM placed", levels),
        ("subroots", f"SELECT src AS name, h, row_number() OVER (ORDER BY encode(src)) - 1 AS pos FROM a{levels}"),
        *_tree_ctes("b", "SELECT '' AS src, pos, h FROM subroots", source_levels),
        ("start", "SELECT doc_id, src, pos, h AS leaf, other AS cur, '' AS proof FROM placed"),
        *_climb("start", "a", levels, "up"),
        ("middle", f"""SELECT u.* REPLACE (s.pos AS pos, '' AS src), s.h AS subroot FROM up{levels - 1} u
            JOIN subroots s ON s.name = u.src"""),
        *_climb("middle", "b", source_levels, "over"),
    ], f"""SELECT o.doc_id, o.leaf, o.subroot, r.h AS root, sha256(o.proof) AS proof_sha256, o.cur AS folded_root,
        o.cur = r.h AS verified FROM over{source_levels - 1} o, b{source_levels} r""")


FIM_SQL = """WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
         sha256('1:' || CAST(doc_id AS VARCHAR)) AS hex FROM documents),
h AS (
  SELECT *, len(units) AS n, CAST('0x' || hex[1:8] AS BIGINT) AS h1, CAST('0x' || hex[9:16] AS BIGINT) AS h2,
         CAST('0x' || hex[17:24] AS BIGINT) AS h3, CAST('0x' || hex[25:32] AS BIGINT) AS h4 FROM u),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (
  SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m,
         array_to_string(units[b + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p"""

ORACLE: dict[str, str] = {
    "op11_merkle_manifest": _merkle_sql(),
    "op13_fill_in_middle": FIM_SQL,
}

_WORD = r"'[^\x20\x09-\x0D]+'"
_WORDS = f"regexp_extract_all(coalesce(text, ''), {_WORD})"

BASE_ORACLE: dict[str, str] = {
    "base_rule_numbers": _with([
        ("d", f"SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents"),
        ("lines", f"SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {_WORD})) AS ls FROM d"),
        ("windows", """SELECT doc_id, i, ws[i:i + 2] AS w FROM
            (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)"""),
        ("twice", "SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS c FROM windows) WHERE c > 1"),
        ("repeated", """SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) t(k) GROUP BY doc_id"""),
        ("numbers", """SELECT d.doc_id, len(ws) AS n_words,
            CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
            length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
            len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
            FROM d JOIN lines USING (doc_id) LEFT JOIN repeated r USING (doc_id)"""),
    ], "SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM numbers"),
    "base_unigram": _with([
        *_crc_ctes(5, 1),
        ("d", f"""SELECT doc_id, coalesce(hit, false) AS held_out, list_append(regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}), ' ') AS ts
            FROM documents LEFT JOIN ids USING (doc_id)"""),
        ("tokens", "SELECT doc_id, held_out, unnest(ts) AS t FROM d"),
        ("counts", "SELECT t, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY t"),
        ("totals", "SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM counts"),
    ], """SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens,
        round(sum(log10((coalesce(c, 0) + 0.5::DOUBLE) / (n::DOUBLE + 0.5::DOUBLE * (v + 1)))), 4) AS base_score
        FROM tokens LEFT JOIN counts USING (t), totals GROUP BY doc_id, held_out"""),
    # the targets fill up to one level per weight: sources below it are full
    "base_mix_targets": _with([
        ("d", f"SELECT doc_id, source, len({_WORDS}) AS size FROM documents"),
        ("s", """SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
            [5, 2, 1][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source"""),
        ("r", """SELECT *, 2.0::DOUBLE * source_size / weight AS full_at, CAST(sum(2 * source_size) OVER w AS BIGINT) - 2 * source_size AS full_size,
            CAST(sum(weight) OVER w AS BIGINT) - weight AS full_weight, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) AS total,
            CAST(sum(weight) OVER () AS BIGINT) AS weights FROM s
            WINDOW w AS (ORDER BY source_size::DOUBLE / weight, source ROWS UNBOUNDED PRECEDING)"""),
        ("level", """SELECT min_by((total - full_size) / (weights - full_weight), full_at) AS u FROM r
            WHERE (total - full_size) / (weights - full_weight) <= full_at"""),
    ], """SELECT doc_id, size, source_size, round(least(2.0::DOUBLE * source_size, weight * u), 3) AS target
        FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source, level"""),
    "base_edits": """SELECT doc_id, length(text) AS n_chars,
        sha256(left(text, length(text) - length(text) // 2) || left(next, length(text) // 2)) AS edited_sha256 FROM (
        SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next
        FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))""",
}
