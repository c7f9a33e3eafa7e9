"""The registered queries over the small tables: contract columns and types, one row per document, whole tables."""

from collections import Counter

import pytest

from quillmark.llm import queries
from quillmark.sources.tables import table
from tests.oracle_compare import duck as duck_tables
from tests.oracle_compare import duck_rows, spark_rows

CONTRACT = {
    "op2_isolation_forest": "doc_id bigint n_words bigint word_chars bigint n_symbols bigint n_dup_lines bigint "
                            "n_repeat_words bigint base_failed boolean kept boolean",
    "op3_ftrl_language": "doc_id bigint held_out boolean lang_pred string score double",
    "op4_token_records": "doc_id bigint start bigint n_tokens bigint ids_crc32 bigint",
    "op5_token_combinations": "doc_id bigint n_shingles bigint component_id bigint",
    "op6_pitman_yor": "doc_id bigint held_out boolean n_tokens bigint n_known bigint train_tokens bigint "
                      "base_score double score double",
    "op7_vector_best_fit": "doc_id bigint piece int start bigint length bigint ids_crc32 bigint sequence_id bigint offset bigint",
    "op8_entropy_balancing": "doc_id bigint size bigint source_size bigint target double taken bigint",
    "op9_suffix_array": "doc_id bigint n_bytes bigint n_removed bigint n_spans bigint kept_sha256 string",
    "op10_imatch": "doc_id bigint n_chars bigint edited_sha256 string fingerprint string edited_fingerprint string "
                   "near_edited double near_next double",
    "op11_merkle_manifest": "doc_id bigint leaf string subroot string root string proof_sha256 string folded_root string "
                            "verified boolean",
    "op12_bin_slack": "doc_id bigint start bigint length bigint ids_crc32 bigint doc_tokens bigint sequence_id bigint offset bigint",
    "op13_fill_in_middle": "doc_id bigint n bigint form string prefix_chars bigint middle_chars bigint output_sha256 string "
                           "restored_sha256 string",
}


def test_every_operator_has_one_query():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", list(CONTRACT))
def test_contract(spark, sf, name):
    words = CONTRACT[name].split()
    df = queries.QUERIES[name](spark, sf)
    kinds = dict(df.dtypes)
    for column, kind in zip(words[::2], words[1::2]):
        assert kinds.get(column) == kind, column
    ids = [r["doc_id"] for r in df.select("doc_id").collect()]
    want = [r["doc_id"] for r in table(spark, sf, "documents").select("doc_id").collect()]
    assert sorted(set(ids) if name.startswith(("op7", "op12")) else ids) == sorted(want)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_oracle(spark, sf, name):
    columns, rows = spark_rows(queries.QUERIES[name](spark, sf))
    duck_columns, duck = duck_rows(duck_tables(sf), queries.ORACLE[name])
    assert columns == duck_columns
    assert Counter(rows) == Counter(duck)


@pytest.mark.parametrize("name", sorted(queries.BASE_ORACLE))
def test_base_columns_match_oracle(spark, sf, name):
    assert set(queries.BASE_ORACLE) == set(queries.BASE_QUERIES)
    columns, rows = spark_rows(queries.BASE_QUERIES[name](spark, sf))
    duck_columns, duck = duck_rows(duck_tables(sf), queries.BASE_ORACLE[name])
    assert columns == duck_columns
    assert Counter(rows) == Counter(duck)
