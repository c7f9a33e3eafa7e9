"""Driver contract: every registered query runs on the whole small tables and
matches its DuckDB oracle (same columns, same multiset of rows)."""

import pytest

import __spark_entry__ as E
from quillmark.plans import registry
from tests.oracle_compare import duck, duck_rows, spark_rows

QUERIES = registry.queries()
ORACLE = registry.oracle_sql()


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


def test_entry_schema_is_stable(spark):
    df = E.entry(spark)
    assert df.columns == ["symbol", "label", "n"]
    assert df.agg({"n": "sum"}).first()[0] > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, sf, name):
    cols, rows = spark_rows(QUERIES[name](spark, sf))
    assert cols
    if name not in ORACLE:
        return
    dcols, drows = duck_rows(duck(sf), ORACLE[name])
    assert cols == dcols
    assert len(rows) == len(drows)
    from collections import Counter
    assert Counter(rows) == Counter(drows)
