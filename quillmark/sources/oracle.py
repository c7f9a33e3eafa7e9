"""DuckDB text of the derived fixture views, for the SQL cross-check.

``with_views(sql, "bars", "messages")`` prefixes a query with the common
table expressions it needs, so every oracle string is self-contained and
runs against the driver's pre-registered base tables.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "bars": """
SELECT 'S' || (l_suppkey % 10) AS symbol, CAST(l_shipdate AS DATE) AS date,
       first(px ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS open,
       max(px) AS high, min(px) AS low,
       last(px ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS close,
       sum(l_quantity) AS volume
FROM (SELECT *, l_extendedprice / l_quantity AS px FROM lineitem) GROUP BY 1, 2""",
    "issuers": """
SELECT c_custkey AS issuerId, c_name AS name, 'S' || (c_custkey % 13) AS symbol FROM customer""",
    "categories": """
SELECT CAST(n_nationkey + 1002 AS INTEGER) AS osl_id, n_name AS category_en, r_name || ' / ' || n_name AS category_no
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "message_keys": """
SELECT o_orderkey AS id, l_orderkey AS messageId FROM orders
LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey""",
    "messages": """
SELECT o_orderkey AS id, o_custkey AS issuerId, o_orderpriority AS title,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE text END AS body,
       '[{''id'': ' || (1000 + o_orderkey % 20) || ', ''category_en'': ''c''}]' AS category,
       o_orderdate + to_seconds((o_orderkey * 7919) % 86400) AS publishedTime,
       CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN 'None'
            ELSE '__label__' || lang END AS weighted_label
FROM orders JOIN documents ON doc_id = o_orderkey % (SELECT count(*) FROM documents)""",
}


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with ``WITH name AS (...)`` for each fixture view and extra CTE."""
    parts = [f"{n} AS ({VIEWS[n]}\n)" for n in names]
    for n, q in (extra or {}).items():
        parts.append(f"{n} AS ({q}\n)")
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body
