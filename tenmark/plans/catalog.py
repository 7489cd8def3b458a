"""The engine's queries and their oracles by name, and the relations that oracles share."""

from __future__ import annotations

import re

QUERIES: dict = {}
ORACLES: dict = {}

#: The same relations for the oracle.
SQL = {
    "docs": "SELECT CAST(o_custkey AS VARCHAR) AS tenant, CAST(o_custkey AS VARCHAR) || ':' || o_orderkey AS _id, * FROM orders",
    "placement": """SELECT CAST(c_custkey AS VARCHAR) AS partition, CASE c_custkey % 3 WHEN 0 THEN 'SharedIndex' WHEN 1 THEN 'DedicatedIndex' ELSE 'DedicatedCluster' END AS kind,
        'c' || (c_nationkey % 4) AS cluster, CASE c_custkey % 3 WHEN 0 THEN 'shared-' || (c_nationkey % 4) WHEN 1 THEN 'orders-' || c_custkey END AS idx,
        CAST(1 + c_custkey % 5 AS BIGINT) AS epoch, CASE c_custkey % 7 WHEN 0 THEN 'draining' WHEN 1 THEN 'cutover' ELSE 'active' END AS phase FROM customer""",
    "req": """SELECT event_id AS seq, 'req-' || event_id AS request_id, *,
        CASE event_type WHEN 'click' THEN 'Search' WHEN 'signup' THEN 'IngestBulk' WHEN 'error' THEN 'Admin' WHEN 'purchase' THEN 'IngestDoc' ELSE CASE WHEN event_id % 5 = 0 THEN 'DeleteById' ELSE 'GetById' END END AS endpoint,
        CASE WHEN event_type IN ('signup', 'error') THEN '' ELSE 'orders' END AS logical_index,
        CASE WHEN event_type IN ('purchase', 'view') THEN CAST(event_id AS VARCHAR) END AS did,
        CASE WHEN event_type <> 'error' AND (event_id % 3 = 0 OR event_id % 4 <> 1) THEN CAST(user_id AS VARCHAR) END AS partition FROM events""",
    "ops": """SELECT l_orderkey AS request_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) - 1 AS ordinal,
        CASE l_returnflag WHEN 'A' THEN 'index' WHEN 'N' THEN 'create' ELSE 'delete' END AS action, l_orderkey || ':' || l_linenumber AS key, 't' || (l_suppkey % 8) AS target, l_partkey AS source FROM lineitem""",
}


def query(sql: str | None = None):
    """Registers a query by its function's name, with its oracle."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            used = [k for k in SQL if f"@{k}" in sql]
            text = sql
            for k in used:
                text = text.replace(f"@{k}", f"t_{k}")
            ctes = ", ".join(f"t_{k} AS ({SQL[k]})" for k in used)
            own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", text)
            if ctes:
                text = f"WITH {own[1] or ''}{ctes}, {text[own.end() :]}" if own else f"WITH {ctes} {text}"
            ORACLES[f.__name__] = text
        return f

    return keep
