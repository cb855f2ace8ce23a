"""The operators bound to the tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

# The roles of tidewire.sources.roles in SQL.
CARDS = """cards AS (SELECT o.o_orderkey AS id, c.c_nationkey AS location_id, o.o_custkey AS source_id, o.o_orderstatus AS category,
  CAST((o.o_orderkey*37) % 201 - 100 AS double)/100 AS bias_signed,
  CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE CAST((o.o_orderkey*13) % 101 AS double)/100 END AS quality,
  CASE WHEN o.o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS is_press,
  CASE WHEN o.o_orderpriority = '5-LOW' THEN NULL ELSE concat('c', CAST(o.o_custkey AS varchar)) END AS cluster_id,
  o.o_orderdate AS created_at FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey)"""
ATTEMPTS = """attempts AS (SELECT event_id, user_id AS source_key, event_type AS method, value*100 AS duration_ms,
  CASE WHEN event_type = 'error' OR event_id % 5 = 0 THEN 0 ELSE 1 END AS success, ts FROM events)"""
LOCATIONS = """locations AS (SELECT 1000 + r_regionkey AS id, r_name AS name, 'region' AS type, CAST(NULL AS int) AS parent_id FROM region
  UNION ALL SELECT n_nationkey, n_name, 'nation', 1000 + n_regionkey FROM nation)"""
TEXTS = """texts AS (SELECT d.doc_id AS id, d.lang AS category, d.source AS source_name, substr(d.text,1,60) AS title, substr(d.text,1,280) AS summary,
  d.text AS body, l.quality AS quality_flag, l.toxic AS press_flag FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def query(sql: str | None = None, *roles: str):
    """Registers a query under its function's name, with its SQL if it has one; ``roles`` go in front of that."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            text = sql.strip()
            if roles and text.upper().startswith("WITH "):
                text = f"WITH {', '.join(roles)}, {text[5:]}"
            elif roles:
                text = f"WITH {', '.join(roles)} {text}"
            ORACLES[f.__name__] = text
        return f

    return add
