"""Key and relationship queries."""

from __future__ import annotations

from assay.operators import profile as P
from assay.operators import relate as R
from assay.sinks.runs import materialize
from checks.lake import SHOP, VIEWS, from_sql, lake, over_profile, over_views, rounded, shaped, view
from checks.q_profile import prof, stored

QUERIES, ORACLE = {}, {}
PARTS = (P.STATS, P.DISTINCT)

RELATE_SQL = """
big AS (SELECT table_name, max(total_count) AS row_count,
               row_number() OVER (ORDER BY max(total_count) DESC, table_name) AS size_rank
        FROM p GROUP BY table_name),
kc AS (SELECT p.* FROM p JOIN big USING (table_name) WHERE size_rank <= 50),
jc AS (
  SELECT a.table_name AS table1, b.table_name AS table2, a.column_name AS column1, a.column_name AS column2,
         a.data_type AS data_type,
         CASE WHEN a.unique_percent > 95 AND b.unique_percent > 95 THEN 'one-to-one'
              WHEN a.unique_percent > 95 THEN 'one-to-many' WHEN b.unique_percent > 95 THEN 'many-to-one'
              ELSE 'many-to-many' END AS cardinality,
         CASE WHEN a.unique_percent > 95 AND b.unique_percent > 95 THEN 'one-to-one'
              WHEN a.unique_percent > 95 THEN 'many-to-one' WHEN b.unique_percent > 95 THEN 'one-to-many'
              ELSE 'many-to-many' END AS reference_label,
         CASE WHEN a.column_name LIKE '%id%' AND (a.unique_percent > 90 OR b.unique_percent > 90) THEN 'high'
              WHEN a.unique_percent > 50 OR b.unique_percent > 50 THEN 'medium' ELSE 'low' END AS confidence,
         'inner' AS join_type, 'same_name' AS pattern
  FROM kc a JOIN kc b ON a.column_name = b.column_name AND a.data_type = b.data_type AND a.table_name < b.table_name
  WHERE regexp_matches(a.column_name, 'id|key|code'))
"""


def edges(spark, sf):
    return R.relationships(stored(spark, sf, parts=PARTS))


def _sql(body: str) -> str:
    return over_profile(f"WITH {RELATE_SQL.strip()}\n{body}")


QUERIES["candidate_keys"] = lambda s, d: shaped(
    R.candidate_keys(prof(s, d, parts=PARTS)).drop("run_id")
)
ORACLE["candidate_keys"] = over_profile(
    """SELECT table_name, column_name, CASE WHEN unique_percent = 100 THEN 'high' ELSE 'medium' END AS confidence,
              CASE WHEN unique_percent = 100 THEN 'unique and complete' ELSE 'id name, nearly unique' END AS reason
       FROM p WHERE (unique_percent = 100 AND null_percent = 0) OR (contains(column_name, 'id') AND unique_percent > 95)"""
)
QUERIES["top_tables"] = lambda s, d: shaped(R.top_tables(prof(s, d), 3).drop("run_id"))
ORACLE["top_tables"] = _sql("SELECT * FROM big WHERE size_rank <= 3")
QUERIES["join_candidates"] = lambda s, d: shaped(
    R.join_candidates(stored(s, d, parts=PARTS)).drop("run_id")
)
ORACLE["join_candidates"] = _sql("SELECT * FROM jc")
QUERIES["join_paths"] = lambda s, d: shaped(R.join_paths(edges(s, d)).drop("run_id"))
ORACLE["join_paths"] = _sql(
    """, e AS (SELECT table1, table2, column1, column2, list_position(['low', 'medium', 'high'], confidence) AS strength FROM jc),
    bothways AS (SELECT * FROM e UNION ALL SELECT table2, table1, column2, column1, strength FROM e)
    SELECT start_table, start_column, middle_table, middle_column, end_table, 2 AS hops,
           ['low', 'medium', 'high'][strength] AS confidence
    FROM (SELECT f.table1 AS start_table, f.column1 AS start_column, f.table2 AS middle_table,
                 s.column1 AS middle_column, s.table2 AS end_table, least(f.strength, s.strength) AS strength
          FROM bothways f JOIN bothways s ON f.table2 = s.table1 AND f.table1 <> s.table2 WHERE f.strength >= 2)"""
)
QUERIES["erd_nodes"] = lambda s, d: shaped(R.erd_nodes(edges(s, d)).drop("run_id"))
ORACLE["erd_nodes"] = _sql(
    "SELECT id, id AS label FROM (SELECT table1 AS id FROM jc UNION SELECT table2 FROM jc)"
)
QUERIES["erd_edges"] = lambda s, d: shaped(R.erd_edges(edges(s, d)).drop("run_id"))
ORACLE["erd_edges"] = _sql(
    "SELECT table1 AS from_table, table2 AS to_table, column1 AS label, cardinality, confidence FROM jc"
)


def _crm(spark, sf):
    """Tables keyed by plain ``id`` columns."""
    texts = {
        "customers": "SELECT c_custkey AS id, c_nationkey AS nation_id FROM {customer}",
        "orders": "SELECT o_orderkey AS id, o_custkey AS customer_id FROM {orders}",
        "nation": "SELECT n_nationkey AS id, n_regionkey AS region_id FROM {nation}",
        "items": "SELECT l_orderkey AS order_id, l_suppkey AS supplier_id FROM {lineitem}",
    }
    return materialize(
        P.profile_tables({n: from_sql(spark, sf, t) for n, t in texts.items()}, parts=PARTS)
    )


QUERIES["fk_naming"] = lambda s, d: shaped(
    R.fk_naming(_crm(s, d)).drop("run_id", "data_type", "reference_label")
)
ORACLE["fk_naming"] = """
WITH c(table_name, column_name) AS (VALUES ('customers', 'id'), ('customers', 'nation_id'), ('orders', 'id'),
  ('orders', 'customer_id'), ('nation', 'id'), ('nation', 'region_id'), ('items', 'order_id'), ('items', 'supplier_id'))
SELECT a.table_name AS table1, b.table_name AS table2, a.column_name AS column1, b.column_name AS column2,
       'many-to-one' AS cardinality, 'medium' AS confidence, 'left' AS join_type, 'foreign_key_naming' AS pattern
FROM c a JOIN c b ON a.table_name <> b.table_name AND b.column_name = 'id'
 AND (a.column_name = b.table_name || '_id'
      OR (a.column_name LIKE '%\\_id' ESCAPE '\\' AND replace(a.column_name, '_id', '') || 's' = b.table_name))
"""

# --- checks on the data -------------------------------------------------------

QUERIES["pk_violations"] = lambda s, d: shaped(R.pk_violations(view(s, d, "orders"), ["customer_id", "order_date"]))
ORACLE["pk_violations"] = over_views(
    """SELECT customer_id, order_date, count(*) AS row_count,
              CASE WHEN customer_id IS NULL OR order_date IS NULL THEN 'null key' ELSE 'repeated key' END AS violation
       FROM v_orders GROUP BY customer_id, order_date
       HAVING count(*) > 1 OR customer_id IS NULL OR order_date IS NULL""",
    ["orders"],
)


def _orphans(spark, sf):
    rich = from_sql(spark, sf, "SELECT c_custkey FROM {customer} WHERE c_acctbal > 0")
    return shaped(R.fk_orphans(view(spark, sf, "orders"), ["customer_id"], rich, ["c_custkey"]))


QUERIES["fk_orphans"] = _orphans
ORACLE["fk_orphans"] = over_views(
    """SELECT customer_id, count(*) AS row_count FROM v_orders o
       WHERE customer_id IS NOT NULL AND NOT EXISTS
         (SELECT 1 FROM customer c WHERE c.c_custkey = o.customer_id AND c.c_acctbal > 0)
       GROUP BY customer_id""",
    ["orders"],
)


def _overlap(spark, sf):
    rich = from_sql(spark, sf, "SELECT c_custkey FROM {customer} WHERE c_acctbal > 0")
    return shaped(R.value_overlap(view(spark, sf, "orders"), "customer_id", rich, "c_custkey"))


QUERIES["fk_overlap"] = _overlap
ORACLE["fk_overlap"] = rounded(
    over_views(
        """SELECT count(*) AS child_values, count(k) AS matched_values, CAST(sum(n) AS BIGINT) AS child_rows,
                  CAST(coalesce(sum(n) FILTER (k IS NOT NULL), 0) AS BIGINT) AS matched_rows,
                  count(k) * 100.0 / count(*) AS overlap_percent, count(k) * 100.0 / count(*) >= 80 AS is_included
           FROM (SELECT customer_id, count(*) AS n FROM v_orders WHERE customer_id IS NOT NULL GROUP BY 1) c
           LEFT JOIN (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0) ON k = customer_id""",
        ["orders"],
    ),
    ["overlap_percent"],
)

# --- the whole lake at once ---------------------------------------------------

QUERIES["inclusion_dependencies"] = lambda s, d: shaped(R.inclusion_dependencies(lake(s, d)))


def _inclusion_sql() -> str:
    """Every column's distinct values, joined column by column."""
    kinds = {"int": ("i", "BIGINT"), "bigint": ("i", "BIGINT"), "double": ("n", "DOUBLE"), "string": ("s", "VARCHAR")}
    parts = []
    for t in SHOP:
        for c, kind, category in VIEWS[t][1]:
            cls, cast = ("t", "TIMESTAMP") if category == "datetime" else kinds.get(kind, ("n", "DOUBLE") if category == "numeric" else (None, None))
            if cls:
                parts.append(f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, '{cls}' AS k, CAST(CAST({c} AS {cast}) AS VARCHAR) AS v FROM v_{t} WHERE {c} IS NOT NULL")
    values = "\nUNION ALL ".join(parts)
    return over_views(f""", x AS MATERIALIZED ({values}), own AS (SELECT t, c, count(*) AS n FROM x GROUP BY t, c),
m AS (SELECT a.t AS child_table, a.c AS child_column, b.t AS parent_table, b.c AS parent_column, count(*) AS matched_values
      FROM x a JOIN x b ON a.k = b.k AND a.v = b.v AND (a.t <> b.t OR a.c <> b.c) GROUP BY ALL)
SELECT m.*, n AS child_values, matched_values * 100.0 / n AS overlap_percent, matched_values = n AS is_included
FROM m JOIN own ON own.t = child_table AND own.c = child_column WHERE matched_values * 100.0 / n >= 80""")


ORACLE["inclusion_dependencies"] = rounded(_inclusion_sql(), ["overlap_percent"])
QUERIES["join_classes"] = lambda s, d: shaped(R.join_classes(stored(s, d, parts=PARTS)).drop("run_id"))
ORACLE["join_classes"] = over_profile(
    """SELECT * FROM (
         SELECT column_name, data_type, table_name, unique_percent > 95 AS is_key, count(*) OVER w AS members,
                count(*) FILTER (unique_percent > 95) OVER w AS keys,
                CASE WHEN column_name LIKE '%id%' AND max(unique_percent) OVER w > 90 THEN 'high'
                     WHEN max(unique_percent) OVER w > 50 THEN 'medium' ELSE 'low' END AS confidence
         FROM p WHERE regexp_matches(column_name, 'id|key|code') WINDOW w AS (PARTITION BY column_name, data_type))
       WHERE members > 1"""
)
QUERIES["path_hubs"] = lambda s, d: shaped(R.path_hubs(edges(s, d)).drop("run_id"))
ORACLE["path_hubs"] = _sql(
    """, e AS (SELECT table1, table2, list_position(['low', 'medium', 'high'], confidence) AS strength FROM jc),
    bothways AS (SELECT * FROM e UNION ALL SELECT table2, table1, strength FROM e)
    SELECT middle_table, any_value(n) AS neighbours, count(*) AS paths, count(*) FILTER (weak = 3) AS sure_paths,
           ['low', 'medium', 'high'][max(weak)] AS confidence
    FROM (SELECT f.table2 AS middle_table, least(f.strength, s.strength) AS weak
          FROM bothways f JOIN bothways s ON f.table2 = s.table1 AND f.table1 <> s.table2 WHERE f.strength >= 2)
    JOIN (SELECT table2 AS middle_table, count(DISTINCT table1) AS n FROM bothways GROUP BY 1) USING (middle_table)
    GROUP BY middle_table"""
)
