"""Quality and structure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.operators import duplicates as D
from assay.operators import hidden as H
from assay.operators import profile as P
from assay.operators import quality as Q
from assay.operators import structure as T
from checks.lake import AS_OF, SHOP, from_sql, lake, over_profile, over_views, shaped, sql_duplicates
from checks.q_profile import prof, stored

QUERIES, ORACLE = {}, {}

# all component rows, as SQL over p and d
COMPONENT_SQL = f"""
c AS (
  SELECT *, total_count - null_count AS present,
         regexp_matches(column_name, 'amount|total|quantity|price|count') AND type_category = 'numeric' AS amount_like,
         coalesce(negative_count, 0) * 100.0 / greatest(total_count - null_count, 1) AS neg,
         coalesce(future_count, 0) * 100.0 / greatest(total_count - null_count, 1) AS fut,
         floor(date_diff('second', max_ts, TIMESTAMP '{AS_OF}') / 86400.0) AS age,
         (type_category = 'datetime' OR (type_category = 'string' AND regexp_matches(column_name, 'date|time|created|updated'))) AS date_like
  FROM p),
v AS (SELECT *, 100 - CASE WHEN amount_like THEN least(neg, 50) ELSE 0 END - least(fut, 50) AS pass_rate FROM c),
r AS (
  SELECT table_name, column_name, 'missingness' AS component, 'null_percent' AS metric, round(null_percent, 2) AS value,
         CASE WHEN null_percent <= 50 THEN 'pass' WHEN null_percent <= 75 THEN 'warning' ELSE 'error' END AS status,
         greatest(0, 100 - null_percent) AS score, true AS is_check FROM c
  UNION ALL
  SELECT table_name, column_name, 'validity', 'rule_pass_rate', round(pass_rate, 2),
         CASE WHEN pass_rate >= 90 THEN 'pass' WHEN pass_rate >= 50 THEN 'warning' ELSE 'error' END,
         greatest(pass_rate, 0), pass_rate < 100 FROM v
  UNION ALL
  SELECT table_name, '__all__', 'uniqueness', 'duplicate_rate_percent', round(duplicate_percent, 2),
         CASE WHEN duplicate_percent < 1 THEN 'pass' WHEN duplicate_percent < 5 THEN 'warning' ELSE 'error' END,
         greatest(0, 100 - 5 * duplicate_percent), true FROM d
  UNION ALL
  SELECT table_name, column_name, 'freshness', 'days_since_update', age,
         CASE WHEN age <= 7 THEN 'pass' WHEN age <= 90 THEN 'warning' ELSE 'error' END,
         least(greatest(0, 100 * (1 - age / 90)), 100), true FROM c WHERE date_like AND age IS NOT NULL
  UNION ALL
  SELECT table_name, NULL, 'freshness', 'days_since_update', NULL, 'info', 100, true FROM c
  GROUP BY table_name HAVING NOT bool_or(date_like)
  UNION ALL
  SELECT table_name, column_name, 'integrity', 'fk_null_percent', round(null_percent, 2),
         CASE WHEN null_percent <= 20 THEN 'warning' ELSE 'error' END,
         greatest(0, 100 - 2 * null_percent), null_percent > 5 FROM c WHERE column_name LIKE '%\\_id' ESCAPE '\\'
  UNION ALL
  SELECT table_name, column_name, 'integrity', 'negative_values', negative_count,
         CASE WHEN neg < 5 THEN 'warning' ELSE 'error' END,
         greatest(0, 100 - 5 * neg), true FROM c WHERE amount_like AND neg > 0),
ck AS (
  SELECT table_name, component AS "check", column_name, metric, value, status,
         CASE WHEN status = 'error' AND component IN ('missingness', 'validity') THEN 'critical'
              WHEN status IN ('error', 'warning') THEN 'major' ELSE 'minor' END AS severity
  FROM r WHERE is_check),
s AS (
  SELECT table_name,
         round(coalesce(avg(score) FILTER (component = 'missingness'), 100), 1) AS missingness,
         round(coalesce(avg(score) FILTER (component = 'validity'), 100), 1) AS validity,
         round(coalesce(avg(score) FILTER (component = 'uniqueness'), 100), 1) AS uniqueness,
         round(coalesce(max(score) FILTER (component = 'freshness'), 100), 1) AS freshness,
         round(coalesce(avg(score) FILTER (component = 'integrity'), 100), 1) AS integrity
  FROM r GROUP BY table_name)
"""


def rows(spark, sf, parts=(P.STATS,)):
    tables = lake(spark, sf)
    p = stored(spark, sf, parts=parts)
    return Q.component_rows(p, D.duplicates(tables), AS_OF)


def _sql(body: str) -> str:
    return over_profile(f"WITH {COMPONENT_SQL.strip()}\n{body}", duplicates=True)


def _component(name):
    QUERIES[f"quality_{name}"] = lambda spark, sf: shaped(
        Q.checks(rows(spark, sf)).where(F.col("check") == name).drop("run_id")
    )
    ORACLE[f"quality_{name}"] = _sql(f"""SELECT * FROM ck WHERE "check" = '{name}'""")


for _name in ("missingness", "validity", "uniqueness", "freshness", "integrity"):
    _component(_name)

_WEIGHTED = (
    "round(missingness * 0.3 + validity * 0.3 + uniqueness * 0.2 + freshness * 0.1 + integrity * 0.1, 1)"
)
QUERIES["quality_score"] = lambda spark, sf: shaped(Q.scores(rows(spark, sf)).drop("run_id"))
ORACLE["quality_score"] = _sql(f"SELECT *, {_WEIGHTED} AS overall_score FROM s")

QUERIES["quality_severity"] = lambda spark, sf: shaped(
    Q.severity_counts(rows(spark, sf)).drop("run_id")
)
_SEVERITIES = ", ".join(
    f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "major", "minor")
)
ORACLE["quality_severity"] = _sql(f"SELECT table_name, {_SEVERITIES} FROM ck GROUP BY table_name")

QUERIES["quality_overall"] = lambda spark, sf: shaped(Q.overall(rows(spark, sf)).drop("run_id"))
_MEANS = ", ".join(
    f"round(avg({c}), 1) AS {c}" for c in ("missingness", "validity", "uniqueness", "freshness", "integrity")
)
ORACLE["quality_overall"] = _sql(
    f"""SELECT m.*, {_WEIGHTED} AS overall_score, critical, major, minor
        FROM (SELECT count(*) AS table_count, {_MEANS} FROM s) m,
             (SELECT {_SEVERITIES} FROM ck) k"""
)


def _flags(spark, sf):
    tables = lake(spark, sf)
    p = stored(spark, sf, parts=(P.STATS, P.DISTINCT, P.PATTERNS))
    found = Q.component_rows(p, D.duplicates(tables), AS_OF)
    return shaped(Q.flags(p, found, H.verdicts(H.hidden_types(p))).drop("run_id"))


VERDICT_SQL = """
hr AS (
  SELECT table_name, column_name, unique_count, unique_percent, avg_length, nonblank_count,
         object_count / nonblank_count AS obj, array_count / nonblank_count AS arr,
         number_count / nonblank_count AS num, date_count / nonblank_count AS dat,
         boolean_count / nonblank_count AS boo, markup_count / nonblank_count AS mar
  FROM p WHERE type_category = 'string' AND nonblank_count > 0),
hf AS (
  SELECT *, unique_percent < 2 AND unique_count <= 20 AS is_enum FROM hr
  WHERE obj > 0 OR arr > 0 OR num >= 0.8 OR (unique_percent < 2 AND unique_count <= 20)
     OR dat >= 0.5 OR boo = 1 OR avg_length > 500),
hv AS (
  SELECT *, CASE WHEN obj >= 0.5 THEN 'json_object' WHEN arr >= 0.5 THEN 'json_array'
                 WHEN boo = 1 THEN 'boolean_as_string' WHEN num >= 0.8 THEN 'numeric_as_string'
                 WHEN dat >= 0.5 THEN 'date_as_string' WHEN mar >= 0.5 THEN 'html_xml'
                 WHEN is_enum THEN 'categorical_enum' ELSE 'free_text' END AS detected_type FROM hf),
hw AS (
  SELECT *, CASE detected_type
              WHEN 'numeric_as_string' THEN CASE WHEN num >= 0.9 THEN 0.7 ELSE 0.45 END
              WHEN 'date_as_string' THEN CASE WHEN dat >= 0.5 THEN 0.7 ELSE 0.45 END
              WHEN 'boolean_as_string' THEN CASE WHEN unique_count <= 3 THEN 0.7 ELSE 0.6 END
              ELSE 0.6 END AS confidence FROM hv),
verdict AS (
  SELECT table_name, column_name, 'string' AS current_type, detected_type, CAST(confidence AS DOUBLE) AS confidence,
         CASE WHEN detected_type IN ('numeric_as_string', 'date_as_string') THEN 'critical'
              WHEN detected_type IN ('categorical_enum', 'free_text') THEN 'info' ELSE 'warning' END AS severity
  FROM hw WHERE confidence >= 0.5)
"""

QUERIES["quality_flags"] = _flags
ORACLE["quality_flags"] = over_profile(
    f"""WITH {COMPONENT_SQL.strip()}, {VERDICT_SQL.strip()}
    SELECT *, CASE WHEN severity IN ('high', 'critical') THEN 0 WHEN severity IN ('medium', 'warning') THEN 1
                   WHEN severity = 'low' THEN 2 ELSE 3 END AS severity_rank FROM (
      SELECT table_name, column_name, 'High Null Rate' AS flag, 'high' AS severity, round(null_percent, 1) AS value
      FROM p WHERE null_percent > 50
      UNION ALL SELECT table_name, column_name, 'High Cardinality', 'medium', round(unique_percent, 0)
      FROM p WHERE type_category = 'string' AND unique_percent > 90
      UNION ALL SELECT table_name, column_name, 'Constant Column', 'medium', unique_count
      FROM p WHERE unique_count <= 1 AND null_percent < 100
      UNION ALL SELECT table_name, column_name, "check", CASE WHEN status = 'error' THEN 'high' ELSE 'medium' END, value
      FROM ck WHERE status IN ('warning', 'error')
      UNION ALL SELECT table_name, column_name, 'Type Mismatch', severity, confidence FROM verdict)""",
    duplicates=True,
)

# --- hidden types -------------------------------------------------------------


def _hidden(spark, sf):
    return shaped(H.hidden_types(prof(spark, sf, parts=(P.STATS, P.DISTINCT, P.TOP, P.PATTERNS))).drop("run_id"))


QUERIES["hidden_types"] = _hidden
ORACLE["hidden_types"] = over_profile(
    """SELECT table_name, column_name, round(null_percent, 1) AS null_percent, unique_count,
              round(unique_percent, 6) AS unique_percent, min_length, max_length, round(avg_length, 6) AS avg_length,
              nonblank_count, round(obj, 6) AS object_rate, round(arr, 6) AS array_rate, round(num, 6) AS number_rate,
              round(dat, 6) AS date_rate, round(boo, 6) AS boolean_rate, round(mar, 6) AS markup_rate,
              array_to_string(sig, '|') AS signals, len(sig) > 0 AS is_flagged,
              coalesce((SELECT string_agg(value, '|' ORDER BY rank) FROM tops
               WHERE tops.table_name = q.table_name AND tops.column_name = q.column_name AND rank <= 5), '') AS samples
       FROM (SELECT *, CASE WHEN nonblank_count = 0 THEN [] ELSE list_filter(
                  [CASE WHEN obj > 0 OR arr > 0 THEN 'json' END, CASE WHEN num >= 0.8 THEN 'number' END,
                   CASE WHEN unique_percent < 2 AND unique_count <= 20 THEN 'enum' END,
                   CASE WHEN dat >= 0.5 THEN 'date' END, CASE WHEN boo = 1 THEN 'boolean' END,
                   CASE WHEN avg_length > 500 THEN 'long' END], lambda e: e IS NOT NULL) END AS sig
             FROM (SELECT *, coalesce(object_count / nullif(nonblank_count, 0), 0) AS obj,
                          coalesce(array_count / nullif(nonblank_count, 0), 0) AS arr,
                          coalesce(number_count / nullif(nonblank_count, 0), 0) AS num,
                          coalesce(date_count / nullif(nonblank_count, 0), 0) AS dat,
                          coalesce(boolean_count / nullif(nonblank_count, 0), 0) AS boo,
                          coalesce(markup_count / nullif(nonblank_count, 0), 0) AS mar
                   FROM p WHERE type_category = 'string')) AS q""",
    tops=True,
)


def _blanks(spark, sf):
    """Values that hold blanks of many kinds, or something after them."""
    df = from_sql(spark, sf, _BLANK_TEXTS.format(orders="{orders}", chr="char"))
    found = P.profile_tables({"t": df}, parts=(P.STATS, P.PATTERNS))
    return shaped(found.select("column_name", "nonblank_count", "object_count", "array_count", "boolean_count"))


_BLANK_TEXTS = """SELECT CASE o_orderkey % 3 WHEN 0 THEN concat({chr}(9), {chr}(10)) WHEN 1 THEN concat({chr}(10), '[1]') ELSE concat({chr}(9), 'yes', {chr}(13)) END AS a,
    CASE WHEN o_orderkey % 2 = 0 THEN concat({chr}(10), {chr}(32), '{{{{"k": 1}}}}') ELSE concat({chr}(11), {chr}(160)) END AS b FROM {orders}"""
QUERIES["hidden_types_blanks"] = _blanks
ORACLE["hidden_types_blanks"] = f"""
WITH t AS ({_BLANK_TEXTS.format(orders="orders", chr="chr").replace("{{", "{").replace("}}", "}")})
SELECT 'a' AS column_name, count(*) FILTER (o_orderkey % 3 <> 0) AS nonblank_count, 0 AS object_count,
       count(*) FILTER (o_orderkey % 3 = 1) AS array_count, count(*) FILTER (o_orderkey % 3 = 2) AS boolean_count FROM orders
UNION ALL SELECT 'b', count(*) FILTER (o_orderkey % 2 = 0), count(*) FILTER (o_orderkey % 2 = 0), 0, 0 FROM orders"""
QUERIES["hidden_type_verdict"] = lambda spark, sf: shaped(
    H.verdicts(H.hidden_types(prof(spark, sf, parts=(P.STATS, P.DISTINCT, P.PATTERNS)))).drop("run_id")
)
ORACLE["hidden_type_verdict"] = over_profile(f"WITH {VERDICT_SQL.strip()} SELECT * FROM verdict")

# --- structure ----------------------------------------------------------------

FLAGGED_SQL = """
fl AS (SELECT *, unique_count <= 1 AND null_percent < 100 AS is_constant,
         (list_has_any(string_split(lower(column_name), '_'), ['id','uid','uuid','key','pk','index','idx','code','ref'])
          OR lower(column_name) LIKE '%\\_id' ESCAPE '\\') AND unique_percent > 95 AND total_count > 10 AS is_suspicious
       FROM p),
ov AS (SELECT table_name, max(total_count) AS row_count, count(*) AS column_count,
         count(*) FILTER (null_percent > 0) AS columns_with_nulls,
         count(*) FILTER (null_percent >= 99.9) AS columns_fully_null,
         count(*) FILTER (is_constant) AS n_constant, count(*) FILTER (is_suspicious) AS n_suspicious,
         coalesce(string_agg(column_name, '|' ORDER BY column_name) FILTER (is_constant), '') AS constant_columns,
         coalesce(string_agg(column_name, '|' ORDER BY column_name) FILTER (is_suspicious), '') AS suspicious_id_columns
       FROM fl GROUP BY table_name)
"""


def _overview(spark, sf):
    tables = lake(spark, sf)
    p = P.profile_tables(tables, as_of=AS_OF, parts=(P.STATS, P.DISTINCT))
    return p, D.duplicates(tables)


QUERIES["structural_overview"] = lambda spark, sf: shaped(
    T.table_overview(*_overview(spark, sf)).drop("run_id")
)
ORACLE["structural_overview"] = over_profile(
    f"""WITH {FLAGGED_SQL.strip()}
    SELECT ov.* EXCLUDE (n_constant, n_suspicious), duplicate_rows, round(duplicate_percent, 2) AS duplicate_percent
    FROM ov JOIN d USING (table_name)""",
    duplicates=True,
)
QUERIES["dataset_overview"] = lambda spark, sf: shaped(
    T.dataset_overview(*_overview(spark, sf)).drop("run_id")
)
OVERVIEW_TOTAL_SQL = """SELECT count(*) AS table_count, CAST(sum(ov.row_count) AS BIGINT) AS total_rows,
       CAST(sum(column_count) AS BIGINT) AS total_columns, CAST(sum(duplicate_rows) AS BIGINT) AS total_duplicate_rows,
       round(sum(duplicate_rows) * 100.0 / sum(ov.row_count), 2) AS duplicate_percent,
       CAST(sum(columns_with_nulls) AS BIGINT) AS columns_with_nulls,
       CAST(sum(columns_fully_null) AS BIGINT) AS columns_fully_null,
       CAST(sum(n_constant) AS BIGINT) AS constant_columns, CAST(sum(n_suspicious) AS BIGINT) AS suspicious_id_columns
FROM ov JOIN d USING (table_name)"""
ORACLE["dataset_overview"] = over_profile(
    f"WITH {FLAGGED_SQL.strip()} {OVERVIEW_TOTAL_SQL}", duplicates=True
)
QUERIES["suspicious_ids"] = lambda spark, sf: shaped(
    T.suspicious_ids(prof(spark, sf, parts=(P.STATS, P.DISTINCT))).drop("run_id")
)
ORACLE["suspicious_ids"] = over_profile(
    f"WITH {FLAGGED_SQL.strip()} SELECT table_name, column_name, round(unique_percent, 6) AS unique_percent "
    "FROM fl WHERE is_suspicious"
)
QUERIES["duplicate_rows"] = lambda spark, sf: shaped(D.duplicates(lake(spark, sf)).drop("run_id"))
ORACLE["duplicate_rows"] = over_views(
    f"SELECT * REPLACE (round(duplicate_percent, 6) AS duplicate_percent) FROM ({sql_duplicates(SHOP)})"
)


def _duplicates_by_digest(spark, sf):
    from checks.lake import raw

    names = ("documents", "embeddings", "pages")
    tables = {n: raw(spark, sf, n).drop("doc_id", "page_id", "vec_id") for n in names}
    return shaped(D.duplicates(tables).drop("run_id"))


QUERIES["duplicate_rows_digest"] = _duplicates_by_digest
ORACLE["duplicate_rows_digest"] = " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, CAST(sum(k) AS BIGINT) AS row_count,
          CAST(sum(k - 1) AS BIGINT) AS duplicate_rows, round(sum(k - 1) * 100.0 / sum(k), 6) AS duplicate_percent
        FROM (SELECT count(*) AS k FROM {t} GROUP BY {keys})"""
    for t, keys in (
        ("documents", "text, lang, source, n_chars"), ("embeddings", "embedding, label"), ("pages", "url, html"),
    )
)
