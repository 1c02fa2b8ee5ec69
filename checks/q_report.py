"""Report data sets, run comparison, impact findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.diagnose import findings, report_rows
from assay.kpi import detect
from assay.operators import duplicates as D
from assay.operators import privacy as Y
from assay.operators import profile as P
from assay.operators import quality as Q
from assay.operators import relate as R
from assay.operators import report as B
from assay.session import scratch_path
from assay.sinks import runs
from checks.lake import AS_OF, lake, over_profile, rounded, shaped
from checks.q_kpi import KPI_SQL
from checks.q_privacy import PII_SQL
from checks.q_profile import prof, stored
from checks.q_quality import _WEIGHTED, COMPONENT_SQL
from checks.q_relate import RELATE_SQL
from checks.q_semantics import READINESS_SQL

QUERIES, ORACLE = {}, {}

QUERIES["chart_nulls"] = lambda s, d: shaped(B.null_ranking(prof(s, d)).drop("run_id"))
ORACLE["chart_nulls"] = over_profile(
    """SELECT table_name, column_name, round(null_percent, 2) AS null_percent FROM p WHERE null_percent > 0
       """
)
QUERIES["chart_boxes"] = lambda s, d: shaped(
    B.box_plots(prof(s, d, parts=(P.STATS, P.QUANTILES))).drop("run_id"), 4
)
_FIVE = ["min_value", "q25", "median", "q75", "max_value", "mean"]
ORACLE["chart_boxes"] = rounded(
    over_profile(
        f"""SELECT table_name, column_name, {', '.join(_FIVE)} FROM p WHERE type_category = 'numeric' AND median IS NOT NULL"""
    ),
    _FIVE, 4,
)
QUERIES["chart_categories"] = lambda s, d: shaped(
    B.category_bars(prof(s, d, parts=(P.STATS, P.TOP))).drop("run_id")
)
ORACLE["chart_categories"] = over_profile(
    """SELECT table_name, column_name, rank, left(value, 20) AS label, count FROM tops
       SEMI JOIN (SELECT table_name, column_name FROM p WHERE type_category = 'string' AND unique_count > 0) USING (table_name, column_name) WHERE rank <= 6""",
    tops=True,
)
QUERIES["top5_share"] = lambda s, d: shaped(
    B.top5_share(prof(s, d, parts=(P.STATS, P.TOP))).drop("run_id")
)
ORACLE["top5_share"] = over_profile(
    """SELECT table_name, column_name, rank, value, count,
              round(count * 100.0 / sum(count) OVER (PARTITION BY table_name, column_name), 1) AS share_percent
       FROM tops WHERE rank <= 5""",
    tops=True,
)


def _facts(spark, sf, p):
    rows = Q.component_rows(p, D.duplicates(lake(spark, sf)), AS_OF)
    return B.table_facts(p, Q.scores(rows), Y.pii_columns(p))


_FACT_PARTS = (P.STATS, P.DISTINCT, P.TOP, P.PATTERNS)
FACT_SQL = f"""{COMPONENT_SQL.strip()}, {PII_SQL.strip()},
facts AS (
  SELECT table_name, max(total_count) AS row_count, count(*) AS column_count,
         (SELECT {_WEIGHTED} FROM s WHERE s.table_name = p.table_name) AS overall_score,
         round(100 - avg(null_percent), 2) AS completeness_score,
         (SELECT count(*) FROM pii WHERE pii.table_name = p.table_name) AS pii_columns
  FROM p GROUP BY table_name)
"""


def _table_facts(spark, sf):
    facts = _facts(spark, sf, stored(spark, sf, parts=_FACT_PARTS))
    first = F.try_element_at("columns", F.lit(1))
    return shaped(
        facts.select(
            "table_name", "row_count", "column_count", "overall_score", "completeness_score", "pii_columns",
            F.size("columns").alias("listed"), first["name"].alias("first_column"),
        )
    )


QUERIES["table_facts"] = _table_facts
ORACLE["table_facts"] = over_profile(
    f"""WITH {FACT_SQL.strip()} SELECT facts.*, column_count AS listed,
        (SELECT column_name FROM p WHERE p.table_name = facts.table_name AND ordinal = 0) AS first_column FROM facts""",
    duplicates=True,
)


def _summary(spark, sf):
    p = stored(spark, sf, parts=_FACT_PARTS)
    found = B.dataset_summary(_facts(spark, sf, p), R.relationships(p), detect.recommend(p)).drop("run_id")
    shown = lambda *names: lambda x: F.concat_ws(" ", *[x[n].cast("string") for n in names])
    return shaped(
        found.withColumns({
            "table_list": F.transform("table_list", shown("table_name", "row_count", "column_count", "pii_columns")),
            "relationship_list": F.transform("relationship_list", shown("from", "to", "pattern")),
        })
    )


QUERIES["dataset_summary"] = _summary
ORACLE["dataset_summary"] = over_profile(
    f"""WITH {FACT_SQL.strip()}, {RELATE_SQL.strip()}, {KPI_SQL.strip()}
    SELECT count(*) AS total_tables, CAST(sum(row_count) AS BIGINT) AS total_rows,
           CAST(sum(column_count) AS BIGINT) AS total_columns,
           (SELECT table_name FROM facts ORDER BY overall_score, table_name LIMIT 1) AS weakest_table,
           min(overall_score) AS weakest_score, CAST(sum(pii_columns) AS BIGINT) AS pii_columns,
           count(*) FILTER (pii_columns > 0) AS tables_with_pii, (SELECT count(*) FROM jc) AS relationships,
           (SELECT least(count(*), 7) FROM ready SEMI JOIN det USING (industry) WHERE is_ready) AS kpis,
           string_agg(concat_ws(' ', table_name, row_count, column_count, pii_columns), '|' ORDER BY table_name) AS table_list,
           (SELECT string_agg(table1 || '.' || column1 || ' ' || table2 || '.' || column2 || ' ' || pattern, '|'
                ORDER BY list_position(['high', 'medium', 'low'], confidence), table1 || '.' || column1, table2 || '.' || column2)
            FROM jc) AS relationship_list,
           (SELECT string_agg(name, '|' ORDER BY priority) FROM
                (SELECT name, priority FROM ready SEMI JOIN det USING (industry) WHERE is_ready ORDER BY priority LIMIT 7)) AS kpi_names
    FROM facts""",
    duplicates=True,
)


def _impact(spark, sf):
    """Freshness and duplicate rates of the shop against the impact rules."""
    p = stored(spark, sf)
    rows = Q.component_rows(p, D.duplicates(lake(spark, sf)), AS_OF)
    checked = Q.checks(rows)
    metrics = checked.where("metric IN ('days_since_update', 'duplicate_rate_percent')").select(
        "table_name", "column_name",
        F.when(F.col("metric") == "days_since_update", "freshness_days").otherwise(F.col("metric")).alias("metric"),
        "value",
    )
    return shaped(B.impact_findings(metrics).drop("risk", "action"))


QUERIES["impact_findings"] = _impact
ORACLE["impact_findings"] = over_profile(
    f"""WITH {COMPONENT_SQL.strip()}
    SELECT table_name, column_name, 'freshness_days' AS metric, value, 'major' AS severity, 3.0::DOUBLE AS threshold,
           'data_engineering' AS owner_role FROM ck WHERE metric = 'days_since_update' AND value > 3
    UNION ALL
    SELECT table_name, column_name, metric, value, 'major', 1.0, 'analytics_engineering' FROM ck
    WHERE metric = 'duplicate_rate_percent' AND value > 1""",
    duplicates=True,
)


def _compare(spark, sf):
    """Two stored runs, the shop before and after cleaning, held side by side.

    The rules run once over the profiles of both.
    """
    root = scratch_path(spark, "runs")
    dirty = lake(spark, sf)
    clean = dict(dirty, orders=dirty["orders"].drop("promo_code").distinct())
    parts = (P.STATS, P.DISTINCT, P.TOP, P.PATTERNS)
    both = {"run-1": dirty, "run-2": clean}
    profiles = [
        P.profile_tables(tables, run_id=run_id, as_of=AS_OF, parts=parts)
        for run_id, tables in both.items()
    ]
    p = runs.materialize(profiles[0].unionAll(profiles[1]))
    dups = [D.duplicates(tables, run_id) for run_id, tables in both.items()]
    dups = runs.materialize(dups[0].unionAll(dups[1]), "duplicates")
    report = report_rows(findings(p, dups, AS_OF), "shop")
    runs.save_runs(report, root, "report_data")
    return shaped(runs.compare(runs.load(spark, root, "report_data")).drop("label"))


QUERIES["run_compare"] = _compare


def _compare_sql() -> str:
    from checks.lake import VIEWS, sql_duplicates, sql_profile, sql_views

    def one(run_id: str, cleaned: bool) -> str:
        views = sql_views()
        profile, dups = sql_profile(), sql_duplicates()
        if cleaned:
            views = views.replace("v_orders AS (", "v_orders0 AS (")
            views += ", v_orders AS (SELECT DISTINCT * EXCLUDE (promo_code) FROM v_orders0)"
            saved = VIEWS["orders"]
            VIEWS["orders"] = (saved[0], [c for c in saved[1] if c[0] != "promo_code"])
            profile, dups = sql_profile(), sql_duplicates()
            VIEWS["orders"] = saved
        means = ", ".join(
            f"(SELECT round(avg({c}), 1) FROM s) AS {c}"
            for c in ("missingness", "validity", "uniqueness", "freshness", "integrity")
        )
        return f"""
        SELECT '{run_id}' AS run_id, t.* FROM (
          WITH {views}, p AS ({profile}), d AS ({dups}), {COMPONENT_SQL.strip()}, {READINESS_SQL.strip()}
          SELECT CAST(sum(ov.row_count) AS BIGINT) AS total_rows, CAST(sum(column_count) AS BIGINT) AS total_columns, {means},
                 (SELECT round(round(avg(missingness), 1) * 0.3 + round(avg(validity), 1) * 0.3 + round(avg(uniqueness), 1) * 0.2
                    + round(avg(freshness), 1) * 0.1 + round(avg(integrity), 1) * 0.1, 1) FROM s) AS quality,
                 (SELECT count(*) FROM pii) AS pii_columns, CAST(sum(duplicate_rows) AS BIGINT) AS total_duplicate_rows,
                 round(sum(duplicate_rows) * 100.0 / sum(ov.row_count), 1) AS duplicate_percent,
                 (SELECT total_score FROM z) AS total_score, (SELECT n FROM kn) AS kpis,
                 (SELECT CASE WHEN total_score >= 70 THEN 'green' WHEN total_score >= 40 THEN 'yellow' ELSE 'red' END FROM z) AS grade
          FROM ov JOIN d USING (table_name)) t"""

    return one("run-1", False) + " UNION ALL " + one("run-2", True)


ORACLE["run_compare"] = _compare_sql()
