"""The data sets behind a report: rankings, boxes, bars, summary, impact findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay import rules
from assay.functions import first_of_run, join_by_run
from assay.operators.profile import completeness, exploded_top_values

KEY = ["run_id", "table_name"]


def null_ranking(profile: DataFrame, limit: int | None = None) -> DataFrame:
    """Columns with nulls, worst first; ``limit`` keeps so many of each run."""
    found = profile.where(F.col("null_percent") > 0).select(
        *KEY, "column_name", F.round("null_percent", 2).alias("null_percent")
    )
    return first_of_run(found, [F.desc("null_percent"), "table_name", "column_name"], limit)


def box_plots(profile: DataFrame, limit: int | None = None) -> DataFrame:
    """Numeric columns with their five numbers and mean; ``limit`` keeps the first of each run."""
    numeric = profile.where((F.col("type_category") == "numeric") & F.col("median").isNotNull())
    return first_of_run(numeric, ["table_name", "ordinal"], limit).select(
        *KEY, "column_name", "min_value", "q25", "median", "q75", "max_value", "mean"
    )


def category_bars(profile: DataFrame, columns: int | None = None, values: int = 6) -> DataFrame:
    """Top values of string columns, of the first ``columns`` of each run; labels are cut to 20 characters."""
    strings = profile.where((F.col("type_category") == "string") & (F.size("top_values") > 0))
    chosen = first_of_run(strings, ["table_name", "ordinal"], columns)
    return (
        exploded_top_values(chosen)
        .where(F.col("rank") <= values)
        .select(*KEY, "column_name", "rank", F.left("value", F.lit(20)).alias("label"), "count")
    )


def top5_share(profile: DataFrame) -> DataFrame:
    """Each of a column's five most frequent values as a share of the five."""
    return (
        profile.withColumn("top_values", F.slice("top_values", 1, 5))
        .withColumn(
            "top_total",
            F.aggregate("top_values", F.lit(0).cast("bigint"), lambda a, e: a + e["count"]),
        )
        .select(*KEY, "column_name", "top_total", F.posexplode("top_values").alias("pos", "e"))
        .select(
            *KEY, "column_name", (F.col("pos") + 1).alias("rank"), F.col("e.value").alias("value"),
            F.col("e.count").alias("count"),
            F.round(F.try_divide(F.col("e.count") * 100.0, "top_total"), 1).alias("share_percent"),
        )
    )


def table_facts(profile: DataFrame, scores: DataFrame, pii: DataFrame, max_columns: int | None = None) -> DataFrame:
    """Compact facts per table, with its columns, or the first ``max_columns``, nested."""
    column = F.struct(
        "ordinal",
        F.col("column_name").alias("name"),
        F.col("type_category").alias("type"),
        F.round("null_percent", 1).alias("null_percent"),
        F.round("unique_percent", 1).alias("unique_percent"),
        F.col("min_value").alias("min"),
        F.col("max_value").alias("max"),
        F.col("mean").alias("mean"),
        F.when(F.col("unique_count") <= 20, F.try_element_at("top_values", F.lit(1))["value"]).alias(
            "top_value"
        ),
    )
    tables = profile.groupBy(*KEY).agg(
        F.max("total_count").alias("row_count"),
        F.count("*").alias("column_count"),
        # a table's columns: bounded by its width
        F.array_sort(F.collect_list(column if max_columns is None else F.when(F.col("ordinal") < max_columns, column))).alias(
            "columns"
        ),
    )
    found = pii.groupBy(*KEY).agg(F.count("*").alias("pii_columns"))

    joined = tables
    for part in (scores.select(*KEY, "overall_score"), completeness(profile).drop("column_count"), found):
        joined = join_by_run(joined, part, ["table_name"], "left")
    return joined.withColumn("pii_columns", F.coalesce("pii_columns", F.lit(0).cast("bigint")))


def dataset_summary(
    facts: DataFrame, edges: DataFrame, kpis: DataFrame, max_relationships: int = 20, max_kpis: int = 10
) -> DataFrame:
    """One row per run: totals, the weakest table, counts of what was found, and what a reader wants to see of it.

    ``table_list`` has a struct per table, ``relationship_list`` the ``max_relationships`` surest joins and ``kpi_names`` the
    first ``max_kpis`` KPIs; the counts beside them are of all.
    """
    totals = facts.groupBy("run_id").agg(
        F.count("*").alias("total_tables"),
        F.sum("row_count").alias("total_rows"),
        F.sum("column_count").alias("total_columns"),
        F.min_by("table_name", F.struct("overall_score", "table_name")).alias("weakest_table"),
        F.min("overall_score").alias("weakest_score"),
        F.sum("pii_columns").alias("pii_columns"),
        F.count_if(F.col("pii_columns") > 0).alias("tables_with_pii"),
        F.array_sort(
            F.collect_list(
                F.struct("table_name", "row_count", "column_count", "overall_score", "completeness_score", "pii_columns")
            )
        ).alias("table_list"),
    )
    sure = F.element_at(F.create_map(*[F.lit(x) for x in ("high", 0, "medium", 1, "low", 2)]), F.col("confidence"))
    end = lambda t, c: F.concat(F.col(t), F.lit("."), F.col(c))
    link = F.struct(end("table1", "column1").alias("from"), end("table2", "column2").alias("to"), "pattern")
    best = first_of_run(
        edges.select("run_id", sure.alias("sure"), link.alias("link")), ["sure", "link"], max_relationships
    ).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("sure", "link"))).alias("links"))
    best = best.select("run_id", F.transform("links", lambda x: x["link"]).alias("relationship_list"))
    named = first_of_run(kpis.select("run_id", "rank", "name"), ["rank", "name"], max_kpis).groupBy("run_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("kpi_names")
    )
    for part in (best, named):
        totals = join_by_run(totals, part, how="left")
    for name, part in (("relationships", edges), ("kpis", kpis)):
        counts = part.groupBy("run_id").agg(F.count("*").alias(name))
        totals = join_by_run(totals, counts, how="left").withColumn(
            name, F.coalesce(name, F.lit(0).cast("bigint"))
        )
    return totals


def impact_findings(metrics: DataFrame) -> DataFrame:
    """Rows (…, metric, value) that break an impact rule, with risk, action and owner."""
    def broken(op: str, value: Column, limit: float) -> Column:
        return value < limit if op == "<" else value > limit

    found = F.filter(
        F.array(
            *[
                F.when(
                    (F.col("metric") == metric) & broken(op, F.col("value"), limit),
                    F.struct(
                        F.lit(level).alias("severity"), F.lit(limit).alias("threshold"),
                        F.lit(owner).alias("owner_role"), F.lit(risk).alias("risk"),
                        F.lit(action).alias("action"),
                    ),
                )
                for metric, op, limit, level, owner, risk, action in rules.IMPACT_RULES
            ]
        ),
        lambda e: e.isNotNull(),
    )
    return metrics.select("*", F.inline(found))
