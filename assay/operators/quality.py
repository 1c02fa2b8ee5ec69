"""The weighted quality score: five components from 0 to 100 and their check rows.

Everything here is a relational job over ``column_profile`` and ``duplicates``; no
table is scanned again. Scores carry the run, so many runs are scored at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay import rules
from assay.functions import join_by_run, name_has_any

KEY = ["run_id", "table_name"]


def severity(status: Column, component: Column) -> Column:
    return (
        F.when(
            status == "error",
            F.when(component.isin("missingness", "validity"), "critical").otherwise("major"),
        )
        .when(status == "warning", "major")
        .otherwise("minor")
    )


def _grade(value: Column, passes: Column, warns: Column) -> Column:
    return F.when(passes, "pass").when(warns, "warning").otherwise("error")


def _share(part: str, present: Column) -> Column:
    return F.coalesce(F.col(part), F.lit(0)) * 100.0 / F.greatest(present, F.lit(1))


def component_rows(
    profile: DataFrame,
    duplicates: DataFrame,
    as_of: str,
    *,
    max_null_percent: float = 50.0,
    fresh_days: int = 90,
) -> DataFrame:
    """Long rows (run, table, component, column, metric, value, status, score, is_check).

    ``score`` is null where a row is only a check; ``is_check`` is false where a
    row only adds to the score.
    """
    cols = profile.where("error IS NULL").withColumns(
        {
            "present": F.col("total_count") - F.col("null_count"),
            "amount_like": name_has_any(F.col("column_name"), rules.AMOUNT_NAME_WORDS)
            & (F.col("type_category") == "numeric"),
            "dated": F.col("max_ts").isNotNull(),
            "date_like": (F.col("type_category") == "datetime")
            | (
                name_has_any(F.col("column_name"), rules.DATE_NAME_WORDS)
                & (F.col("type_category") == "string")
            ),
        }
    )
    negative = _share("negative_count", F.col("present"))
    future = _share("future_count", F.col("present"))
    now = F.lit(as_of).cast("timestamp_ntz")
    age = F.floor(F.timestamp_diff("SECOND", F.col("max_ts"), now) / 86400).cast("double")

    def entry(component, metric, value, status, score, scored, checked):
        return F.struct(
            F.lit(component).alias("component"),
            F.lit(metric).alias("metric"),
            value.cast("double").alias("value"),
            status.alias("status"),
            F.when(scored, score.cast("double")).alias("score"),
            checked.alias("is_check"),
        )

    null_pct = F.col("null_percent")
    validity = (
        F.lit(100.0)
        - F.when(F.col("amount_like"), F.least(negative, F.lit(50.0))).otherwise(0.0)
        - F.least(future, F.lit(50.0))
    )
    yes = F.lit(True)
    entries = F.array(
        entry(
            "missingness", "null_percent", F.round(null_pct, 2),
            _grade(null_pct, null_pct <= max_null_percent, null_pct <= 75),
            F.greatest(F.lit(0.0), 100.0 - null_pct), yes, yes,
        ),
        entry(
            "validity", "rule_pass_rate", F.round(validity, 2),
            _grade(validity, validity >= 90, validity >= 50),
            F.greatest(validity, F.lit(0.0)), yes, validity < 100,
        ),
        entry(
            "freshness", "days_since_update", age,
            _grade(age, age <= 7, age <= fresh_days),
            F.least(F.greatest(F.lit(0.0), (1 - age / max(fresh_days, 1)) * 100), F.lit(100.0)),
            F.col("date_like") & F.col("dated"), F.col("date_like") & F.col("dated"),
        ),
        entry(
            "integrity", "fk_null_percent", F.round(null_pct, 2),
            _grade(null_pct, F.lit(False), null_pct <= 20),
            F.greatest(F.lit(0.0), 100 - null_pct * 2),
            F.col("column_name").endswith("_id"),
            F.col("column_name").endswith("_id") & (null_pct > 5),
        ),
        entry(
            "integrity", "negative_values", F.col("negative_count"),
            _grade(negative, F.lit(False), negative < 5),
            F.greatest(F.lit(0.0), 100 - negative * 5),
            F.col("amount_like") & (negative > 0), F.col("amount_like") & (negative > 0),
        ),
    )
    per_column = (
        cols.select(*KEY, "column_name", F.inline(entries))
        .where(F.col("score").isNotNull() | F.col("is_check"))
    )
    dup = F.col("duplicate_percent")
    filled = profile.where("error IS NULL").select(*KEY).distinct()
    per_table = join_by_run(duplicates, filled, ["table_name"], "left_semi").select(
        *KEY,
        F.lit("__all__").alias("column_name"),
        F.lit("uniqueness").alias("component"),
        F.lit("duplicate_rate_percent").alias("metric"),
        F.round(dup, 2).alias("value"),
        _grade(dup, dup < 1, dup < 5).alias("status"),
        F.greatest(F.lit(0.0), 100 - dup * 5).alias("score"),
        F.lit(True).alias("is_check"),
    )
    undated = (
        cols.groupBy(*KEY)
        .agg(F.bool_or("date_like").alias("any_date"))
        .where(~F.col("any_date"))
        .select(
            *KEY,
            F.lit(None).cast("string").alias("column_name"),
            F.lit("freshness").alias("component"),
            F.lit("days_since_update").alias("metric"),
            F.lit(None).cast("double").alias("value"),
            F.lit("info").alias("status"),
            F.lit(100.0).alias("score"),
            F.lit(True).alias("is_check"),
        )
    )
    return per_column.unionByName(per_table).unionByName(undated)


def checks(rows: DataFrame) -> DataFrame:
    """The check records of ``component_rows``."""
    return rows.where("is_check").select(
        *KEY, F.col("component").alias("check"), "column_name", "metric", "value", "status",
        severity(F.col("status"), F.col("component")).alias("severity"),
    )


def components(rows: DataFrame) -> DataFrame:
    """One row per table with the five components, rounded to one digit.

    Freshness takes its best column, the others the mean; a component nothing
    contributes to counts as 100.
    """
    def mean(name: str) -> Column:
        return F.avg(F.when(F.col("component") == name, F.col("score")))

    best = F.max(F.when(F.col("component") == "freshness", F.col("score")))
    aggs = [
        F.round(F.coalesce(best if c == "freshness" else mean(c), F.lit(100.0)), 1).alias(c)
        for c in rules.QUALITY_WEIGHTS
    ]
    return rows.groupBy(*KEY).agg(*aggs)


def _weighted() -> Column:
    total = F.lit(0.0)
    for name, weight in rules.QUALITY_WEIGHTS.items():
        total = total + F.col(name) * (weight / 100.0)
    return F.round(total, 1)


def scores(rows: DataFrame) -> DataFrame:
    return components(rows).withColumn("overall_score", _weighted())


def severity_counts(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    found = checks(rows)
    return found.groupBy(*(by or KEY)).agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "major", "minor")]
    )


def overall(rows: DataFrame) -> DataFrame:
    """One row per run: mean components over tables, score from those means."""
    means = components(rows).groupBy("run_id").agg(
        F.count("*").alias("table_count"),
        *[F.round(F.avg(c), 1).alias(c) for c in rules.QUALITY_WEIGHTS],
    )
    found = severity_counts(rows, ["run_id"])
    return join_by_run(means.withColumn("overall_score", _weighted()), found)


def flags(profile: DataFrame, rows: DataFrame, mismatches: DataFrame | None = None) -> DataFrame:
    """Quality flags: profile rules, type mismatches, and failed checks."""
    p = profile.where("error IS NULL")

    def pick(condition: Column, flag: str, level: str, value: Column) -> DataFrame:
        return p.where(condition).select(
            *KEY, "column_name", F.lit(flag).alias("flag"), F.lit(level).alias("severity"),
            value.cast("double").alias("value"),
        )

    constant = (F.col("unique_count") <= 1) & (F.col("null_percent") < 100)
    parts = [
        pick(F.col("null_percent") > 50, "High Null Rate", "high", F.round("null_percent", 1)),
        pick(
            (F.col("type_category") == "string") & (F.col("unique_percent") > 90),
            "High Cardinality", "medium", F.round("unique_percent", 0),
        ),
        pick(constant, "Constant Column", "medium", F.col("unique_count")),
        checks(rows)
        .where(F.col("status").isin("warning", "error"))
        .select(
            *KEY, "column_name", F.col("check").alias("flag"),
            F.when(F.col("status") == "error", "high").otherwise("medium").alias("severity"),
            "value",
        ),
    ]
    if mismatches is not None:
        parts.append(
            mismatches.select(
                *KEY, "column_name", F.lit("Type Mismatch").alias("flag"), "severity",
                F.col("confidence").alias("value"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    rank = (
        F.when(F.col("severity").isin("high", "critical"), 0)
        .when(F.col("severity").isin("medium", "warning"), 1)
        .when(F.col("severity") == "low", 2)
        .otherwise(3)
    )
    return out.withColumn("severity_rank", rank).orderBy(
        "severity_rank", "table_name", "column_name", "flag"
    )
