"""Missing values: what to do about each column, and doing it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions import col, join_by_run, missing, numeric_value, type_category
from assay.operators.profile import frequencies

KEY = ["run_id", "table_name"]


def missing_strategy(profile: DataFrame, classes: DataFrame) -> DataFrame:
    """Per column: treatment, its type and its priority.

    ``classes`` marks the columns that carry business meaning.
    """
    marks = classes.select(*KEY, "column_name", F.lit(True).alias("is_important"))
    rows = join_by_run(
        profile.where("error IS NULL"), marks, ["table_name", "column_name"], "left"
    )
    pct = F.col("null_percent")
    important = F.coalesce("is_important", F.lit(False))
    numeric = F.col("type_category") == "numeric"
    text = F.col("type_category") == "string"
    few = F.col("unique_count") <= 10
    is_skewed = F.abs(F.coalesce("skewness", F.lit(0.0))) > 1.5

    def advice(treatment: str, kind: str, priority: str | Column) -> Column:
        level = F.lit(priority) if isinstance(priority, str) else priority
        return F.struct(
            F.lit(treatment).alias("treatment"), F.lit(kind).alias("treatment_type"),
            level.alias("priority"),
        )

    raised = F.when(important, "high").otherwise("medium")
    choice = (
        F.when(pct == 0, advice("none", "no_action", "none"))
        .when((pct > 80) & important, advice("flag_and_default", "transform", "high"))
        .when(pct > 80, advice("drop_column", "drop", "low"))
        .when((pct > 20) & numeric & is_skewed, advice("impute_median_and_flag", "impute", raised))
        .when((pct > 20) & numeric, advice("impute_mean_and_flag", "impute", raised))
        .when((pct > 20) & text & few, advice("impute_mode", "impute", "medium"))
        .when((pct > 20) & text, advice("flag_and_unknown", "transform", "medium"))
        .when(pct > 20, advice("investigate", "flag", "medium"))
        .when((pct > 1) & numeric, advice("impute_median", "impute", "low"))
        .when((pct > 1) & text, advice("impute_mode", "impute", "low"))
        .when(pct > 1, advice("drop_rows_or_default", "impute", "low"))
        .otherwise(advice("drop_rows", "drop", "low"))
    )
    return rows.select(*KEY, "column_name", "type_category", pct, choice.alias("c")).select(
        *KEY, "column_name", "type_category", "null_percent", "c.*"
    )


def missing_summary(strategy: DataFrame) -> DataFrame:
    kinds = ("drop", "impute", "transform", "flag", "no_action")
    return strategy.groupBy("run_id").agg(
        F.count_if(F.col("null_percent") > 0).alias("columns_with_nulls"),
        *[F.count_if(F.col("treatment_type") == k).alias(f"{k}_count") for k in kinds],
    )


TREATMENTS = (
    "mean", "median", "mode", "unknown", "flag", "drop_rows", "drop_column",
)


def _fills(df: DataFrame, means: list[str], modes: list[str]) -> dict[str, str | None]:
    """The mean or the most frequent value (the smallest on ties) of columns, as text: a row of a scan each, however many."""
    types = {f.name: f.dataType for f in df.schema.fields}
    found: dict[str, str | None] = {}
    if means:
        row = df.agg(*[F.avg(numeric_value(n, types[n])).cast("string").alias(str(i)) for i, n in enumerate(means)]).first()
        found |= {n: row[i] for i, n in enumerate(means)}
    if modes:
        counts = frequencies(df.select(*[col(n) for n in modes]), digests=False)
        value = "coalesce(txt, CAST(lng AS STRING), CAST(dbl AS STRING))"
        best = counts.groupBy("cid").agg(F.expr(f"min_by({value}, struct(-n, lng, dbl, txt)) AS v")).collect()
        found |= dict.fromkeys(modes) | {modes[r.cid]: r.v for r in best}
    return found


def apply_treatment(df: DataFrame, plan: Mapping[str, list[str]], medians: DataFrame | None = None) -> DataFrame:
    """Apply treatments per column, e.g. ``{"amount": ["flag", "median"]}``.

    Replacement values come from the whole table: one scan for all means, one for all modes, none for medians. ``medians``
    is a profile of the table with quantiles; without it ``median`` is not available.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    for name, steps in plan.items():
        unknown = set(steps) - set(TREATMENTS)
        if name not in types or unknown:
            raise ValueError(f"unknown column or treatment: {name} {sorted(unknown)}")

    def wants(step: str) -> list[str]:
        return [n for n, steps in plan.items() if step in steps and "drop_column" not in steps]

    if wants("median") and medians is None:
        raise ValueError("median needs the table's profile")
    nested = [n for n in wants("mode") if type_category(types[n]) == "complex"]
    if nested:
        raise ValueError(f"no mode of nested columns: {nested}")
    # the first of a column's replacements is the one that counts
    first = {n: next((s for s in ("mean", "median", "mode") if s in steps), None) for n, steps in plan.items()}
    chosen = lambda step: [n for n in wants(step) if first[n] == step]
    fills = _fills(df, chosen("mean"), chosen("mode"))
    if chosen("median"):
        known = medians.where(F.col("column_name").isin(chosen("median")))
        fills |= {r.column_name: r.v for r in known.selectExpr("column_name", "CAST(median AS STRING) AS v").collect()}

    kept = df
    for name in [n for n, steps in plan.items() if "drop_rows" in steps]:
        kept = kept.where(~missing(name, types[name]))

    out = []
    for name, data_type in types.items():
        steps = plan.get(name, [])
        if "drop_column" in steps:
            continue
        value = F.when(~missing(name, data_type), col(name))
        if name in fills:
            number = first[name] != "mode" and type_category(data_type) == "numeric"
            kind = "double" if number else data_type
            value = F.coalesce(value.cast(kind), F.lit(fills[name]).cast(kind))
        if "unknown" in steps:
            value = F.coalesce(value, F.lit("Unknown"))
        out.append((value if steps else col(name)).alias(name))
        if "flag" in steps:
            out.append(missing(name, data_type).cast("int").alias(f"{name}_is_missing"))
    return kept.select(*out)
