"""Strings that hold something else: numbers, dates, booleans, JSON, markup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["run_id", "table_name"]


def hidden_types(profile: DataFrame) -> DataFrame:
    """Every string column with its content rates and whether it needs a closer look.

    Rates are over all non-blank values. Sample values are the first five top
    values; mask them first where the column is personal.
    """
    filled = F.col("nonblank_count")
    rate = lambda c: F.coalesce(F.try_divide(F.col(c), filled), F.lit(0.0))
    rows = profile.where((F.col("type_category") == "string") & F.col("error").isNull()).select(
        *KEY,
        "column_name",
        F.round("null_percent", 1).alias("null_percent"),
        "unique_count",
        "unique_percent",
        "min_length",
        "max_length",
        "avg_length",
        filled.alias("nonblank_count"),
        rate("object_count").alias("object_rate"),
        rate("array_count").alias("array_rate"),
        rate("number_count").alias("number_rate"),
        rate("date_count").alias("date_rate"),
        rate("boolean_count").alias("boolean_rate"),
        rate("markup_count").alias("markup_rate"),
        F.transform(F.slice("top_values", 1, 5), lambda e: e["value"]).alias("samples"),
    )
    tests = [
        ("json", (F.col("object_rate") > 0) | (F.col("array_rate") > 0)),
        ("number", F.col("number_rate") >= 0.8),
        ("enum", (F.col("unique_percent") < 2) & (F.col("unique_count") <= 20)),
        ("date", F.col("date_rate") >= 0.5),
        ("boolean", F.col("boolean_rate") == 1.0),
        ("long", F.col("avg_length") > 500),
    ]
    found = F.filter(
        F.array(*[F.when(test, F.lit(name)) for name, test in tests]), lambda e: e.isNotNull()
    )
    blank = F.col("nonblank_count") == 0
    return rows.withColumn(
        "signals", F.when(blank, F.array().cast("array<string>")).otherwise(found)
    ).withColumn("is_flagged", F.size("signals") > 0)


def verdicts(screen: DataFrame) -> DataFrame:
    """The likely type of each flagged column, its confidence and severity.

    Confidence starts at 0.6, gains 0.1 where the rates bear the type out and
    loses 0.15 where they do not; below 0.5 the finding is dropped.
    """
    c = F.col
    detected = (
        F.when(c("object_rate") >= 0.5, "json_object")
        .when(c("array_rate") >= 0.5, "json_array")
        .when(c("boolean_rate") == 1.0, "boolean_as_string")
        .when(c("number_rate") >= 0.8, "numeric_as_string")
        .when(c("date_rate") >= 0.5, "date_as_string")
        .when(c("markup_rate") >= 0.5, "html_xml")
        .when(F.array_contains("signals", "enum"), "categorical_enum")
        .otherwise("free_text")
    )
    start = F.lit(0.6)
    up, down = F.least(start + 0.1, F.lit(1.0)), F.greatest(start - 0.15, F.lit(0.3))
    confidence = (
        F.when(c("detected_type") == "numeric_as_string", F.when(c("number_rate") >= 0.9, up).otherwise(down))
        .when(c("detected_type") == "date_as_string", F.when(c("date_rate") >= 0.5, up).otherwise(down))
        .when(c("detected_type") == "boolean_as_string", F.when(c("unique_count") <= 3, up).otherwise(start))
        .otherwise(start)
    )
    critical = c("detected_type").isin("numeric_as_string", "date_as_string")
    plain = c("detected_type").isin("categorical_enum", "free_text")
    return (
        screen.where("is_flagged")
        .withColumn("detected_type", detected)
        .withColumn("confidence", F.round(confidence, 2))
        .where(c("confidence") >= 0.5)
        .select(
            *KEY,
            "column_name",
            F.lit("string").alias("current_type"),
            "detected_type",
            "confidence",
            F.when(critical, "critical").when(plain, "info").otherwise("warning").alias("severity"),
        )
    )
