"""General data-health KPIs, for data sets of no known industry."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions import col, percent
from assay.kpi._time import now
from assay.operators.history import drift_score, row_growth, schema_drift

__all__ = [
    "completeness_index", "drift_score", "duplicate_rate", "freshness", "row_growth",
    "schema_drift",
]


def freshness(tables: Mapping[str, tuple[DataFrame, str]], as_of: str) -> DataFrame:
    """Per table: newest value of its time column and whole days since."""
    newest = [
        df.agg(F.max(col(ts).cast("timestamp_ntz")).alias("latest")).select(
            F.lit(name).alias("table_name"), "latest"
        )
        for name, (df, ts) in tables.items()
    ]
    age = F.timestamp_diff("SECOND", F.col("latest"), now(as_of)) / 86400
    return reduce(DataFrame.unionAll, newest).withColumn(
        "days_stale", F.floor(age).cast("bigint")
    )


def completeness_index(profile: DataFrame) -> DataFrame:
    return profile.where("error IS NULL").groupBy("run_id").agg(
        F.avg(1.0 - F.col("null_percent") / 100.0).alias("completeness_index")
    )


def duplicate_rate(duplicates: DataFrame) -> DataFrame:
    return duplicates.select(
        "table_name",
        F.col("duplicate_rows").alias("duplicate_count"),
        (percent(F.col("duplicate_rows"), F.col("row_count")) / 100.0).alias("dup_rate"),
    )
