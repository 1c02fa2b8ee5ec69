"""Structural overview of tables and of the whole data set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay import rules
from assay.functions import join_by_run, percent

KEY = ["run_id", "table_name"]


def id_like_name(name: Column) -> Column:
    low = F.lower(name)
    tokens = F.split(F.replace(low, F.lit("_"), F.lit(" ")), r"\s+")
    listed = F.array(*[F.lit(t) for t in rules.ID_TOKENS])
    return F.arrays_overlap(tokens, listed) | low.endswith("_id")


def _flagged(profile: DataFrame) -> DataFrame:
    return profile.where("error IS NULL").withColumns(
        {
            "is_suspicious": id_like_name(F.col("column_name"))
            & (F.col("unique_percent") > 95)
            & (F.col("total_count") > 10),
            "is_constant": (F.col("unique_count") <= 1) & (F.col("null_percent") < 100),
        }
    )


def suspicious_ids(profile: DataFrame) -> DataFrame:
    return _flagged(profile).where("is_suspicious").select(*KEY, "column_name", "unique_percent")


def table_overview(profile: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Per table; the name lists are bounded by the table's width."""
    listed = lambda flag: F.array_sort(
        F.collect_list(F.when(F.col(flag), F.col("column_name")))
    )
    per_table = _flagged(profile).groupBy(*KEY).agg(
        F.max("total_count").alias("row_count"),
        F.count("*").alias("column_count"),
        F.count_if(F.col("null_percent") > 0).alias("columns_with_nulls"),
        F.count_if(F.col("null_percent") >= 99.9).alias("columns_fully_null"),
        listed("is_constant").alias("constant_columns"),
        listed("is_suspicious").alias("suspicious_id_columns"),
    )
    counted = duplicates.select(
        *KEY, "duplicate_rows", F.round("duplicate_percent", 2).alias("duplicate_percent")
    )
    return join_by_run(per_table, counted, ["table_name"], "left")


def dataset_overview(profile: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Totals per run, from the per-table rows."""
    return (
        table_overview(profile, duplicates)
        .groupBy("run_id")
        .agg(
            F.count("*").alias("table_count"),
            F.sum("row_count").alias("total_rows"),
            F.sum("column_count").alias("total_columns"),
            F.sum("duplicate_rows").alias("total_duplicate_rows"),
            F.round(percent(F.sum("duplicate_rows"), F.sum("row_count")), 2).alias("duplicate_percent"),
            F.sum("columns_with_nulls").alias("columns_with_nulls"),
            F.sum("columns_fully_null").alias("columns_fully_null"),
            F.sum(F.size("constant_columns")).cast("bigint").alias("constant_columns"),
            F.sum(F.size("suspicious_id_columns")).cast("bigint").alias("suspicious_id_columns"),
        )
    )


def input_file_bytes(df: DataFrame) -> DataFrame:
    """Files behind a file-based table and their total size, from scan metadata."""
    return (
        df.select("_metadata.file_path", "_metadata.file_size")
        .groupBy("file_path")
        .agg(F.max("file_size").alias("file_size"))
        .agg(F.count("*").alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))
    )
