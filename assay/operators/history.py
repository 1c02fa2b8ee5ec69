"""Comparing stored runs: row growth and schema drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def row_growth(inventory: DataFrame) -> DataFrame:
    """(table_name, snapshot, row_count) -> change against the snapshot before.

    One window per table; a table has one row per stored run.
    """
    order = W.partitionBy("table_name").orderBy("snapshot")
    before = F.lag("row_count").over(order)
    return inventory.select(
        "table_name", "snapshot", "row_count", before.alias("previous_count"),
        F.try_divide((F.col("row_count") - before) * 100.0, before).alias("growth_percent"),
    )


def schema_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, removed and retyped columns between two sets of (table, column, type) rows."""
    keys = ["table_name", "column_name"]
    a = old.select(*keys, F.col("data_type").alias("old_type"))
    b = new.select(*keys, F.col("data_type").alias("new_type"))
    change = (
        F.when(F.col("old_type").isNull(), "added")
        .when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type") != F.col("new_type"), "type_changed")
    )
    return (
        a.join(b, keys, "full_outer").withColumn("change_type", change).where("change_type IS NOT NULL")
    )


def drift_score(drift: DataFrame) -> DataFrame:
    return drift.groupBy("table_name").agg(
        F.count("*").alias("changes"),
        *[
            F.count_if(F.col("change_type") == c).alias(c)
            for c in ("added", "removed", "type_changed")
        ],
    )
