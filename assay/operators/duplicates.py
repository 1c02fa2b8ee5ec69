"""Repeated rows: all columns equal, nulls equal to nulls, counted beyond the first."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions import col, literal_rows, percent
from assay.sinks.runs import materialize


def _hash(df: DataFrame) -> Column:
    """A 64-bit hash of a row; equal rows have equal hashes. Maps are hashed by their sorted entries."""
    parts = [
        F.array_sort(F.map_entries(col(f.name))) if isinstance(f.dataType, T.MapType) else col(f.name)
        for f in df.schema.fields
    ]
    return F.xxhash64(*parts)


#: hashes that occur more than once and may be broadcast (16 bytes each); beyond it all rows are grouped
FEW = 4_000_000


def repeated_groups(df: DataFrame) -> DataFrame:
    """(copies, groups): how many distinct rows there are with so many copies.

    A 64-bit hash per row is counted first, per task and then over all. Hashes that repeat are broadcast, so that rows which
    occur once never move, and rows which may repeat are counted in their task before the counts move: a row in a third of the
    table moves once per task. Equality is Spark's own. With more than ``FEW`` repeated hashes, where most rows repeat anyway,
    all rows are counted per task and then over all.
    """
    if not df.columns:
        return df.groupBy().agg(F.count("*").alias("copies")).withColumn("groups", F.lit(1).cast("bigint"))
    hashes = df.select(_hash(df).alias("h"))
    again = materialize(hashes.groupBy("h").agg(F.count("*").alias("copies")).where("copies > 1"), "repeated-hashes")
    spark, rows = df.sparkSession, df.count()  # reads no column
    few, copies = again.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    single = literal_rows(spark, "copies bigint, groups bigint", [(1, rows - copies)] if rows > copies else [])
    if not few:
        return single
    hashed = df.select(_hash(df).alias("h"), F.struct(*[col(c) for c in df.columns]).alias("row"))
    if few > FEW:
        real = hashed.groupBy("h", "row").agg(F.count("*").alias("copies"))
        return real.groupBy("copies").agg(F.count("*").alias("groups"))
    hashed = hashed.join(F.broadcast(again.select("h")), "h", "left_semi")
    real = hashed.groupBy("h", "row").agg(F.count("*").alias("copies"))
    return single.unionByName(real.groupBy("copies").agg(F.count("*").alias("groups")))


def duplicates(
    tables: Mapping[str, DataFrame], run_id: str | None = None
) -> DataFrame:
    """(run_id, table_name, row_count, duplicate_rows, duplicate_percent), one row per table."""
    spark = next(iter(tables.values())).sparkSession
    names = literal_rows(spark, "tid int, table_name string", list(enumerate(tables)))
    copies = [
        repeated_groups(df).select(F.lit(tid).alias("tid"), "copies", "groups")
        for tid, df in enumerate(tables.values())
    ]
    counted = (
        reduce(DataFrame.unionAll, copies)
        .groupBy("tid")
        .agg(
            F.sum(F.expr("copies * groups")).alias("n"), F.sum(F.expr("(copies - 1) * groups")).alias("repeats")
        )
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    return names.join(counted, "tid", "left").select(
        F.lit(run_id).cast("string").alias("run_id"),
        "table_name",
        zero("n").alias("row_count"),
        zero("repeats").alias("duplicate_rows"),
        percent(zero("repeats"), zero("n")).alias("duplicate_percent"),
    )


def duplicate_rows(df: DataFrame, table: str) -> DataFrame:
    """The repeated rows of one table, one row."""
    return duplicates({table: df})
