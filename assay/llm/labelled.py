"""Which labelled rows a classifier may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text (null: no text), modulo ``parts``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def label_of(labels: DataFrame, name: str) -> DataFrame:
    """(doc_id, label): one row per id, 1 if any of its rows says so; null ids and labels are no labels."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(name).isNotNull())
    return known.groupBy("doc_id").agg(F.max(F.col(name)).cast("int").alias("label"))
