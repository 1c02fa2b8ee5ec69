"""Connected components of a graph of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.store import written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``key`` and ``label`` of every end of ``edges`` (a, b); the label is the least key of its component.

    Alternating star steps: neighbours above a key move to its least neighbour, then neighbours below it do. Every step is
    two shuffles of the edges; hubs are counted per task first, and joins to them can be split. It ends when every key
    points to its label, which takes a number of rounds in proportion to the logarithm of the size.
    """
    flat = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    flat = written(flat, "component-edges")
    before = None
    for _ in range(rounds):
        both = flat.unionByName(flat.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        up = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        up = written(up, "component-edges")
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(low, "u")
        down = down.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
        flat = written(down.distinct(), "component-edges")
        now = flat.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    labels = flat.select(F.col("u").alias("key"), F.col("v").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("key"), "label").distinct())
