"""A shuffle of all records and its cut into shards of equal counts.

Two passes over the records. The first scatters them by a seeded hash into buckets that fit in a task's memory; the second
puts every bucket in random order (Fisher-Yates, Spark's ``shuffle``) and writes it. The buckets one after another are a
random order of the whole table; shard ``s`` of ``S`` takes the positions ``p`` with ``p * S div N = s``, so that counts
differ by one at most and a bucket touches only neighbouring shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.store import table
from assay.llm.text import text_bytes
from assay.session import scratch_path

SEED = 20240607


def write_shards(
    docs: DataFrame,
    path: str,
    shards: int,
    key: Sequence[str] = ("doc_id", "text"),
    text: str = "text",
    seed: int = SEED,
    bucket_bytes: int = 64 << 20,
) -> DataFrame:
    """Write ``docs`` in random order below ``path`` as ``shard=0`` to ``shard={shards - 1}`` and return what was written.

    Columns of the result: ``shard``, ``slot`` (position in the shard, without gaps) and ``record``, the whole row, so that
    no column of ``docs`` can clash. ``key`` are the columns that decide on a row's bucket; nulls are values like others,
    and rows equal in all of them share a bucket. Each row appears once, repeated rows as often as they were given. An
    empty table writes nothing and returns no rows.
    """
    spark = docs.sparkSession
    hashed = F.xxhash64(F.lit(seed), *[docs[k] for k in key])
    rows, size = docs.agg(F.count("*"), F.sum(text_bytes(docs[text]) + 8)).first()
    buckets = max(-(-(size or 0) // bucket_bytes), 4 * shards)
    record = F.struct(*[docs[c] for c in docs.columns]).alias("record")
    keyed = docs.select(F.pmod(hashed, F.lit(buckets)).alias("bucket"), hashed.alias("place"), record)

    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keyed.groupBy("bucket").agg(F.count("*").alias("n"))
        .select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    # The order below makes the list, and with it the permutation, the same however rows arrive.
    dealt = (
        keyed.repartition(buckets, "bucket")
        .sortWithinPartitions("bucket", "place", *[f"record.{k}" for k in key])
        .groupBy("bucket")
        .agg(F.collect_list("record").alias("records"))
        .select("bucket", F.shuffle("records", seed=seed).alias("records"))
    )
    placed = (
        dealt.join(starts.repartition(buckets, "bucket").hint("shuffle_hash"), "bucket")
        .select("start", F.posexplode("records").alias("at", "record"))
        .select((F.col("start") + F.col("at")).alias("p"), "record")
    )
    shard = F.expr(f"(p * {shards}L) div {max(rows, 1)}L").cast("int")
    first = F.expr(f"(shard * {rows}L + {shards - 1}L) div {shards}L")
    out = placed.select(shard.alias("shard"), "p", "record").select("shard", (F.col("p") - first).alias("slot"), "record")
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)
    schema = T.StructType([f for f in out.schema if f.name != "shard"]).add("shard", T.IntegerType())
    return spark.read.schema(schema).parquet(path).select("shard", "slot", "record")


def op2_sharding(spark, folder):
    """All documents in 24 shards under the law ``rows``."""
    written = write_shards(table(spark, folder, "documents"), scratch_path(spark, "shards"), 24)
    text = F.coalesce("record.text", F.lit(""))
    return written.select(
        F.col("record.doc_id").alias("doc_id"),
        (text_bytes(text) + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
