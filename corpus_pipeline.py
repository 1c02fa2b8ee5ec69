"""A training corpus from raw documents: five stages, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm.decontaminate import without_contaminated
from assay.llm.mixing import mixed
from assay.llm.near_dups import without_near_duplicates
from assay.llm.sharding import write_shards
from assay.llm.store import table, written
from assay.llm.toxicity import learned, scored
from assay.session import scratch_path

SHARDS = 24
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the factorization machine scores at ``TOXIC`` or more."""
    model = learned(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).filter(F.col("toxicity") < TOXIC).select("record.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; documents without words stay."""
    return without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold ten consecutive words of a benchmark item."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, once or twice."""
    return mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Everything in random order, with its shard and slot; a column of that name in ``docs`` gets ``_of_document``."""
    out = write_shards(docs, scratch_path(spark, "shards"), SHARDS)
    taken = {"shard", "slot"}
    columns = [
        F.col("record")[c].alias(f"{c}_of_document" if c.lower() in taken else c) for c in docs.columns
    ]
    return out.select("shard", "slot", *columns)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]
#: Neither a trained model nor random rounding can be put in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
