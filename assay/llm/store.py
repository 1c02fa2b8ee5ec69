"""Files in the folder all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assay.session import scratch_path

ROWS, BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder: lineage ends there and a lost executor costs a retry."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of texts. Python gets at most ``BATCH`` of its rows at once, unless the session says otherwise."""
    if spark.conf.get(ROWS) == "10000":  # the default, made for short rows
        spark.conf.set(ROWS, str(BATCH))
    return spark.read.parquet(f"{folder}/{name}.parquet")
