"""A store of runs: ``<root>/<artifact>/run_id=<id>/``, written and read by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.session import scratch_path

# times are kept to the microsecond in text formats
_TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def save(df: DataFrame, root: str, artifact: str, run_id: str, fmt: str = "json") -> str:
    """Write one artifact of one run; a run that exists is replaced as a whole."""
    path = f"{root}/{artifact}/run_id={run_id}"
    df.drop("run_id").write.mode("overwrite").options(**_TIMES).format(fmt).save(path)
    return path


def materialize(df: DataFrame, label: str = "profile") -> DataFrame:
    """Write a result once to the shared folder and go on from the files.

    Rules read a profile many times; from files each reading costs a small scan
    and a lost executor costs nothing but a retry.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_runs(df: DataFrame, root: str, artifact: str, fmt: str = "json") -> str:
    """Write an artifact of many runs at once, partitioned by ``run_id``."""
    path = f"{root}/{artifact}"
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .options(**_TIMES)
        .format(fmt)
        .save(path)
    )
    return path


def load(
    spark: SparkSession, root: str, artifact: str, schema: T.StructType | str | None = None,
    run_id: str | None = None, fmt: str = "json",
) -> DataFrame:
    """An artifact over all runs, or of one run by partition pruning."""
    reader = spark.read.options(**_TIMES).format(fmt)
    path = f"{root}/{artifact}"
    if schema is None:
        schema = reader.load(path).schema
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    # run ids are text: left to be inferred, 007 would be read as 7
    fields = [f for f in schema.fields if f.name != "run_id"]
    df = reader.schema(T.StructType([*fields, T.StructField("run_id", T.StringType())])).load(path)
    return df if run_id is None else df.where(F.col("run_id") == run_id)


def list_runs(spark: SparkSession, root: str, artifact: str, fmt: str = "json") -> DataFrame:
    """The runs that have an artifact, by folder names alone."""
    kept = list_artifacts(spark, root).where(F.col("artifact") == artifact)
    return kept.select("run_id").distinct().orderBy("run_id")


def list_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, artifact, files, bytes) from file names alone."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        .select("path", "length")
        .where(~F.element_at(F.split("path", "/"), -1).startswith("_"))
    )
    return (
        files.select(
            F.regexp_extract("path", r"/run_id=([^/]+)/", 1).alias("run_id"),
            F.regexp_extract("path", r"/([^/]+)/run_id=", 1).alias("artifact"),
            "length",
        )
        .groupBy("run_id", "artifact")
        .agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    )


def compare(reports: DataFrame) -> DataFrame:
    """Flat listing of stored report rows, one per run, to hold runs side by side."""
    return reports.select(
        "run_id", "label", "total_rows", "total_columns",
        F.round("overall_score", 1).alias("quality"),
        "total_score", "grade", "pii_columns", "total_duplicate_rows",
        F.round("duplicate_percent", 1).alias("duplicate_percent"), "kpis",
        *[F.round(c, 1).alias(c) for c in ("missingness", "validity", "uniqueness", "freshness", "integrity")],
    ).orderBy("run_id")
