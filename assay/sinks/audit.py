"""Audit logs: JSON lines of one record each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "timestamp timestamp_ntz, event_type string, actor string, resource string, severity string, "
    "details map<string,string>"
)


# times are kept to the microsecond
_TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def append(records: DataFrame, path: str) -> None:
    records.write.mode("append").options(**_TIMES).json(path)


def as_lines(records: DataFrame) -> DataFrame:
    """The records as JSON text, one ``value`` each."""
    return records.select(F.to_json(F.struct(*records.columns), _TIMES).alias("value"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All records; lines that are no record are left out."""
    return spark.read.schema(SCHEMA).options(**_TIMES).option("mode", "DROPMALFORMED").json(path)


def tail(log: DataFrame, n: int, event_type: str | None = None) -> DataFrame:
    """The last ``n`` records, newest first."""
    rows = log if event_type is None else log.where(F.col("event_type") == event_type)
    return rows.orderBy(F.desc("timestamp"), "event_type", "actor", "resource").limit(n)


def counts(log: DataFrame) -> DataFrame:
    return log.groupBy("event_type").agg(F.count("*").alias("records"))
