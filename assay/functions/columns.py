"""Column helpers: quoting, the null model, type categories, fixed-size local rows."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def quoted(name: str) -> str:
    """A column name as SQL; it may hold dots, blanks or backticks."""
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    """A string literal as SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def col(name: str) -> Column:
    return F.col(quoted(name))


def missing(name: str, data_type: T.DataType) -> Column:
    """Null, or NaN where the type has one."""
    return F.expr(missing_sql(name, data_type))


def missing_sql(name: str, data_type: T.DataType) -> str:
    c = quoted(name)
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return f"({c} IS NULL OR isnan({c}))"
    return f"({c} IS NULL)"


def numeric_value(name: str, data_type: T.DataType) -> Column:
    """The column as double, with NaN turned into null."""
    return F.expr(numeric_sql(name, data_type))


def numeric_sql(name: str, data_type: T.DataType) -> str:
    c = f"CAST({quoted(name)} AS DOUBLE)"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return f"nanvl({c}, NULL)"
    return c


def type_category(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "complex"


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 for an empty whole."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole.cast("double")), F.lit(0.0))


def join_by_run(
    left: DataFrame, right: DataFrame, keys: Sequence[str] = (), how: str = "inner"
) -> DataFrame:
    """Equi-join on run_id, where no run id equals no run id, and further keys."""
    names = {k: f"_{k}" for k in ("run_id", *keys)}
    other = right.withColumnsRenamed(names)
    on = F.col("run_id").eqNullSafe(F.col("_run_id"))
    for k in keys:
        on = on & (F.col(k) == F.col(names[k]))
    joined = left.join(other, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*names.values())


def name_has_any(name: Column, words: Iterable[str]) -> Column:
    """True where the lower-case name contains one of the words."""
    return F.lower(name).rlike("|".join(re.escape(w) for w in words))


def literal_rows(spark: SparkSession, schema: str, rows: Sequence[Sequence[Any]]) -> DataFrame:
    """A fixed rule table (or one row per column of a known schema) as a DataFrame."""
    parsed = T.StructType.fromDDL(schema)
    names = parsed.fieldNames()
    table = pa.Table.from_pylist(
        [dict(zip(names, row, strict=True)) for row in rows], schema=to_arrow_schema(parsed)
    )
    return spark.createDataFrame(table, schema=parsed)


def first_of_run(rows: DataFrame, order: list, limit: int | None) -> DataFrame:
    """``rows`` in ``order``; with a limit, the first ones of every run."""
    if limit is None:
        return rows.orderBy(*order)
    rank = F.row_number().over(W.partitionBy("run_id").orderBy(*order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= limit).drop("_rank").orderBy(*order)
