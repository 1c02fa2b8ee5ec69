"""Assets, schemas, row counts, freshness."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay import rules
from assay.functions import literal_rows, missing_sql, quoted, type_category
from assay.operators.profile import Lake
from assay.sources.files import read, suffix


def table_inventory(spark: SparkSession, tables: Mapping[str, DataFrame], namespace: str) -> DataFrame:
    rows = [(namespace, n, "table", f"{namespace}.{n}") for n in sorted(tables)]
    return literal_rows(
        spark, "namespace string, name string, asset_type string, identifier string", rows
    )


def sql_type(data_type) -> str:
    """The SQL name a column is reported under."""
    name = data_type.simpleString()
    if name in ("tinyint", "smallint", "int", "bigint"):
        return "integer"
    return {"numeric": "numeric", "boolean": "boolean", "datetime": "timestamp"}.get(
        type_category(data_type), "text"
    )


def schema_columns(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column; ``is_nullable`` says whether a null occurs in any row."""
    lake = Lake(tables)
    kinds = literal_rows(
        lake.spark,
        "cid int, sql_type string",
        [(cid, sql_type(f.dataType)) for _, columns in lake.tables for cid, f, _ in columns],
    )
    nulls = (
        lake.long(["v"], lambda f, _: [missing_sql(f.name, f.dataType)])
        .groupBy("cid")
        .agg(F.expr("bool_or(v) AS is_nullable"))
    )
    return (
        lake.schema()
        .join(lake.small(kinds), "cid")
        .join(lake.small(nulls), "cid", "left")
        .selectExpr(
            "table_name", "ordinal", "column_name", "data_type AS declared_type", "sql_type",
            "coalesce(is_nullable, false) AS is_nullable",
        )
    )


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Exact counts of all tables in one pass that reads no column (footers, for Parquet)."""
    spark = next(iter(tables.values())).sparkSession
    names = literal_rows(spark, "tid int, table_name string", list(enumerate(tables)))
    marks = [df.select(F.lit(tid).alias("tid")) for tid, df in enumerate(tables.values())]
    counted = reduce(DataFrame.unionAll, marks).groupBy("tid").agg(F.count("*").alias("n"))
    return names.join(counted, "tid", "left").selectExpr(
        "table_name", "coalesce(n, 0L) AS row_count"
    )


def row_estimates(spark: SparkSession, sources: Mapping[str, str]) -> DataFrame:
    """(table_name, row_count, basis) of tables named in the catalogue or lying at a path, without reading their rows if possible.

    ``basis`` is ``statistics`` where the catalogue knows the number, which may be out of date, ``footers`` for Parquet, whose
    files say how many rows they hold, and ``count`` for all others, whose rows are counted.
    """
    known, counted = [], {}
    for name, source in sources.items():
        if spark.catalog.tableExists(source) if "/" not in source else False:
            described = spark.sql(f"DESCRIBE TABLE EXTENDED {source}").where("col_name IN ('Statistics', 'Provider')")
            facts = {r.col_name: r.data_type for r in described.collect()}
            rows = re.search(r"(\d+) rows", facts.get("Statistics", ""))
            if rows:
                known.append((name, int(rows[1])))
                continue
            counted[name] = spark.table(source), "footers" if facts.get("Provider", "").lower() == "parquet" else "count"
        else:
            counted[name] = read(spark, source), "footers" if suffix(source) == ".parquet" else "count"
    frames = [literal_rows(spark, "table_name string, row_count bigint, basis string", [(n, k, "statistics") for n, k in known])]
    if counted:
        bases = literal_rows(spark, "table_name string, basis string", [(n, b) for n, (_, b) in counted.items()])
        frames.append(row_counts({n: df for n, (df, _) in counted.items()}).join(bases, "table_name"))
    return reduce(DataFrame.unionByName, frames)


def size_category(rows: Column) -> Column:
    return F.when(rows < 100_000, "small").when(rows < 10_000_000, "medium").otherwise("large")


def schema_tables(
    tables: Mapping[str, DataFrame],
    keys: Mapping[str, list[str]] | None = None,
    references: Mapping[str, list[str]] | None = None,
) -> DataFrame:
    """Per table: rows, size, columns, and the keys the user declared."""
    keys, references = keys or {}, references or {}
    spark = next(iter(tables.values())).sparkSession
    described = literal_rows(
        spark,
        "table_name string, column_count int, primary_key string, has_primary_key boolean, "
        "has_foreign_keys boolean",
        [
            (n, len(df.columns), ",".join(keys.get(n, [])), bool(keys.get(n)), bool(references.get(n)))
            for n, df in tables.items()
        ],
    )
    return row_counts(tables).join(described, "table_name").select(
        "table_name",
        "row_count",
        size_category(F.col("row_count")).alias("size_category"),
        "column_count",
        "primary_key",
        "has_primary_key",
        "has_foreign_keys",
    )


def table_summary(described: DataFrame) -> DataFrame:
    return described.select(
        "table_name", "row_count", "column_count", "size_category", "has_primary_key",
        "has_foreign_keys",
    ).orderBy("table_name")


#: What a date looks like, before anything is parsed: no numbers, no times of day, no long texts.
_DATE_SHAPE = "length(v) BETWEEN 8 AND 48 AND v RLIKE '^ *[+-]?[0-9]{4,6}-[0-9]{1,2}-[0-9]{1,2}'"


def _newest(lake: Lake, category: str, value: str) -> DataFrame | None:
    """(table_name, column_name, latest) of the first column of a category that holds dates in over half of its values."""
    rows = lake.long(["v"], lambda f, _: [quoted(f.name) if category == "string" else f"CAST({quoted(f.name)} AS TIMESTAMP_NTZ)"], lambda _, c: c == category)
    if rows is None:
        return None
    newest = (
        rows.where("v IS NOT NULL").selectExpr("cid", f"{value} AS ts").groupBy("cid")
        .agg(F.expr("max(ts) AS latest"), F.expr("try_divide(count(ts), count(*)) AS rate")).where("rate > 0.5")
    )
    first = lake.schema().join(lake.small(newest), "cid").groupBy("table_name")
    return first.agg(F.expr("min(struct(cid, column_name, latest)) AS best")).selectExpr(
        "table_name", "best.column_name", "best.latest"
    )


def asset_freshness(tables: Mapping[str, DataFrame], files: bool = False) -> DataFrame:
    """Per table the newest value of its first column that holds dates, and what that rests on.

    Time columns come before strings; strings are looked at only in tables whose time columns, if any, are empty, and parsed
    only where they have the shape of a date. With ``files`` a table that has neither gets the time its files were changed,
    if it is read from files. ``basis`` is ``column``, ``file`` or ``none``.
    """
    spark = next(iter(tables.values())).sparkSession
    found = []  # one row per table
    left = dict(tables)
    for category, value in (
        ("datetime", "v"), ("string", f"CASE WHEN {_DATE_SHAPE} THEN CAST(try_to_timestamp(v) AS TIMESTAMP_NTZ) END"),
    ):
        newest = _newest(Lake(left), category, value) if left else None
        for r in newest.toLocalIterator() if newest is not None else ():
            found.append((r.table_name, r.column_name, r.latest, "column"))
            left.pop(r.table_name)
    for name, df in left.items():
        changed = file_time(df) if files else None
        found.append((name, None, changed, "file" if changed else "none"))
    return literal_rows(spark, "table_name string, column_name string, latest timestamp_ntz, basis string", found)


def file_freshness(df: DataFrame) -> DataFrame:
    """The newest modification time of the files behind a table."""
    return df.select("_metadata.file_modification_time").agg(
        F.max("file_modification_time").alias("latest")
    )


def file_time(df: DataFrame):
    """The newest modification time of the files behind a table; None where it isn't read from files."""
    try:
        found = file_freshness(df)
    except AnalysisException:  # no _metadata: a query, a view or a local table
        return None
    return found.selectExpr("CAST(latest AS TIMESTAMP_NTZ) AS latest").first().latest


def freshness_columns(df: DataFrame) -> list[str]:
    """Columns named like dates, for callers that want to choose themselves."""
    return [c for c in df.columns if any(w in c.lower() for w in rules.DATE_NAME_WORDS)]
