"""A shop with flaws, derived from the given tables.

The given tables hold no nulls and no repeated rows, so the diagnostics run on
views that add both by key. One SQL text per view serves both engines.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AS_OF = "2001-10-01 00:00:00"

RAW = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# view name -> (SQL over {raw} tables, [(column, Spark type, category)])
VIEWS: dict[str, tuple[str, list[tuple[str, str, str]]]] = {
    "orders": (
        """
        SELECT o_orderkey AS order_id,
               CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END AS customer_id,
               CASE WHEN o_orderkey % 97 = 0 THEN -o_totalprice ELSE o_totalprice END AS order_total,
               o_orderdate AS order_date,
               o_orderstatus AS status,
               'web' AS channel,
               CAST(NULL AS STRING) AS promo_code,
               o_orderkey % 3 = 0 AS is_gift,
               CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 1000 END AS cart_id
        FROM (SELECT * FROM {orders} UNION ALL SELECT * FROM {orders} WHERE o_orderkey % 50 = 0) o
        """,
        [
            ("order_id", "bigint", "numeric"),
            ("customer_id", "bigint", "numeric"),
            ("order_total", "double", "numeric"),
            ("order_date", "timestamp_ntz", "datetime"),
            ("status", "string", "string"),
            ("channel", "string", "string"),
            ("promo_code", "string", "string"),
            ("is_gift", "boolean", "boolean"),
            ("cart_id", "bigint", "numeric"),
        ],
    ),
    "order_items": (
        """
        SELECT l_orderkey AS order_id, l_partkey AS product_id, l_linenumber AS line_number,
               l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount,
               l_shipdate AS ship_date
        FROM {lineitem}
        """,
        [
            ("order_id", "bigint", "numeric"),
            ("product_id", "bigint", "numeric"),
            ("line_number", "int", "numeric"),
            ("quantity", "double", "numeric"),
            ("price", "double", "numeric"),
            ("discount", "double", "numeric"),
            ("ship_date", "timestamp_ntz", "datetime"),
        ],
    ),
    "customers": (
        """
        SELECT c_custkey AS customer_id,
               c_name AS full_name,
               CASE WHEN c_custkey % 20 = 0 THEN NULL
                    ELSE concat('user', CAST(c_custkey AS STRING), '@example.com') END AS email,
               concat('555', lpad(CAST(c_custkey AS STRING), 7, '0')) AS phone,
               c_mktsegment AS segment,
               c_acctbal AS balance,
               CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal * 2 END AS credit_limit,
               CAST(c_nationkey AS STRING) AS country_code,
               CASE WHEN c_custkey % 2 = 0 THEN 'yes' ELSE 'no' END AS newsletter,
               CASE WHEN c_custkey % 3 = 0 THEN NULL
                    ELSE concat('2001-0', CAST(c_custkey % 9 + 1 AS STRING), '-15') END AS signup_date
        FROM {customer}
        """,
        [
            ("customer_id", "bigint", "numeric"),
            ("full_name", "string", "string"),
            ("email", "string", "string"),
            ("phone", "string", "string"),
            ("segment", "string", "string"),
            ("balance", "double", "numeric"),
            ("credit_limit", "double", "numeric"),
            ("country_code", "string", "string"),
            ("newsletter", "string", "string"),
            ("signup_date", "string", "string"),
        ],
    ),
    "products": (
        """
        SELECT p_partkey AS product_id, p_name AS product_name, p_brand AS brand,
               p_type AS product_type, p_size AS size, p_retailprice AS list_price
        FROM {part}
        """,
        [
            ("product_id", "bigint", "numeric"),
            ("product_name", "string", "string"),
            ("brand", "string", "string"),
            ("product_type", "string", "string"),
            ("size", "int", "numeric"),
            ("list_price", "double", "numeric"),
        ],
    ),
    "activity": (
        """
        SELECT event_id, ts AS created_at, user_id, event_type, value AS amount, props,
               CASE WHEN event_id % 100 = 7 THEN value * 50 ELSE 0.0 END AS refund,
               CASE WHEN event_id % 300 = 1 THEN 'fatal' WHEN event_id % 25 = 2 THEN 'error' ELSE 'info' END AS level
        FROM {events}
        """,
        [
            ("event_id", "bigint", "numeric"),
            ("created_at", "timestamp_ntz", "datetime"),
            ("user_id", "bigint", "numeric"),
            ("event_type", "string", "string"),
            ("amount", "double", "numeric"),
            ("props", "string", "string"),
            ("refund", "double", "numeric"),
            ("level", "string", "string"),
        ],
    ),
}

SHOP = list(VIEWS)


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run a view text over the raw tables it names."""
    used = {n: raw(spark, sf_dir, n) for n in RAW if "{" + n + "}" in text}
    return spark.sql(text, **used)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return from_sql(spark, sf_dir, VIEWS[name][0])


def lake(spark: SparkSession, sf_dir: str, names: Iterable[str] = SHOP) -> dict[str, DataFrame]:
    return {n: view(spark, sf_dir, n) for n in names}


def shaped(df: DataFrame, digits: int = 6) -> DataFrame:
    """Whole numbers as bigint and doubles rounded, for comparison across engines."""
    out = []
    for f in df.schema.fields:
        c = F.col("`" + f.name + "`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, (T.ArrayType,)):
            c = F.array_join(c.cast("array<string>"), "|")
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)


# --- the same views and their profile as SQL for the other engine -------------


def sql_views(names: Iterable[str] = SHOP) -> str:
    """``v_<name> AS (...)`` for a WITH clause."""
    raws = {n: n for n in RAW}
    return ",\n".join(f"v_{n} AS ({VIEWS[n][0].format(**raws)})" for n in names)


_PATTERNS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone": r"^\+?1?\d{10,15}$|^\(\d{3}\)\s?\d{3}-?\d{4}$",
    "ssn": r"^\d{3}-?\d{2}-?\d{4}$",
    "credit_card": r"^\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}$",
    "ip_address": r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$",
}


#: what is blank at the ends of a value, by code point
_BLANK = "list_aggregate(list_transform([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202, 8232, 8233, 8239, 8287, 12288], lambda c: chr(c)), 'string_agg', '')"


def _column_sql(table: str, ordinal: int, name: str, dtype: str, category: str) -> str:
    x = name
    out = [
        f"'{table.removeprefix('v_')}' AS table_name",
        f"'{name}' AS column_name",
        f"{ordinal} AS ordinal",
        f"'{dtype}' AS data_type",
        f"'{category}' AS type_category",
        "count(*) AS total_count",
        f"count(*) - count({x}) AS null_count",
        f"(count(*) - count({x})) * 100.0 / count(*) AS null_percent",
        f"count(DISTINCT {x}) AS unique_count",
        f"count(DISTINCT {x}) * 100.0 / count(*) AS unique_percent",
    ]
    if category == "numeric":
        d = f"CAST({x} AS DOUBLE)"
        mean = f"(SELECT avg({d}) FROM {table})"
        out += [
            f"min({d}) AS min_value", f"max({d}) AS max_value", f"avg({d}) AS mean",
            f"stddev_samp({d}) AS std",
            f"quantile_cont({d}, 0.25) AS q25", f"quantile_cont({d}, 0.5) AS median",
            f"quantile_cont({d}, 0.75) AS q75",
            f"avg(power({d} - {mean}, 3)) / power(var_pop({d}), 1.5) AS skewness",
            f"avg(power({d} - {mean}, 4)) / power(var_pop({d}), 2) - 3 AS kurtosis",
            f"count(*) FILTER ({x} < 0) AS negative_count",
        ]
    if category == "string":
        out += [
            f"min(length({x})) AS min_length", f"max(length({x})) AS max_length",
            f"avg(length({x})) AS avg_length",
            f"count(*) FILTER ({x} = '') AS empty_count",
            f"coalesce(bool_or(contains({x}, '@')), false) AS has_email",
            rf"coalesce(bool_or(regexp_matches({x}, '\d{{3}}[-\s]?\d{{3}}[-\s]?\d{{4}}')), false) AS has_phone",
            f"coalesce(bool_or(regexp_matches({x}, 'http[s]?://')), false) AS has_url",
            *[
                f"count(*) FILTER (regexp_matches({x}, '{p}')) AS {k}_count"
                for k, p in _PATTERNS.items()
            ],
            f"count(*) FILTER (trim({x}, {_BLANK}) <> '') AS nonblank_count",
            f"count(*) FILTER (trim({x}, {_BLANK}) LIKE '{{%') AS object_count",
            f"count(*) FILTER (trim({x}, {_BLANK}) LIKE '[%') AS array_count",
            f"count(*) FILTER (trim({x}, {_BLANK}) LIKE '<%') AS markup_count",
            f"count(*) FILTER (TRY_CAST(replace({x}, ',', '') AS DOUBLE) IS NOT NULL) AS number_count",
            rf"count(*) FILTER (regexp_matches({x}, '\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}')) AS date_count",
            f"count(*) FILTER (lower(trim({x}, {_BLANK})) IN ('true','false','yes','no','1','0','y','n','t','f')) AS boolean_count",
        ]
        if any(w in name for w in ("date", "time", "created", "updated")):
            out += [
                f"min(TRY_CAST({x} AS TIMESTAMP)) AS min_ts", f"max(TRY_CAST({x} AS TIMESTAMP)) AS max_ts",
            ]
    if category == "boolean":
        out += [
            f"count(*) FILTER ({x}) AS true_count", f"count(*) FILTER (NOT {x}) AS false_count",
            f"round(count(*) FILTER ({x}) * 100.0 / greatest(count({x}), 1), 1) AS true_percent",
        ]
    if category == "datetime":
        out += [
            f"min({x}) AS min_ts", f"max({x}) AS max_ts",
            f"CAST(floor(date_diff('second', min({x}), max({x})) / 86400.0) AS BIGINT) AS range_days",
            f"count(*) FILTER ({x} > TIMESTAMP '{AS_OF}') AS future_count",
        ]
    return f"SELECT {', '.join(out)} FROM {table}"


def sql_profile(names: Iterable[str] = SHOP) -> str:
    """The column profile of the views, as a UNION over columns."""
    selects = [
        _column_sql(f"v_{n}", i, c, t, k)
        for n in names
        for i, (c, t, k) in enumerate(VIEWS[n][1])
    ]
    return "\nUNION ALL BY NAME\n".join(selects)


def sql_tops(names: Iterable[str] = SHOP, top_n: int = 10) -> str:
    """(table_name, column_name, type_category, rank, value, count, percent)."""
    selects = [
        f"""SELECT '{n}' AS table_name, '{c}' AS column_name, '{k}' AS type_category,
                   row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank,
                   CAST({c} AS VARCHAR) AS value, count(*) AS count,
                   count(*) * 100.0 / (SELECT count(*) FROM v_{n}) AS percent
            FROM v_{n} WHERE {c} IS NOT NULL GROUP BY {c}
            QUALIFY rank <= {top_n}"""
        for n in names
        for c, _, k in VIEWS[n][1]
    ]
    return "\nUNION ALL\n".join(selects)


def sql_duplicates(names: Iterable[str] = SHOP) -> str:
    """(table_name, row_count, duplicate_rows, duplicate_percent)."""
    selects = []
    for n in names:
        keys = ", ".join(c for c, _, _ in VIEWS[n][1])
        selects.append(
            f"""SELECT '{n}' AS table_name, CAST(sum(k) AS BIGINT) AS row_count,
                       CAST(sum(k - 1) AS BIGINT) AS duplicate_rows,
                       sum(k - 1) * 100.0 / sum(k) AS duplicate_percent
                FROM (SELECT count(*) AS k FROM v_{n} GROUP BY {keys})"""
        )
    return "\nUNION ALL\n".join(selects)


def over_profile(body: str, names: Iterable[str] = SHOP, tops: bool = False, duplicates: bool = False) -> str:
    """``body`` over the CTEs v_*, p (profile), tops and d (duplicates)."""
    parts = [sql_views(names), f"p AS ({sql_profile(names)})"]
    if tops:
        parts.append(f"tops AS ({sql_tops(names)})")
    if duplicates:
        parts.append(f"d AS ({sql_duplicates(names)})")
    lead, body = ("WITH ", body) if not body.lstrip().upper().startswith("WITH ") else ("WITH ", "," + body.lstrip()[5:])
    return lead + ",\n".join(parts) + "\n" + body


def over_views(body: str, names: Iterable[str] = SHOP) -> str:
    return f"WITH {sql_views(names)}\n{body}"


def rounded(sql: str, columns: Iterable[str], digits: int = 6) -> str:
    shown = ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({shown}) FROM ({sql})"
