"""Options for reading PostgreSQL and MySQL tables in parallel through Spark's JDBC source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_URLS = {"postgres": "jdbc:postgresql://{host}:{port}/{database}", "mysql": "jdbc:mysql://{host}:{port}/{database}"}
_DRIVERS = {"postgres": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver"}
_QUOTES = {"postgres": '"', "mysql": "`"}
_PORTS = {"postgres": 5432, "mysql": 3306}


def quoted(dialect: str, *names: str) -> str:
    q = _QUOTES[dialect]
    return ".".join(q + n.replace(q, q + q) + q for n in names)


def options(
    dialect: str,
    host: str,
    database: str,
    table: str,
    schema: str | None = None,
    port: int | None = None,
    user: str | None = None,
    password: str | None = None,
    split_column: str | None = None,
    bounds: tuple[str | int, str | int] | None = None,
    partitions: int = 32,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Reader options; filters, limits, samples and aggregates are pushed to the server.

    With ``split_column`` and ``bounds`` the table is read by ``partitions`` tasks.
    """
    out = {
        "url": _URLS[dialect].format(host=host, port=port or _PORTS[dialect], database=database),
        "driver": _DRIVERS[dialect],
        "dbtable": quoted(dialect, *([schema, table] if schema else [table])),
        "fetchsize": str(fetch_size),
        "pushDownPredicate": "true",
        "pushDownLimit": "true",
        "pushDownTableSample": "true",
        "pushDownAggregate": "true",
    }
    if user is not None:
        out["user"] = user
    if password is not None:
        out["password"] = password
    if dialect == "postgres":
        # a session that cannot write
        out["sessionInitStatement"] = "SET SESSION CHARACTERISTICS AS TRANSACTION READ ONLY"
    else:
        out["sessionInitStatement"] = "SET SESSION TRANSACTION READ ONLY"
    if split_column is not None:
        if bounds is None:
            raise ValueError("split_column needs bounds")
        out.update(
            partitionColumn=split_column,
            lowerBound=str(bounds[0]),
            upperBound=str(bounds[1]),
            numPartitions=str(partitions),
        )
    return out


def read_jdbc(spark: SparkSession, **named) -> DataFrame:
    return spark.read.format("jdbc").options(**options(**named)).load()


def inventory_query(dialect: str) -> str:
    """The catalog query listing user tables, for the ``query`` option of a reader."""
    hidden = {
        "postgres": "('pg_catalog', 'information_schema')",
        "mysql": "('mysql', 'information_schema', 'performance_schema', 'sys')",
    }[dialect]
    return (
        "SELECT table_schema AS namespace, table_name AS name FROM information_schema.tables "
        f"WHERE table_type = 'BASE TABLE' AND table_schema NOT IN {hidden}"
    )
