"""Source, sampling and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.session import scratch_path
from assay.sinks import audit, runs
from assay.sources import files, inventory, sampling
from checks.lake import RAW, SHOP, VIEWS, from_sql, lake, over_views, raw, shaped, view

QUERIES, ORACLE = {}, {}


def _round_trip(fmt: str, text: str):
    """Derive a table, write it in a format, and read it back."""

    def run(spark, sf):
        df = from_sql(spark, sf, text)
        path = scratch_path(spark, fmt)
        if fmt in ("csv", "tsv"):
            files.write_csv(df, path, "\t" if fmt == "tsv" else ",")
            back = files.read_csv(spark, path) if fmt == "csv" else files.read_tsv(spark, path)
        elif fmt == "jsonl":
            df.write.json(path)
            back = files.read_json(spark, path, lines=True)
        else:
            df.write.parquet(path)
            back = files.read(spark, f"{path}/*.parquet")
        return shaped(back.select(*df.columns))

    return run


_FLAT = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
                  CAST(CAST(o_orderdate AS DATE) AS STRING) AS o_day FROM {orders}"""
for _fmt in ("csv", "tsv", "jsonl", "parquet"):
    QUERIES[f"src_{_fmt}"] = _round_trip(_fmt, _FLAT)
    ORACLE[f"src_{_fmt}"] = _FLAT.format(orders="orders")

# whole texts: quotes, separators and line breaks inside fields
_TEXTS = "SELECT doc_id, lang, text, source FROM {documents}"
for _fmt in ("csv", "tsv"):
    QUERIES[f"src_{_fmt}_texts"] = _round_trip(_fmt, _TEXTS)
    ORACLE[f"src_{_fmt}_texts"] = _TEXTS.format(documents="documents")


#: records of a JSON document
DOCUMENT = 10_000


def _documents(spark, sf):
    """JSON documents: each file holds an array of a bounded number of records.

    Records are numbered as they are read, whatever their keys. Documents are not small, since Spark's inference of a schema
    goes through the list of all files of a task for each of them.
    """
    df = from_sql(spark, sf, _FLAT)
    path = scratch_path(spark, "json")
    bucket = F.floor(F.monotonically_increasing_id() / DOCUMENT)
    docs = df.withColumn("b", bucket).groupBy("b").agg(
        F.to_json(F.sort_array(F.collect_list(F.struct(*df.columns)))).alias("value")
    )
    docs.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return shaped(files.read_json(spark, path).select(*df.columns))


QUERIES["src_json"] = _documents
ORACLE["src_json"] = _FLAT.format(orders="orders")


def _assets(spark, sf):
    found = files.file_inventory(spark, sf)
    return shaped(found.select("name", "asset_type", "suffix"))


QUERIES["assets_inventory"] = _assets
ORACLE["assets_inventory"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', 'file', '.parquet')" for t in RAW
) + ") AS t(name, asset_type, suffix)"


def _sql_type(kind, category):
    if kind in ("int", "bigint"):
        return "integer"
    return {"numeric": "numeric", "boolean": "boolean", "datetime": "timestamp"}.get(category, "text")


QUERIES["schema_columns"] = lambda s, d: shaped(inventory.schema_columns(lake(s, d)))
ORACLE["schema_columns"] = over_views(
    " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, {i} AS ordinal, '{c}' AS column_name, '{k}' AS declared_type,
               '{_sql_type(k, cat)}' AS sql_type, count(*) > count({c}) AS is_nullable FROM v_{t}"""
        for t in SHOP
        for i, (c, k, cat) in enumerate(VIEWS[t][1])
    )
)


def _raw_tables(spark, sf):
    return {t: raw(spark, sf, t) for t in RAW}


_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in RAW)
QUERIES["table_row_counts"] = lambda s, d: shaped(inventory.row_counts(_raw_tables(s, d)))
ORACLE["table_row_counts"] = _COUNTS
QUERIES["asset_freshness"] = lambda s, d: shaped(inventory.asset_freshness(lake(s, d)).drop("basis"))
ORACLE["asset_freshness"] = over_views(
    """SELECT 'orders' AS table_name, 'order_date' AS column_name, max(order_date) AS latest FROM v_orders
       UNION ALL SELECT 'order_items', 'ship_date', max(ship_date) FROM v_order_items
       UNION ALL SELECT 'customers', 'signup_date', max(TRY_CAST(signup_date AS TIMESTAMP)) FROM v_customers
       UNION ALL SELECT 'activity', 'created_at', max(created_at) FROM v_activity
       UNION ALL SELECT 'products', NULL, NULL"""
)


def _freshness_basis(spark, sf):
    """Raw tables, some without any date: these get the time of their files, which SQL over the tables can't know."""
    fresh = inventory.asset_freshness(_raw_tables(spark, sf), files=True)
    latest = F.when(F.col("basis") == "column", F.col("latest"))
    return shaped(fresh.select("table_name", "column_name", "basis", latest.alias("latest"), F.col("latest").isNotNull().alias("known")))


_DATED = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}
QUERIES["asset_freshness_basis"] = _freshness_basis
ORACLE["asset_freshness_basis"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{_DATED[t]}' AS column_name, 'column' AS basis, CAST(max({_DATED[t]}) AS TIMESTAMP) AS latest, true AS known FROM {t}"
    if t in _DATED
    else f"SELECT '{t}', NULL, 'file', NULL, true"
    for t in sorted(RAW, key=lambda t: t not in _DATED)
)


def _estimates(spark, sf):
    """A table with statistics in the catalogue, one without them, a Parquet file, and lines of JSON."""
    names = {"orders": "assay_with_statistics", "customer": "assay_without_statistics"}
    for table, name in names.items():
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{sf}/{table}.parquet'")
    spark.sql("ANALYZE TABLE assay_with_statistics COMPUTE STATISTICS")
    path = scratch_path(spark, "nations") + ".jsonl"
    raw(spark, sf, "nation").write.json(path)
    found = inventory.row_estimates(spark, names | {"part": f"{sf}/part.parquet", "nation": path})
    return shaped(found)


QUERIES["row_estimates"] = _estimates
ORACLE["row_estimates"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count, '{basis}' AS basis FROM {t}"
    for t, basis in (("orders", "statistics"), ("customer", "footers"), ("part", "footers"), ("nation", "count"))
)
QUERIES["sample_exact"] = lambda s, d: shaped(
    sampling.extract(raw(s, d, "lineitem"), "sample", 0.05, 2_000, key=["l_orderkey", "l_linenumber"])
    .select("l_orderkey", "l_linenumber")
)
ORACLE["sample_exact"] = """
SELECT l_orderkey, l_linenumber FROM lineitem
ORDER BY ('0x' || substr(sha256('42|=' || l_orderkey || '|=' || l_linenumber), 1, 15))::BIGINT
LIMIT (SELECT least(CAST(floor(count(*) * 0.05) AS BIGINT), 2000) FROM lineitem)"""
QUERIES["sample_head"] = lambda s, d: shaped(
    sampling.head(view(s, d, "order_items"), 500, ["order_id", "product_id", "line_number", "price"])
)
ORACLE["sample_head"] = over_views(
    """SELECT * REPLACE (round(quantity, 6) AS quantity, round(price, 6) AS price, round(discount, 6) AS discount)
       FROM v_order_items ORDER BY order_id, product_id, line_number, price LIMIT 500""",
    ["order_items"],
)
QUERIES["sample_rate"] = lambda s, d: shaped(
    sampling.by_modulus(view(s, d, "orders"), F.col("order_id"), 10).select("order_id", "order_total")
)
ORACLE["sample_rate"] = over_views(
    "SELECT order_id, round(order_total, 6) AS order_total FROM v_orders WHERE order_id % 10 = 0", ["orders"]
)


def _hash_sample(spark, sf):
    """A 10 % sample by hash: its size and that it keeps keys whole."""
    df = sampling.by_rate(view(spark, sf, "orders"), F.col("order_id"), 10)
    return df.groupBy("status").agg(F.count("*").alias("rows"))


QUERIES["sample_hash"] = _hash_sample
ORACLE["sample_hash"] = over_views(
    """SELECT status, count(*) AS rows FROM v_orders
       WHERE ('0x' || substr(sha256(CAST(order_id AS VARCHAR)), 1, 8))::BIGINT % 100 < 10 GROUP BY status""",
    ["orders"],
)

_KEYS = {"orders": ["order_id"], "customers": ["customer_id"], "products": ["product_id"]}
_REFS = {"orders": ["customer_id"], "order_items": ["order_id", "product_id"]}
_DESCRIBED = " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, count(*) AS row_count,
           CASE WHEN count(*) < 100000 THEN 'small' WHEN count(*) < 10000000 THEN 'medium' ELSE 'large' END AS size_category,
           {len(VIEWS[t][1])} AS column_count, '{",".join(_KEYS.get(t, []))}' AS primary_key,
           {str(t in _KEYS).lower()} AS has_primary_key, {str(t in _REFS).lower()} AS has_foreign_keys FROM v_{t}"""
    for t in SHOP
)
QUERIES["schema_tables"] = lambda s, d: shaped(inventory.schema_tables(lake(s, d), _KEYS, _REFS))
ORACLE["schema_tables"] = over_views(_DESCRIBED)
QUERIES["table_summary"] = lambda s, d: shaped(
    inventory.table_summary(inventory.schema_tables(lake(s, d), _KEYS, _REFS))
)
ORACLE["table_summary"] = over_views(
    f"""SELECT table_name, row_count, column_count, size_category, has_primary_key, has_foreign_keys
        FROM ({_DESCRIBED})"""
)
QUERIES["sampling_plan"] = lambda s, d: shaped(
    sampling.sampling_plan(inventory.row_counts(_raw_tables(s, d)), small=1_000, large=20_000, max_rows=2_500)
)
ORACLE["sampling_plan"] = f"""
SELECT table_name, row_count, CASE WHEN row_count <= 1000 THEN 'full' ELSE 'sample' END AS method,
       CASE WHEN row_count <= 1000 THEN 1.0 WHEN row_count <= 20000 THEN 0.1 ELSE 0.05 END::DOUBLE AS rate,
       CASE WHEN row_count <= 1000 THEN row_count WHEN row_count <= 20000 THEN least(CAST(floor(row_count * 0.1) AS BIGINT), 2500)
            ELSE least(CAST(floor(row_count * 0.05) AS BIGINT), 2500) END AS expected_rows
FROM ({_COUNTS})"""
QUERIES["sample_stratified_by_date"] = lambda s, d: shaped(
    sampling.stratified_by_date(
        raw(s, d, "orders"), "o_orderdate", ["o_orderkey"], strata=12, per_stratum=40
    ).select("stratum", "o_orderkey", "o_orderdate")
)
ORACLE["sample_stratified_by_date"] = """
SELECT stratum, o_orderkey, o_orderdate FROM (
  SELECT *, least(CAST(floor((epoch_us(o_orderdate) - lo) * 12 / (hi - lo)) AS BIGINT), 11) AS stratum
  FROM orders, (SELECT min(epoch_us(o_orderdate)) AS lo, max(epoch_us(o_orderdate)) AS hi FROM orders))
QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY o_orderkey) <= 40"""


def _adhoc(spark, sf):
    sql = "SELECT status, count(*) AS orders FROM orders WHERE order_total > :least GROUP BY status"
    return shaped(files.ad_hoc(spark, sql, {"orders": view(spark, sf, "orders")}, least=1000.0))


QUERIES["ad_hoc_query"] = _adhoc
ORACLE["ad_hoc_query"] = over_views(
    "SELECT status, count(*) AS orders FROM v_orders WHERE order_total > 1000 GROUP BY status", ["orders"]
)

# --- stored runs and logs -----------------------------------------------------

_AUDIT = """
SELECT ts AS timestamp, event_type, concat('user-', CAST(user_id AS STRING)) AS actor,
       concat('table-', CAST(event_id % 20 AS STRING)) AS resource,
       CASE WHEN event_type = 'error' THEN 'warning' ELSE 'info' END AS severity
FROM {events}"""


def _log(spark, sf):
    """An audit log of the events, with a broken line for every hundredth."""
    records = from_sql(spark, sf, _AUDIT).withColumn(
        "details", F.create_map(F.lit("source"), F.lit("events"))
    )
    lines = audit.as_lines(records)
    broken = from_sql(spark, sf, "SELECT concat('{{\"timestamp\": ', event_id) AS value FROM {events} WHERE event_id % 100 = 0")
    path = scratch_path(spark, "audit")
    lines.unionByName(broken).write.mode("append").text(path)
    return audit.read_log(spark, path)


QUERIES["audit_tail"] = lambda s, d: shaped(audit.tail(_log(s, d), 50, "purchase").drop("details"))
ORACLE["audit_tail"] = f"""SELECT * FROM ({_AUDIT.format(events='events').replace('STRING', 'VARCHAR')})
WHERE event_type = 'purchase' ORDER BY timestamp DESC, event_type, actor, resource LIMIT 50"""
QUERIES["audit_counts"] = lambda s, d: shaped(audit.counts(_log(s, d)))
ORACLE["audit_counts"] = "SELECT event_type, count(*) AS records FROM events GROUP BY event_type"


def _artifacts(spark, sf):
    """Save two artifacts of three runs, then list runs and artifacts from the store."""
    root = scratch_path(spark, "store")
    counts = inventory.row_counts(lake(spark, sf))
    for run_id in ("r1", "r2"):
        runs.save(counts, root, "schema", run_id)
    runs.save(sampling.sampling_plan(counts), root, "sampling_manifest", "r3")
    listed = runs.list_runs(spark, root, "schema").select(
        "run_id", F.lit("schema").alias("artifact")
    )
    more = runs.list_runs(spark, root, "sampling_manifest").select(
        "run_id", F.lit("sampling_manifest").alias("artifact")
    )
    kept = runs.load(spark, root, "schema", run_id="r2")
    size = kept.agg(F.sum("row_count")).scalar()
    return shaped(listed.unionByName(more).withColumn("rows_of_r2", size))


QUERIES["run_store"] = _artifacts
ORACLE["run_store"] = over_views(
    "SELECT run_id, artifact, n AS rows_of_r2 FROM (VALUES ('r1', 'schema'), ('r2', 'schema'), ('r3', 'sampling_manifest')) "
    "AS t(run_id, artifact), (SELECT CAST("
    + " + ".join(f"(SELECT count(*) FROM v_{t})" for t in SHOP)
    + " AS BIGINT) AS n)"
)
