from conftest import rows
from pyspark.sql import functions as F

from assay.functions.salting import salted_join
from assay.kpi import catalog, detect, ecommerce, health, marketing
from assay.operators import profile as P
from assay.operators import readiness as Z


def named(spark, tables):
    frames = {t: spark.range(3).selectExpr(*[f"id AS {c}" for c in cols]) for t, cols in tables.items()}
    return P.profile_tables(frames, parts=(P.STATS,))


SHOP = {
    "orders": ["order_id", "order_total", "order_date", "customer_id"],
    "customers": ["customer_id"], "order_items": ["order_id", "product_id", "quantity", "price"],
    "products": ["product_id"],
}


def test_detection(spark):
    got = detect.detect_industry(named(spark, SHOP)).first()
    assert got["industry"] == "ecommerce" and got["confidence"] == round(11 / 17, 4)
    other = detect.detect_industry(named(spark, {"things": ["a", "order_id"]})).first()
    assert other["industry"] == "general" and other["runner_up"] == "ecommerce"
    fixed = detect.detect_industry(named(spark, SHOP), specified="IoT").first()
    assert (fixed["industry"], fixed["method"], fixed["confidence"]) == ("iot", "specified", 1.0)


def test_recommendations(spark):
    got = rows(detect.recommend(named(spark, SHOP)), "rank")
    assert [r["priority"] for r in got] == [1, 2, 3, 5, 6, 7]
    assert all(r["formula"] and r["required_tables"] and r["grain"] for r in got)
    ready = {(r["industry"], r["priority"]): r for r in rows(detect.kpi_readiness(named(spark, SHOP)))}
    assert ready["ecommerce", 4]["missing_tables"] == ["cart"]
    assert ready["general", 1]["is_ready"] and not ready["iot", 4]["is_ready"]
    assert len(ready) == len(catalog.KPIS) == 33


def test_every_catalogue_query_exists():
    import importlib

    for kpi in catalog.KPIS:
        module, _, name = kpi.query.partition(".")
        assert callable(getattr(importlib.import_module(f"assay.kpi.{module}"), name))


def test_retention_and_carts(spark):
    orders = spark.sql(
        "SELECT * FROM VALUES (1, TIMESTAMP_NTZ '2024-01-01', 1, 7), (1, TIMESTAMP_NTZ '2024-03-01', 2, 7),"
        "(2, TIMESTAMP_NTZ '2024-01-01', 3, 8), (2, TIMESTAMP_NTZ '2024-01-31', 4, NULL), (NULL, TIMESTAMP_NTZ '2025-01-01', 5, 9)"
        " AS t(customer_id, order_date, order_id, cart_id)"
    )
    # exactly thirty days later does not count
    assert ecommerce.retention_rate(orders).first()[0] == 0.5
    cart = spark.createDataFrame([(7,), (8,), (6,), (None,)], "cart_id int")
    got = ecommerce.cart_abandonment(cart, orders).first()
    assert (got["abandoned"], got["total_carts"]) == (0, 3)


def test_spend_joins_match_the_plain_join_with_a_hot_campaign(spark):
    leads = spark.range(3000).selectExpr(
        "id % 2000 AS lead_id", "IF(id % 3 < 2, 1, id % 5) AS campaign_id", "IF(id % 4 = 0, 'converted', 'open') AS status",
        "TIMESTAMP_NTZ '2024-01-15' + make_dt_interval(CAST(id % 60 AS INT)) AS created_at",
    )
    campaigns = spark.range(6).selectExpr("id % 4 AS campaign_id", "id * 10D AS spend")
    got = rows(marketing.acquisition_cost(leads, campaigns), "period")
    plain = (
        leads.join(campaigns, "campaign_id")
        .groupBy(F.date_trunc("month", "created_at").cast("timestamp_ntz").alias("period"))
        .agg((F.sum("spend") / F.count_distinct(F.when(F.col("status") == "converted", F.col("lead_id")))).alias("cac"))
    )
    assert [(r["period"], round(r["cac"], 9)) for r in got] == [
        (r["period"], round(r["cac"], 9)) for r in rows(plain, "period")
    ]


def test_salted_join_is_a_join(spark):
    big = spark.range(1000).selectExpr("id", "IF(id % 3 = 0, 0, id % 20) AS k")
    small = spark.range(10).selectExpr("id AS k", "id * 2 AS v")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = salted_join(big, small, ["k"], [F.col("id")], how)
        want = big.join(small, "k", how)
        assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == want.count()


def test_drift(spark):
    old = spark.createDataFrame([("t", "a", "int"), ("t", "b", "int")], "table_name string, column_name string, data_type string")
    new = spark.createDataFrame([("t", "a", "string"), ("t", "c", "int")], "table_name string, column_name string, data_type string")
    got = {r["column_name"]: r["change_type"] for r in rows(health.schema_drift(old, new))}
    assert got == {"a": "type_changed", "b": "removed", "c": "added"}


def test_readiness_bounds(spark):
    overview = spark.sql(
        "SELECT CAST(NULL AS STRING) AS run_id, 25D AS duplicate_percent, 4 AS constant_columns, 3 AS columns_fully_null, 6 AS suspicious_id_columns"
    )
    assert Z.structure_points(overview).first()["structure_quality"] == 4
