"""E-commerce KPIs over orders, order items and carts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assay.functions.salting import salted_join
from assay.kpi._time import months_ago, period, ratio


def average_order_value(orders: DataFrame, as_of: str) -> DataFrame:
    recent = orders.where(F.col("order_date") >= months_ago(as_of, 12))
    return (
        recent.groupBy(period("month", F.col("order_date")).alias("period"))
        .agg(F.avg("order_total").alias("aov"), F.count_distinct("order_id").alias("orders"))
        .orderBy("period")
    )


def customer_lifetime_value(orders: DataFrame) -> DataFrame:
    return (
        orders.groupBy("customer_id")
        .agg(
            F.sum("order_total").alias("lifetime_value"),
            F.count_distinct("order_id").alias("order_count"),
            F.min("order_date").alias("first_order"),
            F.max("order_date").alias("last_order"),
        )
        .orderBy(F.desc("lifetime_value"))
    )


def conversion_rate(orders: DataFrame) -> DataFrame:
    """Orders per distinct customer and week."""
    return (
        orders.groupBy(period("week", F.col("order_date")).alias("period"))
        .agg(
            ratio(F.count_distinct("order_id"), F.count_distinct("customer_id")).alias(
                "conversion_rate"
            )
        )
        .orderBy("period")
    )


def cart_abandonment(cart: DataFrame, orders: DataFrame) -> DataFrame:
    """Distinct carts against distinct orders placed from them, one row.

    Both sides shrink to distinct keys before they meet; a cart with very many
    orders is spread over tasks by order.
    """
    carts = cart.select("cart_id").where("cart_id IS NOT NULL").distinct()
    placed = orders.select("cart_id", "order_id").where("cart_id IS NOT NULL").distinct()
    kept = salted_join(placed, carts, ["cart_id"], [F.col("order_id")], "left_semi")
    per_cart = kept.agg(F.count_distinct("order_id").alias("converted"))
    total = carts.agg(F.count("*").alias("total_carts"))
    both = total.select("total_carts", F.lit(0).cast("bigint").alias("converted")).unionByName(
        per_cart.select(F.lit(0).cast("bigint").alias("total_carts"), "converted")
    )
    sums = both.agg(F.sum("total_carts").alias("total_carts"), F.sum("converted").alias("converted"))
    return sums.select(
        (F.col("total_carts") - F.col("converted")).alias("abandoned"),
        "total_carts",
        (1.0 - ratio(F.col("converted"), F.col("total_carts"))).alias("abandonment_rate"),
    )


def revenue_growth(orders: DataFrame) -> DataFrame:
    """Change of revenue from month to month. The window runs over months, not orders."""
    monthly = orders.groupBy(period("month", F.col("order_date")).alias("m")).agg(
        F.sum("order_total").alias("rev")
    )
    before = F.lag("rev").over(W.orderBy("m"))
    return monthly.select("m", "rev", ratio(F.col("rev") - before, before).alias("growth_rate"))


def retention_rate(orders: DataFrame, days: int = 30) -> DataFrame:
    """Share of customers with an order later than ``days`` after their first.

    A customer qualifies exactly if the last order does, so one aggregate per
    customer answers it without joining orders to themselves.
    """
    spans = orders.where("customer_id IS NOT NULL").groupBy("customer_id").agg(
        F.min("order_date").alias("first"), F.max("order_date").alias("last")
    )
    later = F.col("last") > F.col("first") + F.make_dt_interval(F.lit(days))
    return spans.agg(ratio(F.count_if(later), F.count("*")).alias("retention_rate"))


def items_per_order(orders: DataFrame, order_items: DataFrame) -> DataFrame:
    """Mean item count per order and month; both sides meet as one row per order and month."""
    counts = order_items.groupBy("order_id").agg(F.count("*").alias("items"))
    placed = orders.groupBy(
        "order_id", period("month", F.col("order_date")).alias("period")
    ).agg(F.count("*").alias("rows"))
    return (
        placed.join(counts, "order_id")
        .groupBy("period")
        .agg(
            ratio(F.sum(F.col("rows") * F.col("items")), F.sum("rows")).alias("avg_items_per_order")
        )
        .orderBy("period")
    )
