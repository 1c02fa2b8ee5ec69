"""Subscription KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.kpi._spend import spend_per_person
from assay.kpi._time import month_start, period, ratio


def _active():
    return F.col("status") == "active"


def recurring_revenue(subscriptions: DataFrame) -> DataFrame:
    return (
        subscriptions.where(_active())
        .groupBy(period("month", F.col("created_at")).alias("period"))
        .agg(F.sum("mrr").alias("total_mrr"), F.count_distinct("subscription_id").alias("active_subs"))
        .orderBy("period")
    )


def churn_rate(subscriptions: DataFrame, as_of: str) -> DataFrame:
    """Subscriptions cancelled since the start of last month / active before this month; one scan."""
    started = _active() & (F.col("created_at") < month_start(as_of))
    left = (F.col("status") == "cancelled") & (F.col("cancelled_at") >= month_start(as_of, 1))
    sub = F.col("subscription_id")
    return subscriptions.agg(
        ratio(F.count_distinct(F.when(left, sub)), F.count_distinct(F.when(started, sub))).alias(
            "churn_rate"
        )
    )


def acquisition_cost(users: DataFrame, campaigns: DataFrame) -> DataFrame:
    return spend_per_person(
        users, "user_id", "acquisition_source", "created_at", campaigns, "marketing_spend", "cac"
    )


def net_revenue_retention(subscriptions: DataFrame, as_of: str) -> DataFrame:
    """Active revenue created before this month / before last month; one scan."""
    before = lambda back: F.sum(
        F.when(_active() & (F.col("created_at") < month_start(as_of, back)), F.col("mrr"))
    )
    return subscriptions.agg(ratio(before(0), before(1)).alias("nrr"))


def trial_conversion(subscriptions: DataFrame) -> DataFrame:
    sub = F.col("subscription_id")
    return subscriptions.agg(
        ratio(
            F.count_distinct(F.when(_active(), sub)), F.count_distinct(F.when(F.col("trial"), sub))
        ).alias("trial_conversion")
    )


def revenue_per_user(subscriptions: DataFrame) -> DataFrame:
    return (
        subscriptions.where(_active())
        .groupBy(period("month", F.col("created_at")).alias("period"))
        .agg(ratio(F.sum("mrr"), F.count_distinct("user_id")).alias("arpu"))
        .orderBy("period")
    )


def average_lifetime_value(invoices: DataFrame) -> DataFrame:
    per_user = invoices.groupBy("user_id").agg(F.sum("amount").alias("lifetime_value"))
    return per_user.agg(F.avg("lifetime_value").alias("avg_ltv"))
