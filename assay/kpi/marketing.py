"""Marketing and lead KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.kpi._spend import spend_per_person
from assay.kpi._time import period, ratio


def cost_per_lead(leads: DataFrame, campaigns: DataFrame) -> DataFrame:
    return spend_per_person(
        leads, "lead_id", "campaign_id", "created_at", campaigns, "spend", "cpl"
    )


def lead_conversion(leads: DataFrame) -> DataFrame:
    won = F.when(F.col("status") == "converted", F.col("lead_id"))
    return leads.agg(
        ratio(F.count_distinct(won), F.count_distinct("lead_id")).alias("conversion_rate")
    )


def return_on_spend(campaigns: DataFrame, conversions: DataFrame) -> DataFrame:
    """Revenue / spend over (campaign row, conversion row) pairs, from per-side totals."""
    spent = campaigns.groupBy("campaign_id", F.col("name").alias("campaign_name")).agg(
        F.count("*").alias("campaign_rows"), F.sum("spend").alias("spend")
    )
    earned = conversions.groupBy("campaign_id").agg(
        F.count("*").alias("conversion_rows"), F.sum("revenue").alias("revenue")
    )
    return (
        spent.join(earned, "campaign_id")
        .select(
            "campaign_id",
            "campaign_name",
            ratio(
                F.col("revenue") * F.col("campaign_rows"), F.col("spend") * F.col("conversion_rows")
            ).alias("roas"),
        )
        .orderBy(F.desc("roas"))
    )


def click_through(campaigns: DataFrame) -> DataFrame:
    return campaigns.groupBy("campaign_id").agg(
        ratio(F.sum("clicks"), F.sum("impressions")).alias("ctr")
    )


def qualified_rate(leads: DataFrame) -> DataFrame:
    good = F.when(F.col("is_qualified"), F.col("lead_id"))
    return (
        leads.groupBy(period("month", F.col("created_at")).alias("period"))
        .agg(ratio(F.count_distinct(good), F.count_distinct("lead_id")).alias("mql_rate"))
        .orderBy("period")
    )


def acquisition_cost(leads: DataFrame, campaigns: DataFrame) -> DataFrame:
    return spend_per_person(
        leads, "lead_id", "campaign_id", "created_at", campaigns, "spend", "cac",
        counted=F.col("status") == "converted",
    )


def email_engagement(events: DataFrame) -> DataFrame:
    opened = F.when(F.col("opened"), 1).otherwise(0)
    return (
        events.where(F.col("event_type") == "email_sent")
        .groupBy("campaign_id")
        .agg(ratio(F.sum(opened), F.count("*")).alias("open_rate"))
    )
