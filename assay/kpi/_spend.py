"""Spend per distinct person: the shape shared by acquisition-cost KPIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.salting import salted_join
from assay.kpi._time import period, ratio


def spend_per_person(
    people: DataFrame,
    person: str,
    campaign: str,
    created: str,
    campaigns: DataFrame,
    spend: str,
    name: str,
    counted: Column | None = None,
) -> DataFrame:
    """Per month: spend summed over (person row, campaign row) pairs / distinct persons.

    Campaigns shrink to one row each; people to one row per month, campaign and
    person. Campaigns are few and hot, so the join salts by person.
    """
    per_campaign = campaigns.groupBy(F.col("campaign_id").alias("_campaign")).agg(
        F.sum(spend).alias("_spend")
    )
    flag = F.lit(True) if counted is None else counted
    rows = people.groupBy(
        period("month", F.col(created)).alias("period"),
        F.col(campaign).alias("_campaign"),
        F.col(person).alias("_person"),
        F.coalesce(flag, F.lit(False)).alias("_counted"),
    ).agg(F.count("*").alias("_rows"))
    joined = salted_join(rows, per_campaign, ["_campaign"], [F.col("_person")])
    return (
        joined.groupBy("period")
        .agg(
            ratio(
                F.sum(F.col("_rows") * F.col("_spend")),
                F.count_distinct(F.when(F.col("_counted"), F.col("_person"))),
            ).alias(name)
        )
        .orderBy("period")
    )
