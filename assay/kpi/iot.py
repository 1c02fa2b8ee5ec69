"""Fleet KPIs over telemetry; column names are arguments, see ``semantics.bind_columns``."""

from __future__ import annotations

from inspect import signature

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.kpi._time import ago, ratio
from assay.operators.semantics import bind_columns

# The names a role's column goes by.
ROLE_NAMES = {
    "device": ["device_id", "device"],
    "battery": ["battery", "batterypercentage", "battery_level", "battery_percent"],
    "timestamp": ["timestamp", "last_report_time", "last_seen", "updated_at"],
    "voltage": ["voltage", "battery_voltage", "batteryvoltage"],
}

#: the class of columns that may stand for a role where none of its names occurs
ROLE_CLASSES = {"device": "device_identifier", "timestamp": "timestamp"}


def bindings(profile: DataFrame, classes: DataFrame, table: str) -> dict[str, str]:
    """The arguments of the KPIs here for a table of a profiled run: its column for every role it has one for."""
    found = bind_columns(classes, profile, ROLE_NAMES, ROLE_CLASSES).where(F.col("table_name") == table)
    return {r.role: r.column_name for r in found.collect()}  # at most a row per role


def run_bound(kpi, telemetry: DataFrame, bound: dict[str, str], *args) -> DataFrame:
    """``kpi`` over a table whose columns have other names; a role without a column is an error."""
    roles = [p for p in signature(kpi).parameters if p in ROLE_NAMES]
    if lacking := [r for r in roles if r not in bound]:
        raise ValueError(f"{kpi.__name__} needs columns for {lacking}")
    return kpi(telemetry, *args, **{r: bound[r] for r in roles})


def device_health(
    telemetry: DataFrame, as_of: str, device="device_id", battery="battery", timestamp="timestamp"
) -> DataFrame:
    level = F.col(battery)
    band = F.when(level >= 50, 100).when(level >= 20, 70).when(level >= 10, 40).otherwise(20)
    return telemetry.where(F.col(timestamp) >= ago(as_of, days=7, of_day=True)).agg(
        F.count_distinct(device).alias("total_devices"), F.avg(band).alias("avg_health_score")
    )


def battery_index(telemetry: DataFrame, as_of: str, battery="battery", timestamp="timestamp") -> DataFrame:
    level = F.col(battery)
    return telemetry.where(F.col(timestamp) >= ago(as_of, days=7, of_day=True)).agg(
        F.avg(level).alias("avg_battery_level"),
        F.min(level).alias("min_battery_level"),
        F.count_if(level < 20).alias("low_battery_count"),
        F.count_if(level < 10).alias("critical_battery_count"),
    )


def uptime(telemetry: DataFrame, as_of: str, device="device_id", timestamp="timestamp") -> DataFrame:
    """Distinct devices by recency, from each device's first and last report.

    A device has a report since t if its last one is, and one before t if its
    first one is; so one aggregate per device replaces four distinct counts.
    """
    seen = telemetry.where(F.col(device).isNotNull()).groupBy(device).agg(
        F.min(timestamp).alias("first"), F.max(timestamp).alias("last")
    )
    return seen.agg(
        F.count("*").alias("total_devices"),
        F.count_if(F.col("last") >= ago(as_of, hours=1)).alias("active_last_hour"),
        F.count_if(F.col("last") >= ago(as_of, hours=24)).alias("active_last_day"),
        F.count_if(F.col("first") < ago(as_of, days=7)).alias("offline_devices"),
    )


def report_frequency(telemetry: DataFrame, device="device_id", timestamp="timestamp") -> DataFrame:
    per_device = telemetry.groupBy(F.col(device).alias("device_id")).agg(
        F.count("*").alias("total_reports"),
        F.max(timestamp).alias("last_report"),
        F.min(timestamp).alias("first_report"),
    )
    days = F.floor(F.timestamp_diff("SECOND", F.col("first_report"), F.col("last_report")) / 86400)
    return per_device.where("total_reports > 1").withColumn(
        "avg_reports_per_day", ratio(F.col("total_reports"), days)
    )


def voltage_anomalies(
    telemetry: DataFrame, device="device_id", voltage="voltage", timestamp="timestamp", z: float = 2.0
) -> DataFrame:
    """Readings more than ``z`` deviations off; mean and deviation are scalar subqueries."""
    mean = telemetry.agg(F.avg(voltage)).scalar()
    deviation = telemetry.agg(F.stddev_samp(voltage)).scalar()
    return (
        telemetry.select(device, voltage, timestamp)
        .withColumn("z_score", F.try_divide(F.col(voltage) - mean, deviation))
        .where(F.abs("z_score") > z)
        .orderBy(F.desc(F.abs("z_score")))
    )


def fleet_coverage(telemetry: DataFrame, device="device_id", timestamp="timestamp") -> DataFrame:
    return telemetry.agg(
        F.count_distinct(device).alias("total_devices"),
        F.max(timestamp).alias("last_activity"),
        F.min(timestamp).alias("first_activity"),
    )


def critical_alerts(
    telemetry: DataFrame, as_of: str, device="device_id", battery="battery", voltage="voltage",
    timestamp="timestamp",
) -> DataFrame:
    low_battery, low_voltage = F.col(battery) < 10, F.col(voltage) < 3.5
    recent = F.col(timestamp) >= ago(as_of, hours=24, of_day=True)
    return telemetry.where(recent & (low_battery | low_voltage)).agg(
        F.count_distinct(device).alias("devices_with_alerts"),
        F.count("*").alias("total_critical_readings"),
        F.count_if(low_battery).alias("critical_battery_alerts"),
        F.count_if(low_voltage).alias("critical_voltage_alerts"),
    )
