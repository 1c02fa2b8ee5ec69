"""The data readiness score: five components of 20 points each, per run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay import rules
from assay.functions import join_by_run


def _steps(value: Column, *limits: tuple[float, float]) -> Column:
    """Points lost: the first limit that ``value`` exceeds counts."""
    out = None
    for limit, points in limits:
        test = value > limit
        out = F.when(test, points) if out is None else out.when(test, points)
    return out.otherwise(0)


def _floored(points: Column) -> Column:
    return F.greatest(points, F.lit(0))


def structure_points(overview: DataFrame) -> DataFrame:
    """From ``structure.dataset_overview``."""
    c = F.col
    lost = (
        _steps(c("duplicate_percent"), (20, 6), (5, 3), (0, 1))
        + _steps(c("constant_columns"), (3, 4), (0, 2))
        + _steps(c("columns_fully_null"), (2, 4), (0, 2))
        + _steps(c("suspicious_id_columns"), (5, 2))
    )
    return overview.select("run_id", _floored(20 - lost).alias("structure_quality"))


def null_points(profile: DataFrame) -> DataFrame:
    stats = profile.where("error IS NULL").groupBy("run_id").agg(
        F.avg("null_percent").alias("mean"),
        F.max("null_percent").alias("worst"),
        F.count_if(F.col("null_percent") > 50).alias("high"),
    )
    lost = (
        _steps(F.col("mean"), (30, 8), (15, 5), (5, 2))
        + _steps(F.col("high"), (5, 6), (2, 3), (0, 1))
        + F.when(F.col("worst") >= 99, 3).otherwise(0)
    )
    return stats.select("run_id", _floored(20 - lost).alias("null_health"))


def type_points(profile: DataFrame, mismatches: DataFrame) -> DataFrame:
    """From type findings; a run without any falls back on two-valued word columns."""
    level = lambda s: F.count_if(F.col("severity") == s)
    found = mismatches.groupBy("run_id").agg(
        F.count("*").alias("findings"),
        level("critical").alias("critical"),
        level("warning").alias("warning"),
    )
    words = F.array(*[F.lit(w) for w in rules.BOOLEAN_WORDS])
    shown = F.transform("top_values", lambda e: F.lower(e["value"]))
    two_valued = (
        (F.col("type_category") == "string")
        & (F.col("unique_count") == 2)
        & F.arrays_overlap(shown, words)
    )
    mixed = profile.where("error IS NULL").groupBy("run_id").agg(
        F.count_if(two_valued).alias("mixed")
    )
    both = join_by_run(mixed, found, how="left")
    by_findings = F.least(F.col("critical") * 3.0, F.lit(10.0)) + F.least(
        F.col("warning") * 1.5, F.lit(6.0)
    )
    lost = F.when(F.coalesce("findings", F.lit(0)) > 0, by_findings).otherwise(
        _steps(F.col("mixed"), (3, 4.0), (0, 2.0))
    )
    # halves go to the even neighbour
    return both.select("run_id", F.bround(_floored(20.0 - lost)).cast("int").alias("type_consistency"))


def compliance_points(runs: DataFrame, gdpr: DataFrame) -> DataFrame:
    """From ``privacy.gdpr_risk``; a run without findings keeps its points."""
    joined = join_by_run(runs, gdpr, how="left")
    c = F.col
    zero = lambda n: F.coalesce(c(n), F.lit(0))
    worst = (
        F.when(c("has_special_category"), 8)
        .when(c("overall_risk") == "critical", 6)
        .when(c("overall_risk") == "high", 4)
        .when(c("overall_risk") == "medium", 2)
        .otherwise(0)
    )
    lost = (
        worst
        + _steps(zero("findings"), (10, 4), (5, 2), (0, 1))
        + _steps(zero("categories"), (4, 3))
    )
    return joined.select("run_id", _floored(20 - lost).alias("compliance_risk"))


def business_points(runs: DataFrame, kpis: DataFrame, classes: DataFrame, edges: DataFrame) -> DataFrame:
    """From recommended KPIs, column classes and relationships, each keyed by run."""
    has = lambda name: F.bool_or(F.col("category") == name).cast("int")
    k = kpis.groupBy("run_id").agg(F.count("*").alias("kpis"))
    c = classes.groupBy("run_id").agg(
        F.count_distinct("category").alias("categories"),
        (has("revenue") * 3 + has("timestamp") * 2 + has("customer_identifier") * 2).alias("gain"),
    )
    e = edges.groupBy("run_id").agg(F.count("*").alias("edges"))
    joined = runs
    for part in (k, c, e):
        joined = join_by_run(joined, part, how="left")
    zero = lambda n: F.coalesce(F.col(n), F.lit(0))
    points = (
        F.lit(5)
        + F.when(zero("kpis") >= 5, 5).when(zero("kpis") >= 2, 3).when(zero("kpis") > 0, 1).otherwise(0)
        + zero("gain")
        + F.when(zero("categories") >= 4, 2).otherwise(0)
        + F.when(zero("edges") > 0, 1).otherwise(0)
    )
    return joined.select("run_id", F.least(points, F.lit(20)).alias("business_value"))


def readiness(
    profile: DataFrame,
    overview: DataFrame,
    mismatches: DataFrame,
    gdpr: DataFrame,
    kpis: DataFrame,
    classes: DataFrame,
    edges: DataFrame,
) -> DataFrame:
    """One row per run: the components, their total and the grade."""
    runs = profile.select("run_id").distinct()
    parts = [
        structure_points(overview),
        null_points(profile),
        type_points(profile, mismatches),
        compliance_points(runs, gdpr),
        business_points(runs, kpis, classes, edges),
    ]

    joined = reduce(join_by_run, parts)
    names = [c for c in joined.columns if c != "run_id"]
    total = reduce(lambda a, b: a + b, [F.col(n) for n in names])
    return joined.select(
        "run_id",
        *[F.col(n).cast("int").alias(n) for n in names],
        total.cast("int").alias("total_score"),
        F.when(total >= 70, "green").when(total >= 40, "yellow").otherwise("red").alias("grade"),
    )
