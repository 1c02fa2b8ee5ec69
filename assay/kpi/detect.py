"""Industry scores and KPI recommendations for every run of a profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assay.functions import join_by_run
from assay.kpi.catalog import KPIS, SIGNALS, catalog, signals


def _names(profile: DataFrame) -> DataFrame:
    """(run_id, kind, name): distinct lower-case table and column names."""
    tables = profile.select(
        "run_id", F.lit("table").alias("kind"), F.lower("table_name").alias("name")
    )
    columns = profile.select(
        "run_id", F.lit("column").alias("kind"), F.lower("column_name").alias("name")
    )
    return tables.unionAll(columns).distinct()


def industry_scores(profile: DataFrame) -> DataFrame:
    """Per run and industry: signals hit, all signals, and their share, ranked."""
    spark = profile.sparkSession
    listed = signals(spark)
    totals = listed.groupBy("industry").agg(F.count("*").alias("signals"))
    hits = (
        _names(profile)
        .join(F.broadcast(listed), ["kind", "name"])
        .groupBy("run_id", "industry")
        .agg(F.count("*").alias("hits"))
    )
    runs = profile.select("run_id").distinct()
    every = runs.select(
        "run_id",
        F.explode(F.array(*[F.lit(i) for i in SIGNALS])).alias("industry"),
    ).join(F.broadcast(totals), "industry")
    found = F.coalesce("hits", F.lit(0))
    scored = join_by_run(every, hits, ["industry"], "left").select(
        "run_id", "industry", found.alias("hits"), "signals",
        F.round(found / F.col("signals"), 4).alias("score"),
    )
    # at most one row per industry and run
    order = W.partitionBy("run_id").orderBy(F.desc("score"), "industry")
    return scored.withColumn("rank", F.row_number().over(order))


def detect_industry(
    profile: DataFrame, threshold: float = 0.3, specified: str | None = None
) -> DataFrame:
    """One row per run: industry, method, confidence and runner-up."""
    if specified and specified.lower() not in ("auto", "none"):
        return profile.select("run_id").distinct().select(
            "run_id",
            F.lit(specified.lower()).alias("industry"),
            F.lit("specified").alias("method"),
            F.lit(1.0).alias("confidence"),
            F.lit(None).cast("string").alias("runner_up"),
        )
    scores = industry_scores(profile)
    at = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    best = scores.groupBy("run_id").agg(
        at(1, "industry").alias("first"), at(1, "score").alias("score"), at(2, "industry").alias("second")
    )
    found = F.col("score") >= threshold
    return best.select(
        "run_id",
        F.when(found, F.col("first")).otherwise("general").alias("industry"),
        F.lit("auto_detected").alias("method"),
        F.col("score").alias("confidence"),
        F.when(found, F.col("second")).otherwise(F.col("first")).alias("runner_up"),
    )


def kpi_readiness(profile: DataFrame) -> DataFrame:
    """Per run and KPI: what is missing, whether it can run, and how filled its fields are.

    ``field_fill`` is the lowest non-null rate of the required fields, each taken
    from the table that holds it best.
    """
    spark = profile.sparkSession
    kpis = catalog(spark)
    present = (
        profile.groupBy("run_id", F.lower("column_name").alias("name"))
        .agg(F.max(1.0 - F.col("null_percent") / 100.0).alias("fill"))
        .select("run_id", F.lit("column").alias("kind"), "name", "fill")
        .unionByName(
            profile.select(
                "run_id", F.lit("table").alias("kind"), F.lower("table_name").alias("name")
            )
            .distinct()
            .withColumn("fill", F.lit(None).cast("double"))
        )
    )

    def needs(column: str, kinds: list[str], role: str) -> DataFrame:
        one = kpis.select("industry", "priority", F.explode(column).alias("name"))
        return one.select(
            "industry", "priority", "name", F.lit(role).alias("role"),
            F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"),
        )

    wanted = needs("required_tables", ["table"], "table").unionAll(
        needs("required_fields", ["column"], "field")
    ).unionAll(needs("any_of", ["column", "table"], "any"))
    runs = profile.select("run_id").distinct()
    # the names a catalogue of fixed size asks for, per run
    found = present.join(F.broadcast(wanted), ["kind", "name"]).select(
        "run_id", "industry", "priority", "role", "name", "fill"
    )
    seen = found.groupBy("run_id", "industry", "priority").agg(
        _names_of("table").alias("tables"),
        _names_of("field").alias("fields"),
        _names_of("any").alias("any_found"),
        F.min(F.when(F.col("role") == "field", F.col("fill"))).alias("field_fill"),
    )
    # one row per run and KPI of the fixed catalogue
    numbers = F.explode(F.sequence(F.lit(0), F.lit(len(KPIS) - 1)))
    every = (
        runs.withColumn("number", numbers).join(F.broadcast(kpis), "number").drop("number")
    )
    none = F.array().cast("array<string>")
    joined = join_by_run(every, seen, ["industry", "priority"], "left").select(
        *every.columns,
        F.array_sort(F.array_except("required_tables", F.coalesce("tables", none))).alias(
            "missing_tables"
        ),
        F.array_sort(F.array_except("required_fields", F.coalesce("fields", none))).alias(
            "missing_fields"
        ),
        F.size(F.coalesce("any_found", none)).alias("any_hits"),
        "field_fill",
    )
    ready = (
        (F.size("missing_tables") == 0)
        & (F.size("missing_fields") == 0)
        & ((F.size("any_of") == 0) | (F.col("any_hits") > 0))
    )
    return joined.withColumn("is_ready", ready).drop("any_hits")


def _names_of(role: str) -> Column:
    # bounded by the catalogue's own lists
    return F.collect_set(F.when(F.col("role") == role, F.col("name")))


def recommend(
    profile: DataFrame, industry: DataFrame | None = None, limit: int = 7
) -> DataFrame:
    """The KPIs that can run for each run's industry, by priority, at most ``limit`` each."""
    chosen = detect_industry(profile) if industry is None else industry
    ready = kpi_readiness(profile).where("is_ready")
    hits = join_by_run(ready, chosen, ["industry"], "left_semi")
    order = W.partitionBy("run_id").orderBy("priority")
    return (
        hits.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
        .select(
            "run_id", "industry", "rank", "name", "category", "priority", "grain", "formula",
            "query", "required_tables", "required_fields", "dimensions", "blocked_by",
            "field_fill", F.lit(1.0).alias("confidence"),
            F.concat(F.col("formula"), F.lit("; "), F.replace("grain", F.lit("_"), F.lit(" "))).alias("description"),
            F.struct("is_ready", "missing_tables", "missing_fields").alias("readiness"),
        )
    )
