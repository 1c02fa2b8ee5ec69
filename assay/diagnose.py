"""All diagnostics of a set of tables in one call, stored as a run."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay import rules
from assay.functions import join_by_run
from assay.kpi import detect
from assay.operators import (
    duplicates, hidden, missing, privacy, profile, quality, readiness, relate, report, semantics, structure,
)
from assay.sinks import runs
from assay.sources import inventory, sampling

#: artifacts that are written at the same time
AT_ONCE = 8


def findings(
    prof: DataFrame, dups: DataFrame, as_of: str, industry: str | None = None, max_tables: int | None = None
) -> dict[str, DataFrame]:
    """Every catalogue result over stored profiles of one or many runs.

    ``prof`` and ``dups`` are read many times: pass tables, not plans. No data
    table is scanned here.
    """
    # what several artifacts rest on is made once
    rows = runs.materialize(quality.component_rows(prof, dups, as_of), "component-rows")
    pii = runs.materialize(privacy.pii_columns(prof), "pii")
    gdpr = privacy.gdpr_findings(pii)
    risks = privacy.table_risk(prof, pii)
    classes = runs.materialize(semantics.column_classes(prof), "classes")
    edges = runs.materialize(relate.relationships(prof, max_tables), "relationships")
    screen = hidden.hidden_types(privacy.mask_top_values(prof, pii))
    verdicts = runs.materialize(hidden.verdicts(screen), "type-findings")
    chosen = runs.materialize(detect.detect_industry(prof, specified=industry), "industry")
    kpis = runs.materialize(detect.recommend(prof, chosen), "kpi-candidates")
    overview = runs.materialize(structure.dataset_overview(prof, dups), "overview")
    strategy = runs.materialize(missing.missing_strategy(prof, classes), "missing-strategy")
    checks = quality.checks(rows)
    scores = runs.materialize(quality.scores(rows), "quality-scores")
    facts = runs.materialize(report.table_facts(prof, scores, pii), "table-facts")
    summary = report.dataset_summary(facts, edges, kpis)
    return {
        "quality_checks": checks,
        "quality_scores": scores,
        "quality_overall": quality.overall(rows),
        "quality_flags": quality.flags(prof, rows, verdicts),
        "tables": structure.table_overview(prof, dups),
        "overview": overview,
        "pii": pii,
        "pii_risk": risks,
        "pii_summary": privacy.summary(risks),
        "gdpr": gdpr,
        "gdpr_risk": privacy.gdpr_risk(gdpr),
        "gdpr_categories": privacy.gdpr_categories(gdpr),
        "candidate_keys": relate.candidate_keys(prof),
        "relationships": edges,
        "join_classes": relate.join_classes(prof, max_tables),
        "join_paths": relate.join_paths(edges),
        "path_hubs": relate.path_hubs(edges),
        "industry": chosen,
        "kpi_candidates": kpis,
        "column_classes": classes,
        "class_summary": semantics.column_class_summary(classes),
        "interesting_columns": semantics.interesting_columns(prof),
        "missing_strategy": strategy,
        "missing_summary": missing.missing_summary(strategy),
        "table_facts": facts,
        "dataset_summary": summary,
        "impact": report.impact_findings(measures(checks)),
        "hidden_types": screen,
        "type_findings": verdicts,
        "readiness": readiness.readiness(
            prof, overview, verdicts, privacy.gdpr_risk(gdpr), kpis, classes, edges
        ),
    }


def measures(checks: DataFrame) -> DataFrame:
    """The check rows that the impact rules look at, under the rules' names."""
    renamed = F.when(F.col("metric") == "days_since_update", "freshness_days").otherwise(F.col("metric"))
    known = [metric for metric, *_ in rules.IMPACT_RULES]
    rows = checks.select("run_id", "table_name", "column_name", renamed.alias("metric"), F.col("value").cast("double").alias("value"))
    return rows.where(F.col("metric").isin(known))


def report_rows(found: Mapping[str, DataFrame], label: str) -> DataFrame:
    """One flat row per run, as ``runs.compare`` lists them."""
    kpis = found["kpi_candidates"].groupBy("run_id").agg(F.count("*").alias("kpis"))
    report = found["overview"].withColumn("label", F.lit(label))
    for part in (
        found["quality_overall"].drop("table_count"),
        found["pii_summary"].select("run_id", "pii_columns", F.col("risk").alias("pii_risk")),
        found["readiness"].select("run_id", "total_score", "grade"),
        found["industry"].select("run_id", "industry"),
        kpis,
    ):
        report = report.join(part, "run_id", "left")
    return report.withColumn("kpis", F.coalesce("kpis", F.lit(0).cast("bigint")))


def stored_profile(tables: Mapping[str, DataFrame], run_id: str, as_of: str) -> DataFrame:
    """The profile of a run. Top values of personal columns are masked before anything is written.

    Which columns are personal follows from names and counts; value counts of such texts are not stored
    on the way either.
    """
    whole = profile.profile_tables(tables, run_id=run_id, as_of=as_of)
    return runs.materialize(privacy.mask_top_values(whole, privacy.pii_columns(whole)))


def correlated(tables: Mapping[str, DataFrame], classes: DataFrame) -> DataFrame:
    """The notable correlations of every table, one scan each."""
    return reduce(DataFrame.unionAll, [semantics.correlations(df, name, classes) for name, df in tables.items()])


def diagnose(
    tables: Mapping[str, DataFrame],
    root: str,
    run_id: str,
    as_of: str,
    *,
    label: str = "",
    industry: str | None = None,
) -> dict[str, DataFrame]:
    """Profile, judge and store: the artifacts of one run below ``root``.

    The tables are scanned for the profile, the duplicate counts and the
    correlations; everything else reads those results. Artifacts are small and
    are written ``AT_ONCE`` at a time. Top values of personal columns are masked
    before the profile is stored.
    """
    prof = stored_profile(tables, run_id, as_of)
    dups = runs.materialize(duplicates.duplicates(tables, run_id), "duplicates")
    found = findings(prof, dups, as_of, industry)
    counts = prof.groupBy("table_name").agg(F.coalesce(F.max("total_count"), F.lit(0)).alias("row_count"))
    assets = inventory.table_inventory(prof.sparkSession, tables, label or "default")
    artifacts = {
        "schema": prof.select("table_name", "column_name", "ordinal", "data_type", "null_count"),
        "profile": prof,
        "assets_inventory": assets,
        "sampling_manifest": sampling.sampling_plan(counts),
        "report_data": report_rows(found, label),
        "correlations": correlated(tables, found["column_classes"]),
        **found,
    }
    with ThreadPoolExecutor(AT_ONCE) as pool:
        list(pool.map(lambda item: runs.save(item[1], root, item[0], run_id), artifacts.items()))
    return {
        name: runs.load(prof.sparkSession, root, name, df.drop("run_id").schema, run_id)
        for name, df in artifacts.items()
    }
