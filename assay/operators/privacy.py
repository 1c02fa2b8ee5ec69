"""Personal data: name and value findings, table risk, GDPR categories."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay import rules
from assay.functions import join_by_run

KEY = ["run_id", "table_name"]


def _any(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def name_sensitivity(name: Column) -> Column:
    low = F.lower(name)
    out = None
    for tier, words in rules.PII_KEYWORDS.items():
        hit = low.rlike(_any(words))
        out = F.when(hit, tier) if out is None else out.when(hit, tier)
    return out


def first_keyword(name: Column) -> Column:
    """The first listed keyword the name contains, tiers in order."""
    low = F.lower(name)
    words = [w for tier in rules.PII_KEYWORDS.values() for w in tier]
    listed = F.array(*[F.lit(w) for w in words])
    return F.try_element_at(F.filter(listed, lambda w: F.contains(low, w)), F.lit(1))


def pattern_findings(profile: DataFrame) -> DataFrame:
    """(run, table, column, pattern, match_rate) where over half the values match.

    Numbers and dates are matched as text in columns whose name is personal.
    """
    present = F.col("total_count") - F.col("null_count")
    rates = F.array(
        *[
            F.struct(
                F.lit(i).alias("pattern_order"),
                F.lit(p).alias("pattern"),
                F.try_divide(F.col(f"{p}_count"), present).alias("match_rate"),
            )
            for i, p in enumerate(rules.PII_PATTERNS)
        ]
    )
    return (
        profile.where(F.col("type_category").isin("string", "numeric", "datetime"))
        .select(*KEY, "column_name", F.inline(rates))
        .where(F.col("match_rate") > 0.5)
    )


def pii_columns(profile: DataFrame) -> DataFrame:
    """One row per column found by its name, by its values, or both.

    A column found by values alone counts as medium sensitivity, as e-mail and
    phone columns do by name.
    """
    p = F.col
    present = p("total_count") - p("null_count")
    matched = F.filter(
        F.array(
            *[
                F.when(F.try_divide(p(f"{x}_count"), present) > 0.5, F.lit(x))
                for x in rules.PII_PATTERNS
            ]
        ),
        lambda e: e.isNotNull(),
    )
    found = profile.where("error IS NULL").select(
        *KEY,
        "column_name",
        name_sensitivity(p("column_name")).alias("by_name"),
        first_keyword(p("column_name")).alias("keyword"),
        F.try_element_at(matched, F.lit(1)).alias("pattern"),
    )
    return found.where("by_name IS NOT NULL OR pattern IS NOT NULL").select(
        *KEY,
        "column_name",
        F.coalesce(p("by_name"), F.lit("medium")).alias("sensitivity"),
        F.when(p("by_name").isNull(), "value_pattern")
        .when(p("pattern").isNull(), "column_name")
        .otherwise("column_name_and_values")
        .alias("detection_method"),
        F.coalesce(p("pattern"), p("keyword")).alias("pii_type"),
    )


def table_risk(profile: DataFrame, pii: DataFrame) -> DataFrame:
    """Every profiled table with its counts by sensitivity and its risk."""
    level = lambda s: F.count_if(F.col("sensitivity") == s)
    found = pii.groupBy(*KEY).agg(
        F.count("*").alias("pii_column_count"),
        *[level(s).alias(f"{s}_count") for s in rules.PII_KEYWORDS],
    )
    joined = join_by_run(profile.select(*KEY).distinct(), found, ["table_name"], "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(
        *KEY,
        count("pii_column_count").alias("pii_column_count"),
        *[count(f"{s}_count").alias(f"{s}_count") for s in rules.PII_KEYWORDS],
        F.when((count("high_count") > 0) | (count("medium_count") > 3), "high")
        .when(count("medium_count") > 0, "medium")
        .when(count("pii_column_count") > 0, "low")
        .otherwise("none")
        .alias("risk"),
    )


def risk_rank(risk: Column) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in rules.RISK_ORDER]), risk)


def risk_name(rank: Column) -> Column:
    return F.array(*[F.lit(r) for r in rules.RISK_ORDER])[(rank - 1).cast("int")]


def summary(risks: DataFrame) -> DataFrame:
    """Totals per run over ``table_risk``."""
    return risks.groupBy("run_id").agg(
        F.count("*").alias("tables_scanned"),
        F.count_if(F.col("pii_column_count") > 0).alias("tables_with_pii"),
        F.sum("pii_column_count").alias("pii_columns"),
        *[F.sum(f"{s}_count").alias(f"{s}_count") for s in rules.PII_KEYWORDS],
        risk_name(F.max(risk_rank(F.col("risk")))).alias("risk"),
    )


def gdpr_category(pii_type: Column, column: Column) -> Column:
    listed = _lookup(rules.GDPR_TYPES, pii_type)
    known = F.when(listed.isNotNull(), listed)
    text = F.lower(F.concat_ws(" ", pii_type, column))
    for words, category in rules.GDPR_GUESSES:
        known = known.when(text.rlike(_any(words)), category)
    return known.otherwise(rules.GDPR_DEFAULT)


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def gdpr_findings(pii: DataFrame) -> DataFrame:
    typed = pii.withColumn("gdpr_category", gdpr_category(F.col("pii_type"), F.col("column_name")))
    return typed.select(
        *KEY,
        "column_name",
        "pii_type",
        "gdpr_category",
        _lookup(rules.GDPR_LABELS, F.col("gdpr_category")).alias("label"),
        F.coalesce(_lookup(rules.GDPR_RISK, F.col("gdpr_category")), F.lit("medium")).alias("risk"),
    )


def gdpr_risk(findings: DataFrame) -> DataFrame:
    """Per run: the highest risk, counts and the flags for sensitive categories."""
    has = lambda c: F.bool_or(F.col("gdpr_category") == c)
    return findings.groupBy("run_id").agg(
        F.count("*").alias("findings"),
        F.count_distinct("gdpr_category").alias("categories"),
        risk_name(F.max(risk_rank(F.col("risk")))).alias("overall_risk"),
        has("special_category").alias("has_special_category"),
        has("national_id").alias("has_national_id"),
        has("financial_data").alias("has_financial_data"),
    )


def gdpr_categories(findings: DataFrame) -> DataFrame:
    """Per run and category: column and table counts. The columns stay in the findings."""
    return findings.groupBy("run_id", "gdpr_category").agg(
        F.any_value("label").alias("label"),
        F.any_value("risk").alias("risk"),
        F.count("*").alias("column_count"),
        F.count_distinct("table_name").alias("table_count"),
    )


def mask_top_values(profile: DataFrame, pii: DataFrame) -> DataFrame:
    """The profile with the top values of personal columns replaced; run before any sink."""
    marks = pii.select(*KEY, "column_name", F.lit(True).alias("is_personal"))
    joined = join_by_run(profile, marks, [*KEY[1:], "column_name"], "left")
    masked = F.transform(
        "top_values", lambda e: e.withField("value", F.lit("***MASKED***"))
    )
    return joined.withColumn(
        "top_values", F.when(F.col("is_personal"), masked).otherwise(F.col("top_values"))
    ).drop("is_personal")
