"""What columns mean and which are worth a look, from profiles; correlations from data."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from functools import reduce
from itertools import combinations, combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay import rules
from assay.functions import literal_rows, numeric_sql, type_category

KEY = ["run_id", "table_name"]


# --- business classes ---------------------------------------------------------


def column_classes(profile: DataFrame) -> DataFrame:
    """The best category of each column with its confidence; weak ones are left out.

    The candidates are scored side by side in one expression per row, so there is
    no join and no shuffle.
    """
    name = F.replace(F.lower("column_name"), F.lit("-"), F.lit("_"))
    tokens = F.split(name, r"[_\s]+")
    category = F.col("type_category")
    boosts = {
        "revenue": ((category == "numeric") & (F.coalesce("min_value", F.lit(0.0)) >= 0), 0.2),
        "timestamp": (F.col("data_type").rlike("date|time"), 0.3),
        "status_lifecycle": ((category == "string") & F.col("unique_count").between(2, 20), 0.2),
        "device_identifier": (F.col("unique_percent") > 80, 0.15),
        "customer_identifier": (F.col("unique_percent") > 80, 0.15),
    }
    scored = []
    for order, (cls, words) in enumerate(rules.COLUMN_CLASSES.items()):
        whole = F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))
        inside = name.rlike("|".join(re.escape(w) for w in words if len(w) >= 3))
        score = F.when(whole, 0.6).when(inside, 0.4).otherwise(0.0)
        if cls in boosts:
            test, gain = boosts[cls]
            score = score + F.when(test, gain).otherwise(0.0)
        scored.append(
            F.struct(
                F.round(score, 2).alias("score"),
                F.lit(-order).alias("order"),
                F.lit(cls).alias("category"),
            )
        )
    best = F.array_max(F.array(*scored))
    confidence = F.least(F.col("best.score"), F.lit(1.0))
    return (
        profile.where("error IS NULL")
        .select(*KEY, "column_name", best.alias("best"))
        .where(F.col("best.score") >= 0.35)
        .select(
            *KEY,
            "column_name",
            F.col("best.category").alias("category"),
            confidence.alias("confidence"),
            F.when(confidence >= 0.7, "high")
            .when(confidence >= 0.5, "medium")
            .otherwise("low")
            .alias("confidence_label"),
        )
    )


def column_class_summary(classes: DataFrame) -> DataFrame:
    """Per run and category: how many columns, in how many tables, how sure."""
    return classes.groupBy("run_id", "category").agg(
        F.count("*").alias("column_count"),
        F.count_distinct("table_name").alias("table_count"),
        F.round(F.avg("confidence"), 4).alias("mean_confidence"),
    )


def bind_columns(
    classes: DataFrame, profile: DataFrame, wanted: Mapping[str, list[str]], of_class: Mapping[str, str] | None = None
) -> DataFrame:
    """For each role the first listed name a table has: (run, table, role, column).

    A role none of whose names occurs falls back on a column of its class, the
    surest first; ``of_class`` names the class of a role, which else has its name.
    """
    class_roles = {role: (of_class or {}).get(role, role) for role in wanted}
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("class")) for r, c in class_roles.items()])
    listed = F.array(
        *[
            F.struct(F.lit(role).alias("role"), F.lit(i).alias("pref"), F.lit(n).alias("name"))
            for role, names in wanted.items()
            for i, n in enumerate(names)
        ]
    )
    hit = F.filter(listed, lambda e: e["name"] == F.lower("column_name"))
    by_name = profile.select(*KEY, "column_name", F.inline(hit)).select(
        *KEY, "role", "column_name", F.col("pref").cast("double").alias("cost")
    )
    fits = F.filter(roles, lambda e: e["class"] == F.col("category"))
    by_class = classes.select(*KEY, "column_name", "confidence", F.inline(fits)).select(
        *KEY, "role", "column_name", (F.lit(1000.0) - F.col("confidence")).alias("cost")
    )
    return (
        by_name.unionByName(by_class)
        .groupBy(*KEY, "role")
        .agg(F.min(F.struct("cost", "column_name")).alias("best"))
        .select(*KEY, "role", F.col("best.column_name").alias("column_name"))
    )


# --- interesting columns ------------------------------------------------------


def _reasons(rows: DataFrame, reason: Column, value: Column, weight: Column) -> DataFrame:
    return rows.select(
        *KEY, "column_name", reason.alias("reason"), value.cast("double").alias("value"),
        weight.alias("weight"),
    ).where("weight IS NOT NULL")


def high_variance(profile: DataFrame) -> DataFrame:
    cv = F.abs(F.try_divide(F.col("std"), F.col("mean")))
    return _reasons(
        profile, F.lit("high_variance"), cv, F.when(cv > 2.0, 0.35).when(cv > 1.0, 0.2)
    )


def rare_values(profile: DataFrame) -> DataFrame:
    """Columns whose rarest kept value is below 5 % (or 1 %) of the kept values."""
    counts = F.transform("top_values", lambda e: e["count"])
    total = F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)
    least = F.try_divide(F.array_min(counts) * 100.0, total)
    rare = F.size(F.filter(counts, lambda x: F.try_divide(x * 100.0, total) < 1.0))
    rows = profile.where(F.size("top_values") >= 3)
    return _reasons(
        rows, F.lit("rare_events"), F.when(least < 1.0, rare.cast("double")).otherwise(least),
        F.when(least < 1.0, 0.25).when(least < 5.0, 0.15),
    )


def bimodal(profile: DataFrame) -> DataFrame:
    rows = profile.where((F.col("total_count") - F.col("null_count")) >= 30)
    k = F.col("kurtosis")
    return _reasons(rows, F.lit("bimodal_hint"), k, F.when(k < -1.0, 0.3))


def skewed(profile: DataFrame) -> DataFrame:
    s = F.col("skewness")
    side = F.when(s > 0, "right").otherwise("left")
    degree = F.when(F.abs(s) > 3.0, "high_skew_").otherwise("moderate_skew_")
    return _reasons(
        profile, F.concat(degree, side), s,
        F.when(F.abs(s) > 3.0, 0.25).when(F.abs(s) > 1.5, 0.15),
    )


def interesting_reasons(profile: DataFrame) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [high_variance(profile), rare_values(profile), bimodal(profile), skewed(profile)],
    )


def interesting_columns(profile: DataFrame) -> DataFrame:
    """One row per column with a reason: at most four reasons, weights summed to at most 1."""
    return (
        interesting_reasons(profile)
        .groupBy(*KEY, "column_name")
        .agg(
            F.array_join(F.array_sort(F.collect_list("reason")), ",").alias("reasons"),
            F.round(F.least(F.sum("weight"), F.lit(1.0)), 2).alias("interest_score"),
        )
        .orderBy(F.desc("interest_score"), "table_name", "column_name")
    )


# --- correlations -------------------------------------------------------------

#: columns whose products one scan makes: up to five square matrices of this width lie in a task
BLOCK = 1024
_MOMENTS = ("n", "mean_a", "mean_b", "m2_a", "m2_b", "c", "odd")
_MOMENT_ROWS = "i int, " + ", ".join(f"{name} array<double>" for name in _MOMENTS)


def _moments(x: np.ndarray, y: np.ndarray, shift_x: np.ndarray, shift_y: np.ndarray) -> list[np.ndarray]:
    """Sums over the rows where both are known, for each column of ``x`` with each of ``y``; nulls are NaN."""
    known_x, known_y = ~np.isnan(x), ~np.isnan(y)
    finite_x, finite_y = np.isfinite(x), np.isfinite(y)
    a, b = np.where(finite_x, x - shift_x, 0.0), np.where(finite_y, y - shift_y, 0.0)
    mx, my = known_x.astype(float), known_y.astype(float)
    odd = (known_x & ~finite_x).astype(float).T @ my + mx.T @ (known_y & ~finite_y).astype(float)
    return [mx.T @ my, a.T @ my, mx.T @ b, (a * a).T @ my, mx.T @ (b * b), a.T @ b, odd]


def _centred(sums: list[np.ndarray], shift_x: np.ndarray, shift_y: np.ndarray) -> list[np.ndarray]:
    """Counts, means and central moments from sums of shifted values."""
    n, sa, sb, saa, sbb, sab, odd = sums
    count = np.maximum(n, 1)
    m2_a, m2_b = saa - sa * sa / count, sbb - sb * sb / count
    # what rounding leaves of values that are all equal is nothing
    m2_a, m2_b = np.where(m2_a > 1e-13 * saa, m2_a, 0.0), np.where(m2_b > 1e-13 * sbb, m2_b, 0.0)
    return [n, shift_x[:, None] + sa / count, shift_y[None, :] + sb / count, m2_a, m2_b, sab - sa * sb / count, odd]


def _together(p: list[np.ndarray], q: list[np.ndarray]) -> list[np.ndarray]:
    """Moments of two disjoint sets of rows put together."""
    n = p[0] + q[0]
    share = q[0] / np.maximum(n, 1)
    da, db = np.where(p[0] * q[0] > 0, q[1] - p[1], 0.0), np.where(p[0] * q[0] > 0, q[2] - p[2], 0.0)
    mean = [np.where(p[0] > 0, u + d * share, v) for u, v, d in ((p[1], q[1], da), (p[2], q[2], db))]
    w = p[0] * share
    return [n, *mean, p[3] + q[3] + da * da * w, p[4] + q[4] + db * db * w, p[5] + q[5] + da * db * w, p[6] + q[6]]


def _block_moments(df: DataFrame, rows: list[str], columns: list[str]) -> DataFrame:
    """One row per column of ``rows``, with an array over ``columns`` for each moment; a partial per task is shuffled."""
    same = rows == columns
    width = len(rows)

    def shifts(x: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The first value of every column, so that constant columns are exactly 0."""
        at = np.argmax(np.isfinite(x), axis=0)
        first = x[at, np.arange(x.shape[1])]
        return np.where(np.isnan(before) & np.isfinite(first), first, before)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            data = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            shift = shifts(data, np.full(data.shape[1], np.nan))
            shift = np.nan_to_num(shift)
            x, y = data[:, :width], data if same else data[:, width:]
            sx, sy = shift[:width], shift if same else shift[width:]
            part = _centred(_moments(x, y, sx, sy), sx, sy)
            total = part if total is None else _together(total, part)
        if total is not None:
            columns_ = [pa.array(range(width), pa.int32())] + [pa.array(list(m), pa.list_(pa.float64())) for m in total]
            yield pa.RecordBatch.from_arrays(columns_, names=["i", *_MOMENTS])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                part = [np.array(row[m]) for m in _MOMENTS]
                totals[row["i"]] = _together(totals[row["i"]], part) if row["i"] in totals else part
        if totals:
            columns_ = [pa.array(totals, pa.int32())] + [pa.array([t[k] for t in totals.values()], pa.list_(pa.float64())) for k in range(len(_MOMENTS))]
            yield pa.RecordBatch.from_arrays(columns_, names=["i", *_MOMENTS])

    values = df.selectExpr(*rows, *([] if same else columns))
    return values.mapInArrow(counted, _MOMENT_ROWS).repartition("i").mapInArrow(added, _MOMENT_ROWS)


def correlation_pairs(df: DataFrame) -> DataFrame:
    """(col_a, col_b, r) for all pairs of numeric columns, nulls left out pair by pair.

    One scan makes the moments of all pairs of up to ``BLOCK`` columns as products of matrices of values, squares and known
    values, batch by batch; each task sends one row per column. Wider tables take a scan per pair of blocks. ``r`` is null
    where a column has one value only, or no value beside the other's, and NaN where values are infinite.
    """
    cols = [f for f in df.schema.fields if type_category(f.dataType) == "numeric"]
    spark = df.sparkSession
    pairs = literal_rows(
        spark, "i int, j int, col_a string, col_b string",
        [(i, j, a.name, b.name) for (i, a), (j, b) in combinations(enumerate(cols), 2)],
    )
    named = [f"{numeric_sql(f.name, f.dataType)} AS c{i}" for i, f in enumerate(cols)]
    blocks = [named[k : k + BLOCK] for k in range(0, len(named), BLOCK)]
    parts = []
    for (p, rows), (q, columns) in combinations_with_replacement(enumerate(blocks), 2):
        moments = _block_moments(df, rows, columns)
        entry = F.posexplode(F.arrays_zip(*_MOMENTS))
        parts.append(
            moments.select("i", entry.alias("j", "m")).where(f"i + {p * BLOCK} < j + {q * BLOCK}").select(
                (F.col("i") + p * BLOCK).alias("i"), (F.col("j") + q * BLOCK).alias("j"),
                F.expr("CASE WHEN m.odd > 0 THEN double('nan') ELSE try_divide(m.c, sqrt(m.m2_a) * sqrt(m.m2_b)) END AS r"),
            )
        )
    if not parts:
        return pairs.selectExpr("col_a", "col_b", "CAST(NULL AS DOUBLE) AS r")
    # one row per pair on either side
    return pairs.join(reduce(DataFrame.unionAll, parts), ["i", "j"], "left").select("col_a", "col_b", "r")


def correlations(
    df: DataFrame, table: str, classes: DataFrame | None = None, limit: int | None = None
) -> DataFrame:
    """The pairs with |r| >= 0.6, strongest first, or the first ``limit`` of them."""
    size = F.abs("r")
    notable = (
        correlation_pairs(df)
        .where(F.col("r").isNotNull() & ~F.isnan("r") & (size >= 0.6))
        .select(
            F.lit(table).alias("table_name"), "col_a", "col_b",
            F.round("r", 3).alias("pearson_r"),
            F.when(size > 0.8, "very_strong").otherwise("strong").alias("strength"),
        )
        .orderBy(F.desc(F.abs("pearson_r")), "col_a", "col_b")
    )
    if limit is not None:
        notable = notable.limit(limit)
    if classes is None:
        return notable
    revenue = classes.where("category = 'revenue'").where(F.col("table_name") == table)
    names = revenue.select(F.col("column_name").alias("revenue_column")).distinct()
    sides = notable.withColumn("side", F.explode(F.array("col_a", "col_b")))
    hits = sides.join(names, F.col("side") == F.col("revenue_column"), "left")
    return hits.groupBy(*notable.columns).agg(
        (F.count("revenue_column") > 0).alias("involves_revenue")
    )
