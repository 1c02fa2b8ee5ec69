"""Profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.operators import profile as P
from assay.sinks.runs import materialize
from checks.lake import AS_OF, SHOP, lake, over_profile, rounded, shaped

QUERIES, ORACLE = {}, {}


def prof(spark, sf, names=SHOP, parts=(P.STATS,), **options):
    return P.profile_tables(lake(spark, sf, names), as_of=AS_OF, parts=parts, **options)


def stored(spark, sf, names=SHOP, parts=(P.STATS,), **options):
    """The profile written once, for rules that read it more than once."""
    return materialize(prof(spark, sf, names, parts, **options))


def _profile_query(key, parts, columns, category=None, doubles=(), digits=6):
    shown = ["table_name", "column_name", *columns]

    def run(spark, sf):
        df = prof(spark, sf, parts=parts)
        if category:
            df = df.where(F.col("type_category") == category)
        return shaped(df.select(*shown), digits)

    where = f"WHERE type_category = '{category}'" if category else ""
    sql = over_profile(f"SELECT {', '.join(shown)} FROM p {where}")
    QUERIES[key] = run
    ORACLE[key] = rounded(sql, doubles, digits) if doubles else sql


_profile_query(
    "profile_counts", (P.STATS, P.DISTINCT),
    ["total_count", "null_count", "null_percent", "unique_count", "unique_percent"],
    doubles=["null_percent", "unique_percent"],
)
_profile_query("profile_types", (P.STATS,), ["data_type", "type_category"])
_profile_query(
    "profile_numeric", (P.STATS, P.QUANTILES),
    ["min_value", "max_value", "mean", "std", "q25", "median", "q75", "skewness", "kurtosis", "negative_count"],
    "numeric",
    ["min_value", "max_value", "mean", "std", "q25", "median", "q75", "skewness", "kurtosis"], 4,
)
_profile_query(
    "profile_boolean", (P.STATS,), ["true_count", "false_count", "true_percent"], "boolean",
    ["true_percent"],
)
_profile_query(
    "profile_string", (P.STATS, P.PATTERNS),
    ["min_length", "max_length", "avg_length", "empty_count", "has_email", "has_phone", "has_url"],
    "string", ["avg_length"],
)
_profile_query(
    "profile_datetime", (P.STATS,), ["min_ts", "max_ts", "range_days", "future_count"], "datetime"
)


def _quantiles_at_scale(spark, sf):
    """Quantiles together with all that reads the stored value counts."""
    df = prof(spark, sf, parts=(P.STATS, P.DISTINCT, P.TOP, P.OUTLIERS))
    df = df.where("type_category = 'numeric'").select("table_name", "column_name", "q25", "median", "q75")
    return shaped(df)


QUERIES["quantiles_bracketed"] = _quantiles_at_scale
ORACLE["quantiles_bracketed"] = rounded(
    over_profile("SELECT table_name, column_name, q25, median, q75 FROM p WHERE type_category = 'numeric'"),
    ["q25", "median", "q75"],
)


def _iqr(spark, sf):
    df = prof(spark, sf, parts=(P.OUTLIERS,)).where("type_category = 'numeric'")
    return shaped(
        df.select("table_name", "column_name", "iqr_lower", "iqr_upper", "iqr_outliers", "iqr_outlier_percent")
    )


def _per_numeric(body: str) -> str:
    """A UNION of ``body`` over the numeric columns, with the row of bounds as ``b``."""
    from checks.lake import VIEWS

    return "\nUNION ALL\n".join(
        body.format(t=n, c=c) for n in SHOP for c, _, k in VIEWS[n][1] if k == "numeric"
    )


QUERIES["outliers_iqr"] = _iqr
ORACLE["outliers_iqr"] = rounded(
    over_profile(
        "WITH b AS (SELECT table_name, column_name, q25 - 3 * (q75 - q25) AS lo, q75 + 3 * (q75 - q25) AS hi "
        "FROM p WHERE type_category = 'numeric')\n"
        + _per_numeric(
            """SELECT '{t}' AS table_name, '{c}' AS column_name, any_value(lo) AS iqr_lower, any_value(hi) AS iqr_upper,
                  count(*) FILTER ({c} < lo OR {c} > hi) AS iqr_outliers,
                  count(*) FILTER ({c} < lo OR {c} > hi) * 100.0 / count({c}) AS iqr_outlier_percent
               FROM v_{t}, b WHERE table_name = '{t}' AND column_name = '{c}'"""
        )
    ),
    ["iqr_lower", "iqr_upper", "iqr_outlier_percent"],
)


def _zscore(spark, sf):
    df = prof(spark, sf, parts=(P.OUTLIERS,), z_k=1.7).where("type_category = 'numeric'")
    return shaped(df.select("table_name", "column_name", "zscore_outliers", "zscore_outlier_percent"))


QUERIES["outliers_zscore"] = _zscore
ORACLE["outliers_zscore"] = rounded(
    over_profile(
        _per_numeric(
            """SELECT '{t}' AS table_name, '{c}' AS column_name,
                  count(*) FILTER (abs({c} - mean) / std > 1.7) AS zscore_outliers,
                  count(*) FILTER (abs({c} - mean) / std > 1.7) * 100.0 / count({c}) AS zscore_outlier_percent
               FROM v_{t}, p WHERE table_name = '{t}' AND column_name = '{c}'"""
        )
    ),
    ["zscore_outlier_percent"],
)


def _top(spark, sf):
    return shaped(P.exploded_top_values(prof(spark, sf, parts=(P.TOP,))).drop("run_id"))


QUERIES["top_values"] = _top
ORACLE["top_values"] = rounded(over_profile("SELECT * FROM tops", tops=True), ["percent"])

QUERIES["completeness"] = lambda spark, sf: shaped(P.completeness(prof(spark, sf)).drop("run_id"))
ORACLE["completeness"] = over_profile(
    "SELECT table_name, round(100 - avg(null_percent), 2) AS completeness_score, count(*) AS column_count "
    "FROM p GROUP BY table_name"
)
QUERIES["type_summary"] = lambda spark, sf: shaped(P.type_summary(prof(spark, sf)).drop("run_id"))
ORACLE["type_summary"] = over_profile(
    "SELECT table_name, type_category, count(*) AS column_count FROM p GROUP BY ALL"
)


def _text_profile(spark, sf):
    """Long texts, pages and nested values: the digest path of the distinct counts."""
    from checks.lake import raw

    tables = {n: raw(spark, sf, n) for n in ("documents", "pages", "conversations", "embeddings")}
    df = P.profile_tables(tables, parts=(P.STATS, P.DISTINCT, P.TOP))
    most = F.try_element_at("top_values", F.lit(1))
    return shaped(
        df.select(
            "table_name", "column_name", "total_count", "null_count", "unique_count", "min_length",
            "max_length", "avg_length", "avg_size", most["count"].alias("mode_count"),
            F.when(most["count"] > 1, F.length(most["value"])).alias("repeated_mode_length"),
        ).where("column_name <> 'embedding' OR avg_size IS NOT NULL")
    )


def _text_sql() -> str:
    cols = {
        "documents": "doc_id text:s lang:s source:s n_chars",
        "pages": "page_id url:s html:s",
        "conversations": "conv_id turn role:s text:s",
        "embeddings": "vec_id embedding:a label",
    }
    out = []
    for t, names in cols.items():
        for c in names.split():
            c, _, k = c.partition(":")
            text = f"min(length({c})), max(length({c})), avg(length({c}))" if k == "s" else "NULL, NULL, NULL"
            size = f"avg(len({c}))" if k == "a" else "NULL"
            out.append(
                f"SELECT '{t}', '{c}', count(*), count(*) - count({c}), count(DISTINCT {c}), {text}, {size}, "
                f"(SELECT max(k) FROM (SELECT count(*) AS k FROM {t} GROUP BY {c})), "
                f"(SELECT CASE WHEN k > 1 THEN n END FROM (SELECT count(*) AS k, length(CAST({c} AS VARCHAR)) AS n, {c} AS v, sha256(CAST({c} AS VARCHAR)) AS h "
                f"FROM {t} GROUP BY {c}) ORDER BY k DESC, {_tie(c, k)} LIMIT 1) FROM {t}"
            )
    names = (
        "table_name, column_name, total_count, null_count, unique_count, min_length, max_length, "
        "avg_length, avg_size, mode_count, repeated_mode_length"
    )
    return rounded(
        f"SELECT * FROM ({' UNION ALL '.join(out)}) AS t({names})", ["avg_length", "avg_size"]
    )


def _tie(c: str, k: str) -> str:
    # long texts tie by digest, others by value
    return "CASE WHEN n > 256 THEN 'sha256:' || h ELSE v END" if k == "s" else "v"


QUERIES["profile_texts"] = _text_profile
ORACLE["profile_texts"] = _text_sql()


def column_profile_query(spark, sf):
    """The whole profile of the shop, with every part."""
    df = prof(spark, sf, parts=P.ALL_PARTS)
    best = F.try_element_at("top_values", F.lit(1))
    return shaped(
        df.select(
            "table_name", "column_name", "ordinal", "data_type", "type_category", "total_count",
            "null_count", "unique_count", "min_value", "max_value", "mean", "std", "q25", "median",
            "q75", "true_count", "min_length", "max_length", "min_ts", "max_ts",
            best["value"].alias("top_value"), best["count"].alias("top_count"),
        ),
        4,
    )


QUERIES["column_profile"] = column_profile_query
ORACLE["column_profile"] = rounded(
    over_profile(
        """SELECT p.table_name, p.column_name, ordinal, data_type, p.type_category, total_count, null_count,
                  unique_count, min_value, max_value, mean, std, q25, median, q75, true_count, min_length,
                  max_length, min_ts, max_ts, value AS top_value, count AS top_count
           FROM p LEFT JOIN tops ON p.table_name = tops.table_name AND p.column_name = tops.column_name AND rank = 1""",
        tops=True,
    ),
    ["min_value", "max_value", "mean", "std", "q25", "median", "q75"], 4,
)
