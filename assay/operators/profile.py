"""``column_profile``: one row per table and column, over all rows.

All columns of all tables share one integer key, ``cid``, so a set of tables is
profiled by a fixed number of aggregates however many tables and columns it has:

* statistics: one long scan and one partial/final aggregate; only one row per
  column and task is shuffled;
* frequencies: one shuffle of (cid, distinct value, count),
  pre-counted per task and stored, values by class. Exact distinct counts, top
  values, quantiles and outliers all read that table.

Every later rule works on the result, which can be unioned over runs.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay import rules
from assay.functions import literal_rows, long_form, numeric_sql, quoted, text, type_category
from assay.operators.quantiles import quantiles
from assay.sinks.runs import materialize

STATS, DISTINCT, TOP, QUANTILES, OUTLIERS, PATTERNS = (
    "stats", "distinct", "top", "quantiles", "outliers", "patterns",
)
ALL_PARTS = (STATS, DISTINCT, TOP, QUANTILES, OUTLIERS, PATTERNS)

#: strings longer than this are counted by their SHA-256 digest, so the shuffle
#: carries 64 characters instead of whole documents
DIGEST_ABOVE = 256

#: the profile's columns and types
PROFILE_COLUMNS = {
    **dict.fromkeys(["run_id", "table_name", "column_name"], "string"),
    "ordinal": "int",
    **dict.fromkeys(["data_type", "type_category"], "string"),
    "total_count": "bigint",
    "null_count": "bigint",
    "null_percent": "double",
    "unique_count": "bigint",
    "unique_percent": "double",
    # numeric
    **dict.fromkeys(
        ["min_value", "max_value", "mean", "std", "q25", "median", "q75", "skewness", "kurtosis"],
        "double",
    ),
    "negative_count": "bigint",
    "iqr_lower": "double",
    "iqr_upper": "double",
    "iqr_outliers": "bigint",
    "iqr_outlier_percent": "double",
    "zscore_outliers": "bigint",
    "zscore_outlier_percent": "double",
    # boolean
    "true_count": "bigint",
    "false_count": "bigint",
    "true_percent": "double",
    # string
    "min_length": "bigint",
    "max_length": "bigint",
    "avg_length": "double",
    "empty_count": "bigint",
    **dict.fromkeys(["has_email", "has_phone", "has_url"], "boolean"),
    **{f"{name}_count": "bigint" for name in rules.PII_PATTERNS},
    **dict.fromkeys(
        [
            "nonblank_count", "object_count", "array_count", "number_count", "date_count",
            "boolean_count", "markup_count",
        ],
        "bigint",
    ),
    # datetime, and strings in columns named like dates
    "min_ts": "timestamp_ntz",
    "max_ts": "timestamp_ntz",
    "range_days": "bigint",
    "future_count": "bigint",
    # nested and binary
    "avg_size": "double",
    "top_values": "array<struct<value:string,count:bigint,percent:double>>",
    "error": "string",
}

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType)

#: rows of per-column results that may be broadcast; wider lakes use plain joins
BROADCAST_COLUMNS = 100_000


class Lake:
    """The tables with a number for each of their columns."""

    def __init__(self, tables: Mapping[str, DataFrame]):
        self.spark = next(iter(tables.values())).sparkSession
        self.tables = []
        self.rows = []
        for name, df in tables.items():
            columns = []
            for ordinal, f in enumerate(df.schema.fields):
                category = type_category(f.dataType)
                cid = len(self.rows)
                self.rows.append(
                    (cid, name, f.name, ordinal, f.dataType.simpleString(), category)
                )
                columns.append((cid, f, category))
            self.tables.append((df, columns))
        self.categories = {r[5] for r in self.rows}

    def schema(self) -> DataFrame:
        ddl = (
            "cid int, table_name string, column_name string, ordinal int, data_type string, "
            "type_category string"
        )
        return literal_rows(self.spark, ddl, self.rows)

    def long(self, names, values, keep=None, cids=None) -> DataFrame | None:
        """(cid, *names) of the columns that ``keep``(field, category) lets through, or of those among ``cids``.

        ``values`` (field, category) gives one SQL expression per name.
        """
        wanted = lambda cid, f, c: (keep is None or keep(f, c)) and (cids is None or cid in cids)
        return long_form(
            [(df, [(cid, values(f, c)) for cid, f, c in columns if wanted(cid, f, c)]) for df, columns in self.tables],
            names,
        )

    def small(self, df: DataFrame) -> DataFrame:
        """Mark a result of at most one row (or a fixed few) per column."""
        return F.broadcast(df) if len(self.rows) <= BROADCAST_COLUMNS else df


# --- statistics pass ----------------------------------------------------------

#: expressions over the value of each class
_NUMERIC = (
    "min(num) AS min_value",
    "max(num) AS max_value",
    "avg(num) AS mean",
    "IF(count(num) > 0, coalesce(stddev_samp(num), 0D), NULL) AS std",
    # undefined where all values are equal
    "IF(min(num) < max(num), skewness(num), NULL) AS skewness",
    "IF(min(num) < max(num), kurtosis(num), NULL) AS kurtosis",
    "count_if(num < 0) AS negative_count",
)

_BOOLEAN = (
    "count_if(flag) AS true_count",
    "count_if(NOT flag) AS false_count",
    "round(count_if(flag) * 100D / greatest(count(flag), 1), 1) AS true_percent",
)

_STRING = (
    "CAST(min(length(txt)) AS BIGINT) AS min_length",
    "CAST(max(length(txt)) AS BIGINT) AS max_length",
    "avg(length(txt)) AS avg_length",
    "count_if(txt = '') AS empty_count",
)

#: counts that are null, not 0, for columns of another category
_COUNTS_OF = {
    "numeric": ("negative_count",),
    "boolean": ("true_count", "false_count", "true_percent"),
    "datetime": ("range_days", "future_count"),
}


def _matches(name: str) -> str:
    low, high = rules.PII_PATTERN_LENGTHS[name]
    fits = f"length(txt) >= {low}" if high is None else f"length(txt) BETWEEN {low} AND {high}"
    if name == "email":
        fits += " AND contains(txt, '@')"
    return f"{fits} AND txt RLIKE {text(rules.PII_PATTERNS[name])}"


def _pattern_expressions() -> list[str]:
    # cheap tests that a match cannot fail stand before what builds strings
    words = ", ".join(text(w) for w in rules.BOOLEAN_WORDS_AND_LETTERS)
    printed = "ascii(txt) BETWEEN 33 AND 126 AND ascii(right(txt, 1)) BETWEEN 33 AND 126"
    bare = f"IF({printed}, txt, trim(BOTH {text(rules.BLANKS)} FROM txt))"
    starts = ", ".join(str(ord(c)) for c in rules.NUMBER_STARTS)
    return [
        "coalesce(bool_or(contains(txt, '@')), false) AS has_email",
        f"coalesce(bool_or(octet_length(txt) >= 10 AND txt RLIKE {text(rules.CONTAINS_PHONE)}), false) AS has_phone",
        f"coalesce(bool_or(contains(txt, '://') AND txt RLIKE {text(rules.CONTAINS_URL)}), false) AS has_url",
        *[f"count_if({_matches(p)}) AS {p}_count" for p in rules.PII_PATTERNS],
        f"count_if({bare} <> '') AS nonblank_count",
        f"count_if(startswith({bare}, '{{')) AS object_count",
        f"count_if(startswith({bare}, '[')) AS array_count",
        f"count_if(startswith({bare}, '<')) AS markup_count",
        f"count_if(ascii(txt) IN ({starts}) AND replace(txt, ',', '') RLIKE {text(rules.NUMBER)}) AS number_count",
        f"count_if(octet_length(txt) >= 8 AND txt RLIKE {text(rules.CONTAINS_DATE)}) AS date_count",
        f"count_if(length({bare}) <= 5 AND lower({bare}) IN ({words})) AS boolean_count",
    ]


_PATTERN_COUNTS = [f"{name}_count" for name in rules.PII_PATTERNS]
_OF_STRINGS = [
    "min_length", "max_length", "avg_length", "empty_count",
    *(name for e in _pattern_expressions() if (name := e.rsplit(" AS ", 1)[1]) not in _PATTERN_COUNTS),
]


def _size_sql(f: T.StructField) -> str:
    c = quoted(f.name)
    if isinstance(f.dataType, (T.ArrayType, T.MapType)):
        return f"CASE WHEN {c} IS NOT NULL THEN size({c}) END"
    if isinstance(f.dataType, T.BinaryType):
        return f"octet_length({c})"
    if isinstance(f.dataType, T.StructType):
        return f"CASE WHEN {c} IS NOT NULL THEN {len(f.dataType.fields)} END"
    return f"CASE WHEN {c} IS NOT NULL THEN 1 END"


def personal_name(name: str) -> bool:
    return any(w in name.lower() for words in rules.PII_KEYWORDS.values() for w in words)


def _date_named(f: T.StructField) -> bool:
    return any(w in f.name.lower() for w in rules.DATE_NAME_WORDS)


#: the column of the long rows that holds the values of a category, and its type
_CLASSES = {
    "numeric": ("num", "DOUBLE"),
    "string": ("txt", "STRING"),
    "boolean": ("flag", "BOOLEAN"),
    "datetime": ("ts", "TIMESTAMP_NTZ"),
    "complex": ("size", "INT"),
}


def _value_sql(f: T.StructField, category: str, patterns: bool) -> dict[str, str]:
    c = quoted(f.name)
    if category in ("numeric", "datetime") and patterns and personal_name(f.name):
        # what their name says to be personal is matched against the value patterns as text
        own = _value_sql(f, category, False)
        (value,) = own.values()
        return {**own, "txt": f"CASE WHEN {value} IS NOT NULL THEN CAST({c} AS STRING) END"}
    if category == "numeric":
        return {"num": numeric_sql(f.name, f.dataType)}
    if category == "string":
        # strings in columns named like dates: also the time, where they parse
        time = {"ts": f"CAST(try_to_timestamp({c}) AS TIMESTAMP_NTZ)"} if _date_named(f) else {}
        return {"txt": f"CAST({c} AS STRING)", **time}
    if category == "datetime":
        return {"ts": f"CAST({c} AS TIMESTAMP_NTZ)"}
    return {"flag": c} if category == "boolean" else {"size": _size_sql(f)}


def _statistics(lake: Lake, patterns: bool, as_of: str | None) -> DataFrame:
    """One row per column of a table that has rows; one scan and aggregate for all columns without texts, and one for the others.

    So values that are no texts do not pass through the patterns; no column is read twice.
    """
    texts = {cid for _, columns in lake.tables for cid, f, category in columns if "txt" in _value_sql(f, category, patterns)}
    every = {row[0] for row in lake.rows}
    parts = [_statistics_of(lake, cids, patterns, as_of) for cids in (every - texts, texts) if cids]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _statistics_of(lake: Lake, cids: set[int], patterns: bool, as_of: str | None) -> DataFrame:
    now = f"TIMESTAMP_NTZ {text(as_of)}" if as_of else "localtimestamp()"
    used = {
        name
        for _, columns in lake.tables
        for cid, f, category in columns
        if cid in cids
        for name in _value_sql(f, category, patterns)
    }
    names = {name: kind for name, kind in _CLASSES.values() if name in used}

    def values(f, category):
        own = _value_sql(f, category, patterns)
        return [f"CAST({own.get(name, 'NULL')} AS {kind})" for name, kind in names.items()]

    missing = " AND ".join(f"{name} IS NULL" for name in names)
    expressions = ["count(*) AS total_count", f"count_if({missing}) AS null_count"]
    if "num" in used:
        expressions += _NUMERIC
    if "txt" in used:
        expressions += [*_STRING, *(_pattern_expressions() if patterns else ())]
    if "flag" in used:
        expressions += _BOOLEAN
    if "ts" in used:
        expressions += [
            "min(ts) AS min_ts",
            "max(ts) AS max_ts",
            "CAST(floor(timestampdiff(SECOND, min(ts), max(ts)) / 86400) AS BIGINT) AS range_days",
            f"count_if(ts > {now}) AS future_count",
        ]
    if "size" in used:
        expressions.append("avg(size) AS avg_size")
    return lake.long(list(names), values, cids=cids).groupBy("cid").agg(*[F.expr(e) for e in expressions])


# --- frequency pass -----------------------------------------------------------

_DIGEST = "concat('sha256:', sha2({x}, 256))"
# A text that looks like a digest is counted by its own, so no text can be taken for another's digest.
_BY_DIGEST = f"(length({{x}}) > {DIGEST_ABOVE} OR startswith({{x}}, 'sha256:'))"
# to the microsecond, and with nulls: values that differ have different texts
_JSON = (
    "to_json({x}, map('timestampFormat', 'yyyy-MM-dd''T''HH:mm:ss.SSSSSSXXX', "
    "'timestampNTZFormat', 'yyyy-MM-dd''T''HH:mm:ss.SSSSSS', 'ignoreNullFields', 'false'))"
)


def _text_sql(f: T.StructField) -> str:
    """A column that is neither integral nor fractional, as text or as a digest of it."""
    c = quoted(f.name)
    if isinstance(f.dataType, T.StringType):
        return f"IF({_BY_DIGEST.format(x=c)}, {_DIGEST.format(x=c)}, {c})"
    if isinstance(f.dataType, T.BinaryType):
        return _DIGEST.format(x=c)
    if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return _DIGEST.format(x=_JSON.format(x=c))
    return f"CAST({c} AS STRING)"


def _frequencies(lake: Lake, digests: bool = True, cids: set[int] | None = None) -> DataFrame | None:
    """(cid, lng, dbl, txt, n): the count of every distinct non-null value; without ``digests`` long texts stay as they are.

    The value sits in the column of its class, so numbers are never turned into
    text on the way to the shuffle; decimals have their double and their text. A
    value held by a third of the rows costs one row per task.
    """
    is_lng = lambda f, _: isinstance(f.dataType, _INTEGRAL)
    is_dbl = lambda f, _: isinstance(f.dataType, _FRACTIONAL)
    kinds = (
        (is_lng, lambda f, _: [f"CAST({quoted(f.name)} AS BIGINT)"], "v", "NULL", "NULL"),
        (is_dbl, lambda f, _: [numeric_sql(f.name, f.dataType)], "NULL", "v", "NULL"),
        (
            lambda f, c: not is_lng(f, c) and not is_dbl(f, c),
            lambda f, c: [_text_sql(f) if digests else f"CAST({quoted(f.name)} AS STRING)", numeric_sql(f.name, f.dataType) if c == "numeric" else "CAST(NULL AS DOUBLE)"],
            "NULL", "d", "v",
        ),
    )
    pieces = []
    for keep, value, lng, dbl, txt in kinds:
        long = lake.long(["v", "d"] if dbl == "d" else ["v"], value, keep, cids)
        if long is not None:
            pieces.append(
                long.where("v IS NOT NULL").selectExpr(
                    "cid", f"CAST({lng} AS BIGINT) AS lng", f"CAST({dbl} AS DOUBLE) AS dbl",
                    f"CAST({txt} AS STRING) AS txt",
                )
            )
    if not pieces:
        return None
    values = reduce(DataFrame.unionAll, pieces)
    return values.groupBy("cid", "lng", "dbl", "txt").agg(F.expr("count(*) AS n"))


def _private(lake: Lake, stats: DataFrame | None) -> set[int]:
    """The text columns whose values must not be stored: personal by name, or by their values where these were looked at."""
    strings = {r[0]: r[2] for r in lake.rows if r[5] == "string"}
    found = {cid for cid, name in strings.items() if personal_name(name)}
    if stats is not None and "email_count" in stats.columns:
        rate = " OR ".join(f"try_divide({c}, total_count - null_count) > 0.5" for c in _PATTERN_COUNTS)
        found |= {r.cid for r in stats.where(rate).select("cid").collect()} & set(strings)
    return found


def frequencies(df: DataFrame, digests: bool = True) -> DataFrame:
    """The value frequencies of one table; ``cid`` is the column's position."""
    return _frequencies(Lake({"": df}), digests)


def _distinct(freq: DataFrame) -> DataFrame:
    return freq.groupBy("cid").agg(F.expr("count(*) AS unique_count"))


def _leading(freq: DataFrame, top_n: int) -> DataFrame:
    """The rows of ``freq`` less those that cannot be among the ``top_n`` of their column, so that few are sorted.

    Values in different buckets differ: no value counts that is rarer than the ``top_n``-th of the buckets' most frequent ones,
    and of numbers as frequent as that, none above the ``top_n``-th of the buckets' least.
    """
    bucket = f"pmod(xxhash64(lng, dbl, txt), {16 * int(top_n)}) AS bucket"
    nth = lambda x, falling: f"get(sort_array(collect_list({x}), {str(not falling).lower()}), {int(top_n) - 1})"
    most = freq.selectExpr("cid", "n", bucket).groupBy("cid", "bucket").agg(F.expr("max(n) AS n"))
    floors = F.broadcast(most.groupBy("cid").agg(F.expr(f"coalesce({nth('n', True)}, 0L) AS least")))
    rows = freq.join(floors, "cid").where("n >= least")
    least = rows.where("n = least").selectExpr("cid", "lng", "dbl", bucket).groupBy("cid", "bucket").agg(
        F.expr("min(lng) AS lng"), F.expr("min(dbl) AS dbl")
    )
    bounds = F.broadcast(
        least.groupBy("cid").agg(F.expr(f"{nth('lng', False)} AS lng_bound"), F.expr(f"{nth('dbl', False)} AS dbl_bound"))
    )
    kept = "n > least OR coalesce(lng <= lng_bound, dbl <= dbl_bound, true)"
    return rows.join(bounds, "cid", "left").where(kept).select(freq.columns)


def _best(freq: DataFrame, top_n: int) -> DataFrame:
    """(cid, rank, value, count): the row limit is applied in each task before the shuffle."""
    return (
        freq.selectExpr(
            "*",
            "row_number() OVER (PARTITION BY cid ORDER BY n DESC, lng, dbl, txt) AS rank",
        )
        .where(f"rank <= {int(top_n)}")
        .selectExpr(
            "cid", "rank", "coalesce(txt, CAST(lng AS STRING), CAST(dbl AS STRING)) AS value",
            "n AS count",
        )
    )


def _top(
    lake: Lake, freq: DataFrame | None, top_n: int, private: DataFrame | None = None, hidden: set[int] = frozenset(),
    stored: bool = False,
) -> DataFrame:
    """(cid, tops) from the frequencies; those of the ``private`` columns ``hidden`` are not stored on the way."""
    parts = []
    if freq is not None:
        # counts that are stored can be read again to leave most of them out
        best = materialize(_best(_leading(freq, top_n) if stored else freq, top_n), "top-values")
        digests = {r.cid for r in best.where("startswith(value, 'sha256:')").select("cid").collect()}
        parts.append(_restore_long_text(lake, best, digests))
    if private is not None:
        parts.append(_restore_long_text(lake, _best(private, top_n), hidden))
    return reduce(DataFrame.unionByName, parts).groupBy("cid").agg(
        F.expr(
            "transform(sort_array(collect_list(struct(rank, value, count))), "
            "e -> struct(e.value AS value, e.count AS count)) AS tops"
        )
    )


def _restore_long_text(lake: Lake, best: DataFrame, cids: set[int]) -> DataFrame:
    """Put the text back for top values of the columns ``cids`` that were counted by digest; only these are read again."""
    long = lake.long(["v"], lambda f, _: [quoted(f.name)], lambda _, c: c == "string", cids)
    if long is None:
        return best
    long = long.where(_BY_DIGEST.format(x="v")).selectExpr(
        "cid", f"{_DIGEST.format(x='v')} AS value", "v"
    )
    # at most top_n rows per column
    wanted = best.where("startswith(value, 'sha256:')").select("cid", "value")
    texts = (
        long.join(lake.small(wanted), ["cid", "value"], "left_semi")
        .groupBy("cid", "value")
        .agg(F.expr("any_value(v) AS text"))
    )
    # few rows, but of any length: left to the planner, which knows their size
    return best.join(texts, ["cid", "value"], "left").selectExpr(
        "cid", "rank", "coalesce(text, value) AS value", "count"
    )


def _numeric_long(lake: Lake) -> DataFrame:
    rows = lake.long(["v"], lambda f, _: [numeric_sql(f.name, f.dataType)], lambda _, c: c == "numeric")
    return rows.where("v IS NOT NULL")


def _numeric_counts(freq: DataFrame) -> DataFrame:
    """(cid, v, n) of the numeric columns."""
    return freq.where("lng IS NOT NULL OR dbl IS NOT NULL").selectExpr("cid", "coalesce(CAST(lng AS DOUBLE), dbl) AS v", "n")


def _quantiles(counts: DataFrame) -> DataFrame:
    found = quantiles(counts, [0.25, 0.5, 0.75])
    return found.withColumnsRenamed({"p0": "q25", "p1": "median", "p2": "q75"})


def _outliers(lake: Lake, counts: DataFrame, bounds: DataFrame, z: float) -> DataFrame:
    """Values beyond one row of bounds per column, from (cid, v, n) rows.

    With exact counts at hand these are the stored distinct values; otherwise every
    value counts once.
    """
    return (
        counts.join(lake.small(bounds), "cid")
        .groupBy("cid")
        .agg(
            F.expr("coalesce(sum(n) FILTER (WHERE v < iqr_lower OR v > iqr_upper), 0) AS iqr_outliers"),
            F.expr(
                f"coalesce(sum(n) FILTER (WHERE abs(try_divide(v - mean, std)) > {float(z)!r}D), 0) "
                "AS zscore_outliers"
            ),
            F.expr("sum(n) AS present"),
        )
        .selectExpr(
            "cid",
            "iqr_outliers",
            "iqr_outliers * 100D / present AS iqr_outlier_percent",
            "zscore_outliers",
            "zscore_outliers * 100D / present AS zscore_outlier_percent",
        )
    )


def _sketches(lake: Lake) -> DataFrame:
    """Distinct counts and quantiles in one scan, by bounded sketches."""
    pieces = []
    if "numeric" in lake.categories:
        pieces.append(
            _numeric_long(lake)
            .groupBy("cid")
            .agg(
                F.expr("approx_count_distinct(v) AS unique_count"),
                F.expr("percentile_approx(v, array(0.25, 0.5, 0.75), 10000) AS q"),
            )
            .selectExpr("cid", "unique_count", "q[0] AS q25", "q[1] AS median", "q[2] AS q75")
        )
    other = lake.long(["v"], lambda f, _: [f"CAST({_text_sql(f)} AS STRING)"], lambda _, c: c != "numeric")
    if other is not None:
        pieces.append(other.groupBy("cid").agg(F.expr("approx_count_distinct(v) AS unique_count")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pieces)


# --- assembly -----------------------------------------------------------------


def profile_tables(
    tables: Mapping[str, DataFrame],
    *,
    run_id: str | None = None,
    parts: Iterable[str] = ALL_PARTS,
    top_n: int = 10,
    iqr_k: float = 3.0,
    z_k: float = 3.0,
    as_of: str | None = None,
    exact: bool = True,
) -> DataFrame:
    """The profile of a set of tables, one row per column.

    ``parts`` names what to compute; columns of parts left out are null. Value
    counts that several parts read are stored first, by a job of this call; texts
    of columns that are personal, by name or by the patterns if these are asked
    for, are not, and are counted by each part. With
    ``exact=False`` distinct counts and quantiles come from sketches in one scan
    and no frequencies are shuffled (and no top values are given).
    """
    parts = set(parts)
    lake = Lake(tables)
    numeric = "numeric" in lake.categories
    if OUTLIERS in parts:
        parts |= {STATS, QUANTILES}
    stats = _statistics(lake, PATTERNS in parts, as_of)
    stored = (OUTLIERS in parts and numeric) or (exact and TOP in parts and PATTERNS in parts)
    if stored:  # read for the bounds and for what is personal as well
        stats = materialize(stats, "statistics")
    # each frame joined below has one row per column
    extra = []
    quartiles = None
    counted = parts & {DISTINCT, TOP}
    readers = counted | (parts & {QUANTILES, OUTLIERS} if numeric else set())
    # quantiles and outliers alone need no counts of all values
    counts = _numeric_long(lake).selectExpr("cid", "v", "1L AS n") if numeric else None
    if not exact:
        quartiles = _sketches(lake)
        extra.append(quartiles)
    elif counted:
        hidden = _private(lake, stats if stored else None)
        freq = _frequencies(lake, cids={r[0] for r in lake.rows} - hidden)
        private = _frequencies(lake, cids=hidden)
        if len(readers) > 1 and freq is not None:
            freq = materialize(freq, "frequencies")
        if DISTINCT in parts:
            extra.append(reduce(DataFrame.unionAll, [_distinct(x) for x in (freq, private) if x is not None]))
        if numeric:
            counts = _numeric_counts(freq)
    if exact and QUANTILES in parts and numeric:
        quartiles = _quantiles(counts)
        extra.append(quartiles)
    fences = (
        f"q25 - (q75 - q25) * {float(iqr_k)!r}D AS iqr_lower",
        f"q75 + (q75 - q25) * {float(iqr_k)!r}D AS iqr_upper",
    )
    if OUTLIERS in parts and numeric:
        bounds = (
            stats.where("mean IS NOT NULL")
            .join(lake.small(quartiles), "cid")
            .selectExpr("cid", "mean", "std", *fences)
        )
        extra.append(_outliers(lake, counts, bounds, z_k))
    profile = lake.schema().join(lake.small(stats), "cid", "left")
    for frame in extra:
        profile = profile.join(lake.small(frame), "cid", "left")
    if exact and TOP in parts:
        profile = profile.join(_top(lake, freq, top_n, private, hidden, len(readers) > 1), "cid", "left")
    if "q25" in profile.columns:
        profile = profile.selectExpr("*", *fences)
    return _conform(profile, run_id, DISTINCT in parts or not exact)


def column_profile(df: DataFrame, table: str, **options) -> DataFrame:
    """The profile of one table; options as for ``profile_tables``."""
    return profile_tables({table: df}, **options)


def _conform(profile: DataFrame, run_id: str | None, counted: bool) -> DataFrame:
    """The fixed columns of a profile; what was not computed is null."""
    share = "coalesce(try_divide({part} * 100D, total_count), 0D)"
    known = "CASE WHEN total_count IS NOT NULL THEN {x} END"
    of_class = {
        name: f"CASE WHEN type_category = '{category}' THEN {name} END"
        for category, names in (*_COUNTS_OF.items(), ("string", _OF_STRINGS))
        for name in names
        if name in profile.columns
    }
    of_class |= {
        name: f"CASE WHEN type_category = 'string' OR {name} > 0 THEN {name} END"
        for name in _PATTERN_COUNTS
        if name in profile.columns
    }
    derived = of_class | {
        "run_id": "NULL" if run_id is None else text(run_id),
        "null_percent": known.format(x=share.format(part="null_count")),
        "error": "CASE WHEN total_count IS NULL THEN 'empty table' END",
    }
    if counted:
        # an all-null column has no frequency row
        unique = "coalesce(unique_count, 0)"
        derived["unique_count"] = known.format(x=unique)
        derived["unique_percent"] = known.format(x=share.format(part=unique))
    if "tops" in profile.columns:
        derived["top_values"] = (
            "transform(coalesce(tops, array()), e -> struct(e.value AS value, e.count AS count, "
            f"{share.format(part='e.count')} AS percent))"
        )
    present = set(profile.columns)
    return profile.selectExpr(
        *[
            f"CAST({derived.get(name, name if name in present else 'NULL')} AS {data_type}) AS {name}"
            for name, data_type in PROFILE_COLUMNS.items()
        ]
    )


# --- rollups over a profile ---------------------------------------------------


def completeness(profile: DataFrame) -> DataFrame:
    """100 - mean null percent per table; tables without rows are left out."""
    return (
        profile.where("error IS NULL")
        .groupBy("run_id", "table_name")
        .agg(
            F.round(F.lit(100.0) - F.avg("null_percent"), 2).alias("completeness_score"),
            F.count("*").alias("column_count"),
        )
    )


def type_summary(profile: DataFrame) -> DataFrame:
    return profile.groupBy("run_id", "table_name", "type_category").agg(
        F.count("*").alias("column_count")
    )


def exploded_top_values(profile: DataFrame) -> DataFrame:
    """One row per kept value, with its rank from 1."""
    return profile.select(
        "run_id", "table_name", "column_name", "type_category",
        F.posexplode("top_values").alias("pos", "entry"),
    ).select(
        "run_id", "table_name", "column_name", "type_category",
        (F.col("pos") + 1).alias("rank"),
        F.col("entry.value").alias("value"),
        F.col("entry.count").alias("count"),
        F.col("entry.percent").alias("percent"),
    )
