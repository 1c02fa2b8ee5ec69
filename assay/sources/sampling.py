"""Samples that are the same on every run and on every cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assay.functions import quoted


def head(df: DataFrame, n: int = 10_000, order_by: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows, by ``order_by`` where a stable result is wanted."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)


def by_rate(df: DataFrame, key: Column, percent: int) -> DataFrame:
    """Rows whose key hashes below ``percent`` of 100; keeps all rows of a key together."""
    digits = F.substring(F.sha2(key.cast("string").cast("binary"), 256), 1, 8)
    return df.where(F.conv(digits, 16, 10).cast("bigint") % 100 < percent)


def by_modulus(df: DataFrame, key: Column, every: int) -> DataFrame:
    """Every ``every``-th integer key."""
    return df.where(F.pmod(key, F.lit(every)) == 0)


def bernoulli(df: DataFrame, rate: float, seed: int = 42) -> DataFrame:
    return df.sample(fraction=rate, seed=seed)


def sampling_plan(
    counts: DataFrame,
    *,
    enabled: bool = True,
    small: int = 100_000,
    large: int = 10_000_000,
    medium_rate: float = 0.10,
    large_rate: float = 0.05,
    max_rows: int = 1_000_000,
) -> DataFrame:
    """Per table (table_name, row_count): method, rate and expected rows."""
    rows = F.col("row_count")
    full = F.lit(not enabled) | (rows <= small)
    rate = F.when(full, 1.0).when(rows <= large, medium_rate).otherwise(large_rate)
    return counts.select(
        "table_name",
        "row_count",
        F.when(full, "full").otherwise("sample").alias("method"),
        rate.alias("rate"),
        F.when(full, rows)
        .otherwise(F.least(F.floor(rows * rate).cast("bigint"), F.lit(max_rows)))
        .alias("expected_rows"),
    )


def _place(df: DataFrame, key: list[str] | None, seed: int) -> Column:
    """60 bits of a row's SHA-256 with the seed: its place among all rows. Nulls differ from empty texts."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(quoted(c)).cast("string")), F.lit("-")) for c in key]
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def exactly(df: DataFrame, n: int, key: list[str] | None = None, seed: int = 42) -> DataFrame:
    """A uniform sample of exactly ``n`` rows (all, if there are fewer): those whose hashes come first.

    The hash is that of ``key``, which should tell rows apart, or else of the whole row, so the sample does not depend on how
    the table is partitioned. The ``n``-th hash is found by counting rows per range of hashes, 65,536 ranges at a time, until
    its range holds few; one filter then takes the rows. Of rows with the very hash of the ``n``-th, any are taken.
    """
    key = key or [c for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]
    place = _place(df, key, seed)
    low, bits, need = 0, 60, n
    if n <= 0:
        return df.limit(0)
    while True:
        width = max(bits - 16, 0)
        inside = df.select(place.alias("h")).where((F.col("h") >= low) & (F.col("h") < low + (1 << bits)))
        counts = inside.groupBy(F.shiftright(F.col("h") - low, width).alias("range")).count()
        ranges = sorted(map(tuple, counts.toLocalIterator()))  # at most 65,536
        for part, rows in ranges:
            if need <= rows:
                break
            need -= rows
        else:
            return df  # fewer rows than asked for
        low, bits = low + (part << width), width
        if rows <= 10_000 or not bits:
            break
    here = (place >= low) & (place < low + (1 << bits))
    nth = df.where(here).select(place.alias("h")).orderBy("h").limit(need).collect()[-1].h if bits else low
    below = df.where(place < nth)
    return below.unionAll(df.where(place == nth).limit(n - below.count()))


def extract(
    df: DataFrame, method: str, rate: float, max_rows: int, seed: int = 42, row_count: int | None = None,
    key: list[str] | None = None,
) -> DataFrame:
    """Apply one row of a sampling plan: all rows, or exactly the expected number from all of the table.

    ``row_count`` saves counting; ``key`` names columns that tell rows apart, which saves hashing all others.
    """
    if method == "full":
        return df
    total = df.count() if row_count is None else row_count
    return exactly(df, min(int(total * rate), max_rows), key, seed)


def stratified_by_date(
    df: DataFrame, ts: str, key: list[str], *, strata: int, per_stratum: int
) -> DataFrame:
    """Up to ``per_stratum`` rows from each of ``strata`` equal spans of time.

    Rows are taken in key order within a span; the row limit is applied in each
    task before the shuffle, so a span that holds most rows stays cheap.
    """
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    low, high = df.agg(F.min(t)).scalar(), df.agg(F.max(t)).scalar()
    span = F.floor(F.coalesce(F.try_divide((t - low) * strata, high - low), F.lit(0)))
    spread = df.withColumn("stratum", F.least(span, F.lit(strata - 1)).cast("int"))
    order = W.partitionBy("stratum").orderBy(*key)
    return (
        spread.where(F.col(ts).isNotNull())
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= per_stratum)
        .drop("_rank")
    )
