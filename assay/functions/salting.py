"""Equi-joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT_BUCKETS = 16


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[Column],
    how: str = "inner",
    buckets: int = SALT_BUCKETS,
) -> DataFrame:
    """Join ``big`` (any number of rows per key) with ``small`` (one row per key).

    A row of ``big`` goes to one of ``buckets`` salts by the hash of
    ``spread_by``; ``small`` is repeated once per salt. A hot key is thus shared by
    ``buckets`` tasks. The salt is a function of the row, so a recomputed task
    sends each row to the same place. ``how`` may be inner, left, left_semi or
    left_anti: each looks at a ``big`` row once.
    """
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(buckets)).cast("int")
    salts = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
    left = big.withColumn("_salt", salt)
    right = small.withColumn("_salt", salts)
    return left.join(right, [*on, "_salt"], how).drop("_salt")
