"""Column masking as expressions; nulls stay null."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay import rules
from assay.functions import col


def _text(c: Column) -> Column:
    return c.cast("string")


def redact(c: Column) -> Column:
    return F.when(c.isNotNull(), F.lit("***REDACTED***"))


def hashed(c: Column, salt: str = "") -> Column:
    digest = F.sha2(F.concat(F.lit(salt), _text(c)), 256)
    return F.concat(F.lit("HASH_"), F.substring(digest, 1, 16))


def partial(c: Column) -> Column:
    text = _text(c)
    size = F.length(text)
    shown = F.concat(F.left(text, F.lit(1)), F.repeat(F.lit("*"), size - 2), F.right(text, F.lit(1)))
    return F.when(size <= 4, F.lit("***")).when(size > 4, shown)


def nulled(c: Column) -> Column:
    return F.lit(None).cast("string")


def truncated(c: Column) -> Column:
    text = _text(c)
    return F.when(F.length(text) > 3, F.concat(F.left(text, F.lit(3)), F.lit("***"))).when(
        text.isNotNull(), F.lit("***")
    )


def fake(c: Column) -> Column:
    return F.when(c.isNotNull(), F.lit("***FAKE***"))


STRATEGIES = {
    "redact": redact,
    "hash": hashed,
    "partial": partial,
    "null": nulled,
    "truncate": truncated,
    "fake": fake,
}


def plan(columns: Sequence[str], mask_rules: Sequence[tuple[str, str, int]] = rules.MASK_RULES) -> dict[str, str]:
    """Column -> strategy: the matching rule of highest priority, first listed on ties."""
    ordered = sorted(mask_rules, key=lambda r: -r[2])
    chosen = {}
    for name in columns:
        for pattern, strategy, _ in ordered:
            if re.search(pattern, name, re.IGNORECASE):
                chosen[name] = strategy
                break
    return chosen


def mask(
    df: DataFrame,
    mask_rules: Sequence[tuple[str, str, int]] = rules.MASK_RULES,
    salt: str = "",
) -> DataFrame:
    """All matching columns masked in one projection; ``plan`` names them."""
    chosen = plan(df.columns, mask_rules)

    def masked(name: str, strategy: str) -> Column:
        c = col(name)
        return hashed(c, salt) if strategy == "hash" else STRATEGIES[strategy](c)

    return df.select(
        *[
            masked(name, chosen[name]).alias(name) if name in chosen else col(name)
            for name in df.columns
        ]
    )
