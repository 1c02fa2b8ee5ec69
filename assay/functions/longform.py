"""Wide tables -> long (cid, value) rows.

Every profile aggregate runs on this form: one compact ``GROUP BY cid`` for all
columns of all tables, whose generated code does not grow with the tables' width,
instead of one aggregate expression per column and statistic.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame

#: columns per stack expression with one value each, fewer with more values; wider
#: tables are split so that generated code stays small. Each piece scans only its
#: own columns.
STACK_WIDTH = 48


def long_form(
    sources: Iterable[tuple[DataFrame, Sequence[tuple[int, Sequence[str]]]]],
    names: Sequence[str],
) -> DataFrame | None:
    """One output row per (input row, listed column), over all sources.

    A source is a table with its (cid, SQL value expressions); ``names`` are the
    output names of the value expressions. None if no column is listed.
    """
    shown = ", ".join(["cid", *names])
    width = max(8, 2 * STACK_WIDTH // (1 + len(names)))
    pieces = []
    for df, columns in sources:
        for start in range(0, len(columns), width):
            part = columns[start : start + width]
            args = ", ".join(f"{cid}, {', '.join(values)}" for cid, values in part)
            pieces.append(df.selectExpr(f"stack({len(part)}, {args}) AS ({shown})"))
    return reduce(DataFrame.unionAll, pieces) if pieces else None
