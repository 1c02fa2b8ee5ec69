"""Time arithmetic shared by the KPIs; ``as_of`` stands for the present moment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def now(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def today(as_of: str) -> Column:
    return F.lit(as_of).cast("date").cast("timestamp_ntz")


def month_start(as_of: str, back: int = 0) -> Column:
    first = F.trunc(F.lit(as_of).cast("date"), "month")
    return F.add_months(first, -back).cast("timestamp_ntz")


def months_ago(as_of: str, months: int) -> Column:
    return F.add_months(F.lit(as_of).cast("date"), -months).cast("timestamp_ntz")


def ago(as_of: str, *, days: int = 0, hours: int = 0, of_day: bool = False) -> Column:
    start = today(as_of) if of_day else now(as_of)
    return start - F.make_dt_interval(F.lit(days), F.lit(hours))


def period(unit: str, ts: Column) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null for a zero or null b."""
    return F.try_divide(a.cast("double"), b.cast("double"))
