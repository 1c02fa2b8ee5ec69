"""Words and letters as the operators here count them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = r"[\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else.

    ``lower`` is the fast way and changes only A-Z where a text has no other capital letter.
    """
    other = F.rlike(text, F.lit(r"[\x{80}-\x{10FFFF}&&[\p{IsUppercase}\p{Lt}]]"))
    return F.when(other, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    """The runs of anything but space and the controls 9 to 13; none of null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
