"""Column-level helpers shared by the operators."""

from assay.functions.columns import (
    col,
    first_of_run,
    join_by_run,
    literal_rows,
    missing,
    missing_sql,
    name_has_any,
    numeric_sql,
    numeric_value,
    percent,
    quoted,
    text,
    type_category,
)
from assay.functions.longform import long_form

__all__ = [
    "col",
    "first_of_run",
    "join_by_run",
    "literal_rows",
    "long_form",
    "missing",
    "missing_sql",
    "name_has_any",
    "numeric_sql",
    "numeric_value",
    "percent",
    "quoted",
    "text",
    "type_category",
]
