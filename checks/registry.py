"""All queries and their SQL."""

from __future__ import annotations

from checks import (
    q_kpi, q_privacy, q_profile, q_quality, q_relate, q_report, q_semantics, q_sources,
)

QUERIES, ORACLE = {}, {}
for module in (
    q_profile, q_quality, q_privacy, q_relate, q_kpi, q_semantics, q_sources, q_report,
):
    QUERIES.update(module.QUERIES)
    ORACLE.update(module.ORACLE)
