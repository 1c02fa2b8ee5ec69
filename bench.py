"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from assay.operators import duplicates as D
from assay.operators import masking as M
from assay.operators import privacy as Y
from assay.operators import profile as P
from assay.operators import quality as Q
from assay.operators import relate as R
from assay.operators import semantics as C
from assay.session import local_session
from checks.lake import AS_OF, lake, raw, view
from checks.q_kpi import QUERIES as KPI
from checks.q_semantics import QUERIES as SEMANTICS

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def wide(spark):
    """50 mixed columns over every order: the shape of a wide text-and-number table."""
    columns = []
    for i in range(50):
        value = (
            f"CAST((o_orderkey * {i + 3}) % 1000 AS INT)",
            f"o_totalprice * {i + 1}",
            f"concat('v', CAST((o_custkey + {i}) % 4 AS STRING))",
            f"concat('user', CAST(o_custkey + {i} AS STRING), '@example.com')",
            f"concat('text ', o_orderpriority, ' ', CAST(o_orderkey AS STRING))",
        )[i % 5]
        if i % 3 == 0:
            value = f"CASE WHEN (o_orderkey + {i}) % 20 = 0 THEN NULL ELSE {value} END"
        columns.append(f"{value} AS c{i}")
    return raw(spark, SF_DIR, "orders").selectExpr(*columns)


def headline(spark):
    lineitem = lambda: raw(spark, SF_DIR, "lineitem")
    profile = lambda *parts, **kw: P.column_profile(lineitem(), "lineitem", parts=parts, **kw)

    def quality():
        tables = lake(spark, SF_DIR)
        p = P.profile_tables(tables, as_of=AS_OF, parts=(P.STATS,))
        return Q.scores(Q.component_rows(p, D.duplicates(tables), AS_OF))

    def pii():
        p = P.profile_tables(
            {n: raw(spark, SF_DIR, n) for n in ("documents", "pages", "conversations")},
            parts=(P.STATS, P.PATTERNS),
        )
        return Y.pii_columns(p)

    def kpi(key):
        return lambda: KPI[f"kpi_{key}"](spark, SF_DIR)

    return {
        "profile_lineitem_full": lambda: profile(*P.ALL_PARTS),
        "profile_lineitem_sketched": lambda: profile(P.STATS, exact=False),
        "profile_stats": lambda: profile(P.STATS),
        "profile_distinct": lambda: profile(P.DISTINCT),
        "profile_top_values": lambda: profile(P.TOP),
        "profile_quantiles": lambda: profile(P.QUANTILES),
        "profile_orders_x50": lambda: P.column_profile(wide(spark), "wide", parts=P.ALL_PARTS),
        "profile_texts": lambda: P.column_profile(
            raw(spark, SF_DIR, "documents"), "documents", parts=P.ALL_PARTS
        ),
        "duplicates_lineitem": lambda: D.duplicate_rows(lineitem(), "lineitem"),
        "quality_shop": quality,
        "pii_texts": pii,
        "correlations_lineitem": lambda: C.correlations(lineitem(), "lineitem"),
        "mask_customers": lambda: M.mask(view(spark, SF_DIR, "customers"), salt="x"),
        "fk_orphans": lambda: R.fk_orphans(
            lineitem(), ["l_orderkey"], raw(spark, SF_DIR, "orders"), ["o_orderkey"]
        ),
        "readiness_shop": lambda: SEMANTICS["readiness"](spark, SF_DIR),
        "kpi_aov": kpi("e1"),
        "kpi_ltv": kpi("e2"),
        "kpi_retention": kpi("e6"),
        "kpi_items_per_order": kpi("e7"),
        "kpi_cost_per_lead": kpi("l1"),
        "kpi_voltage": kpi("i5"),
    }


def main() -> None:
    spark = local_session(CPUS, app="bench", **{"spark.sql.files.openCostInBytes": "262144"})
    spark.sparkContext.setLogLevel("ERROR")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    only = os.environ.get("BENCH_ONLY")
    times = {}
    for name, build in headline(spark).items():
        if only and name not in only.split(","):
            continue
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": SF_DIR.rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
