"""KPI queries: detection, readiness, and the KPIs themselves on views of the given tables."""

from __future__ import annotations

from assay.kpi import catalog, detect, ecommerce, health, iot, marketing, saas
from assay.operators import duplicates as D
from assay.operators import profile as P
from assay.operators import semantics as C
from assay.sinks.runs import materialize
from checks.lake import (
    AS_OF, RAW, SHOP, VIEWS, from_sql, lake, over_profile, over_views, rounded, shaped,
    sql_duplicates, view,
)
from checks.q_profile import prof, stored

QUERIES, ORACLE = {}, {}

_SHIFTED = "ts - INTERVAL '1' DAY * CAST(event_id % 90 AS INT)"

# one SQL text per view serves both engines
KPI_VIEWS = {
    "orders": VIEWS["orders"][0],
    "order_items": VIEWS["order_items"][0],
    "cart": "SELECT user_id % 1500 AS cart_id FROM {events} WHERE event_type IN ('click', 'purchase')",
    "subscriptions": f"""
        SELECT event_id % 7000 AS subscription_id, user_id, value AS mrr,
               CASE event_type WHEN 'purchase' THEN 'active' WHEN 'view' THEN 'active'
                               WHEN 'error' THEN 'cancelled' ELSE 'pending' END AS status,
               event_type IN ('signup', 'purchase') AS trial,
               {_SHIFTED} AS created_at,
               CASE WHEN event_type = 'error' THEN ts END AS cancelled_at
        FROM {{events}}""",
    "users": f"SELECT user_id, user_id % 13 AS acquisition_source, {_SHIFTED} AS created_at FROM {{events}}",
    "invoices": "SELECT user_id, value AS amount FROM {events} WHERE event_type = 'purchase'",
    "campaigns": """
        SELECT user_id % 10 AS campaign_id, concat('campaign ', CAST(user_id % 10 AS STRING)) AS name,
               event_type AS channel, sum(value) AS spend, sum(value) AS marketing_spend,
               count(*) AS impressions, sum(CASE WHEN value > 60 THEN 1 ELSE 0 END) AS clicks
        FROM {events} GROUP BY user_id % 10, event_type""",
    "leads": f"""
        SELECT event_id % 6000 AS lead_id,
               CASE WHEN event_id % 3 = 0 THEN 4 ELSE user_id % 12 END AS campaign_id,
               CASE event_type WHEN 'purchase' THEN 'converted' ELSE 'open' END AS status,
               event_type IN ('signup', 'purchase') AS is_qualified, {_SHIFTED} AS created_at
        FROM {{events}}""",
    "conversions": "SELECT user_id % 10 AS campaign_id, value AS revenue FROM {events} WHERE event_type = 'purchase'",
    "mails": """
        SELECT user_id % 10 AS campaign_id, event_type = 'click' AS opened,
               CASE WHEN event_type IN ('click', 'view') THEN 'email_sent' ELSE event_type END AS event_type
        FROM {events}""",
    "telemetry": """
        SELECT user_id AS device_id, ts AS timestamp, value % 100 AS battery, value / 10 AS voltage
        FROM {events}""",
}

ORDERS_NOW, EVENTS_NOW, READINGS_NOW = "2001-08-02", "2024-01-31", "2024-01-30 20:00:00"


def kpi_view(spark, sf, name):
    return from_sql(spark, sf, KPI_VIEWS[name])


def _kpi(key, fn, views, sql, doubles=(), digits=6, **options):
    def run(spark, sf):
        return shaped(fn(*[kpi_view(spark, sf, v) for v in views], **options), digits)

    raws = {n: n for n in RAW}
    ctes = ", ".join(f"k_{v} AS ({KPI_VIEWS[v].format(**raws)})" for v in views)
    QUERIES[f"kpi_{key}"] = run
    text = f"WITH {ctes} {sql}"
    ORACLE[f"kpi_{key}"] = rounded(text, doubles, digits) if doubles else text


_kpi(
    "e1", ecommerce.average_order_value, ["orders"],
    """SELECT date_trunc('month', order_date)::TIMESTAMP AS period, avg(order_total) AS aov, count(DISTINCT order_id) AS orders
       FROM k_orders WHERE order_date >= DATE '2001-08-02' - INTERVAL 12 MONTH GROUP BY 1""",
    ["aov"], 7, as_of=ORDERS_NOW,
)
_kpi(
    "e2", ecommerce.customer_lifetime_value, ["orders"],
    """SELECT customer_id, sum(order_total) AS lifetime_value, count(DISTINCT order_id) AS order_count,
              min(order_date) AS first_order, max(order_date) AS last_order FROM k_orders GROUP BY customer_id""",
    ["lifetime_value"], 4,
)
_kpi(
    "e3", ecommerce.conversion_rate, ["orders"],
    """SELECT date_trunc('week', order_date)::TIMESTAMP AS period,
              count(DISTINCT order_id) / nullif(count(DISTINCT customer_id), 0) AS conversion_rate
       FROM k_orders GROUP BY 1""",
    ["conversion_rate"],
)
_kpi(
    "e4", ecommerce.cart_abandonment, ["cart", "orders"],
    """SELECT count(DISTINCT cart_id) - count(DISTINCT order_id) AS abandoned, count(DISTINCT cart_id) AS total_carts,
              1 - count(DISTINCT order_id) / nullif(count(DISTINCT cart_id), 0) AS abandonment_rate
       FROM k_cart LEFT JOIN k_orders USING (cart_id)""",
    ["abandonment_rate"],
)
_kpi(
    "e5", ecommerce.revenue_growth, ["orders"],
    """, t AS (SELECT date_trunc('month', order_date)::TIMESTAMP AS m, sum(order_total) AS rev FROM k_orders GROUP BY 1)
       SELECT m, round(rev, 2) AS rev, round(rev / nullif(lag(rev) OVER (ORDER BY m), 0) - 1, 2) AS growth_rate FROM t""",
    digits=2,
)
_kpi(
    "e6", ecommerce.retention_rate, ["orders"],
    """, f AS (SELECT customer_id, min(order_date) AS d FROM k_orders GROUP BY 1)
       SELECT count(DISTINCT o.customer_id) FILTER (o.order_date > f.d + INTERVAL 30 DAY)
              / nullif(count(DISTINCT f.customer_id), 0) AS retention_rate
       FROM f LEFT JOIN k_orders o USING (customer_id)""",
    ["retention_rate"],
)
_kpi(
    "e7", ecommerce.items_per_order, ["orders", "order_items"],
    """SELECT date_trunc('month', o.order_date)::TIMESTAMP AS period, avg(n) AS avg_items_per_order
       FROM k_orders o JOIN (SELECT order_id, count(*) AS n FROM k_order_items GROUP BY 1) USING (order_id) GROUP BY 1""",
    ["avg_items_per_order"],
)
_kpi(
    "a1", saas.recurring_revenue, ["subscriptions"],
    """SELECT date_trunc('month', created_at)::TIMESTAMP AS period, sum(mrr) AS total_mrr,
              count(DISTINCT subscription_id) AS active_subs FROM k_subscriptions WHERE status = 'active' GROUP BY 1""",
    ["total_mrr"], 4,
)
_kpi(
    "a2", saas.churn_rate, ["subscriptions"],
    """SELECT (SELECT count(DISTINCT subscription_id) FROM k_subscriptions
               WHERE status = 'cancelled' AND cancelled_at >= TIMESTAMP '2023-12-01')
            / nullif((SELECT count(DISTINCT subscription_id) FROM k_subscriptions
               WHERE status = 'active' AND created_at < TIMESTAMP '2024-01-01'), 0) AS churn_rate""",
    ["churn_rate"], as_of=EVENTS_NOW,
)
_COST = """SELECT date_trunc('month', l.created_at)::TIMESTAMP AS period,
                  sum(c.{spend}) / nullif(count(DISTINCT {person}), 0) AS {name}
           FROM {people} l JOIN k_campaigns c ON l.{key} = c.campaign_id GROUP BY 1"""
_kpi(
    "a3", saas.acquisition_cost, ["users", "campaigns"],
    _COST.format(spend="marketing_spend", person="l.user_id", name="cac", people="k_users", key="acquisition_source"),
    ["cac"], 4,
)
_kpi(
    "a4", saas.net_revenue_retention, ["subscriptions"],
    """SELECT sum(mrr) FILTER (created_at < TIMESTAMP '2024-01-01')
            / nullif(sum(mrr) FILTER (created_at < TIMESTAMP '2023-12-01'), 0) AS nrr
       FROM k_subscriptions WHERE status = 'active'""",
    ["nrr"], as_of=EVENTS_NOW,
)
_kpi(
    "a5", saas.trial_conversion, ["subscriptions"],
    """SELECT count(DISTINCT subscription_id) FILTER (status = 'active')
            / nullif(count(DISTINCT subscription_id) FILTER (trial), 0) AS trial_conversion FROM k_subscriptions""",
    ["trial_conversion"],
)
_kpi(
    "a6", saas.revenue_per_user, ["subscriptions"],
    """SELECT date_trunc('month', created_at)::TIMESTAMP AS period, sum(mrr) / nullif(count(DISTINCT user_id), 0) AS arpu
       FROM k_subscriptions WHERE status = 'active' GROUP BY 1""",
    ["arpu"],
)
_kpi(
    "a7", saas.average_lifetime_value, ["invoices"],
    "SELECT avg(t) AS avg_ltv FROM (SELECT sum(amount) AS t FROM k_invoices GROUP BY user_id)", ["avg_ltv"],
)
_WEEK = "timestamp >= TIMESTAMP '2024-01-24'"
_kpi(
    "i1", iot.device_health, ["telemetry"],
    f"""SELECT count(DISTINCT device_id) AS total_devices,
               avg(CASE WHEN battery >= 50 THEN 100 WHEN battery >= 20 THEN 70 WHEN battery >= 10 THEN 40 ELSE 20 END) AS avg_health_score
        FROM k_telemetry WHERE {_WEEK}""",
    ["avg_health_score"], as_of=EVENTS_NOW,
)
_kpi(
    "i2", iot.battery_index, ["telemetry"],
    f"""SELECT avg(battery) AS avg_battery_level, min(battery) AS min_battery_level,
               count(*) FILTER (battery < 20) AS low_battery_count, count(*) FILTER (battery < 10) AS critical_battery_count
        FROM k_telemetry WHERE {_WEEK}""",
    ["avg_battery_level", "min_battery_level"], as_of=EVENTS_NOW,
)
_kpi(
    "i3", iot.uptime, ["telemetry"],
    f"""SELECT count(DISTINCT device_id) AS total_devices,
               count(DISTINCT device_id) FILTER (timestamp >= TIMESTAMP '{READINGS_NOW}' - INTERVAL 1 HOUR) AS active_last_hour,
               count(DISTINCT device_id) FILTER (timestamp >= TIMESTAMP '{READINGS_NOW}' - INTERVAL 24 HOUR) AS active_last_day,
               count(DISTINCT device_id) FILTER (timestamp < TIMESTAMP '{READINGS_NOW}' - INTERVAL 7 DAY) AS offline_devices
        FROM k_telemetry""",
    as_of=READINGS_NOW,
)
_kpi(
    "i4", iot.report_frequency, ["telemetry"],
    """SELECT device_id, count(*) AS total_reports, max(timestamp) AS last_report, min(timestamp) AS first_report,
              count(*) / nullif(date_part('day', max(timestamp) - min(timestamp)), 0) AS avg_reports_per_day
       FROM k_telemetry GROUP BY device_id HAVING count(*) > 1""",
    ["avg_reports_per_day"],
)
_kpi(
    "i5", iot.voltage_anomalies, ["telemetry"],
    """SELECT device_id, voltage, timestamp, z_score FROM (
         SELECT *, (voltage - avg(voltage) OVER ()) / nullif(stddev_samp(voltage) OVER (), 0) AS z_score FROM k_telemetry)
       WHERE abs(z_score) > 2""",
    ["voltage", "z_score"],
)
_kpi(
    "i6", iot.fleet_coverage, ["telemetry"],
    """SELECT count(DISTINCT device_id) AS total_devices, max(timestamp) AS last_activity, min(timestamp) AS first_activity
       FROM k_telemetry""",
)
_kpi(
    "i7", iot.critical_alerts, ["telemetry"],
    """SELECT count(DISTINCT device_id) AS devices_with_alerts, count(*) AS total_critical_readings,
              count(*) FILTER (battery < 10) AS critical_battery_alerts, count(*) FILTER (voltage < 3.5) AS critical_voltage_alerts
       FROM k_telemetry WHERE timestamp >= TIMESTAMP '2024-01-29' AND (battery < 10 OR voltage < 3.5)""",
    as_of="2024-01-30",
)


def _uptime_of_renamed(spark, sf):
    """Uptime over telemetry whose columns have other names, found by their class."""
    table = kpi_view(spark, sf, "telemetry").selectExpr("device_id AS sensor_ref", "timestamp AS created_on", "battery AS charge")
    profile = materialize(P.profile_tables({"readings": table}, parts=(P.STATS, P.DISTINCT)))
    bound = iot.bindings(profile, C.column_classes(profile), "readings")
    return shaped(iot.run_bound(iot.uptime, table, bound, READINGS_NOW))


QUERIES["kpi_i3_bound"] = _uptime_of_renamed
ORACLE["kpi_i3_bound"] = ORACLE["kpi_i3"]
_kpi(
    "l1", marketing.cost_per_lead, ["leads", "campaigns"],
    _COST.format(spend="spend", person="l.lead_id", name="cpl", people="k_leads", key="campaign_id"), ["cpl"], 4,
)
_kpi(
    "l2", marketing.lead_conversion, ["leads"],
    """SELECT count(DISTINCT lead_id) FILTER (status = 'converted') / nullif(count(DISTINCT lead_id), 0) AS conversion_rate
       FROM k_leads""",
    ["conversion_rate"],
)
_kpi(
    "l3", marketing.return_on_spend, ["campaigns", "conversions"],
    """SELECT c.campaign_id, name AS campaign_name, sum(revenue) / nullif(sum(spend), 0) AS roas
       FROM k_campaigns c JOIN k_conversions v ON c.campaign_id = v.campaign_id GROUP BY 1, 2""",
    ["roas"],
)
_kpi(
    "l4", marketing.click_through, ["campaigns"],
    "SELECT campaign_id, sum(clicks) / nullif(sum(impressions), 0) AS ctr FROM k_campaigns GROUP BY 1", ["ctr"],
)
_kpi(
    "l5", marketing.qualified_rate, ["leads"],
    """SELECT date_trunc('month', created_at)::TIMESTAMP AS period,
              count(DISTINCT lead_id) FILTER (is_qualified) / nullif(count(DISTINCT lead_id), 0) AS mql_rate
       FROM k_leads GROUP BY 1""",
    ["mql_rate"],
)
_kpi(
    "l6", marketing.acquisition_cost, ["leads", "campaigns"],
    _COST.format(
        spend="spend", person="CASE WHEN l.status = 'converted' THEN l.lead_id END", name="cac",
        people="k_leads", key="campaign_id",
    ),
    ["cac"], 4,
)
_kpi(
    "l7", marketing.email_engagement, ["mails"],
    """SELECT campaign_id, count(*) FILTER (opened) / nullif(count(*), 0) AS open_rate
       FROM k_mails WHERE event_type = 'email_sent' GROUP BY 1""",
    ["open_rate"],
)

# --- data health --------------------------------------------------------------

_SNAPSHOTS = """
SELECT 'orders' AS table_name, month(order_date) AS snapshot, count(*) AS row_count FROM {o} GROUP BY month(order_date)
UNION ALL
SELECT 'order_items', month(ship_date), count(*) FROM {i} GROUP BY month(ship_date)"""


def _growth(spark, sf):
    snapshots = spark.sql(_SNAPSHOTS, o=view(spark, sf, "orders"), i=view(spark, sf, "order_items"))
    return shaped(health.row_growth(snapshots))


QUERIES["kpi_n1"] = _growth
ORACLE["kpi_n1"] = rounded(
    over_views(
        f""", s AS ({_SNAPSHOTS.format(o='v_orders', i='v_order_items')}),
        b AS (SELECT *, lag(row_count) OVER (PARTITION BY table_name ORDER BY snapshot) AS previous_count FROM s)
        SELECT *, (row_count - previous_count) * 100.0 / previous_count AS growth_percent FROM b""",
        ["orders", "order_items"],
    ),
    ["growth_percent"],
)
_TIMED = {"orders": "order_date", "order_items": "ship_date", "activity": "created_at"}
QUERIES["kpi_n2"] = lambda s, d: shaped(
    health.freshness({n: (view(s, d, n), c) for n, c in _TIMED.items()}, AS_OF)
)
ORACLE["kpi_n2"] = over_views(
    " UNION ALL ".join(
        f"""SELECT '{n}' AS table_name, max({c}) AS latest,
               CAST(floor(date_diff('second', max({c}), TIMESTAMP '{AS_OF}') / 86400.0) AS BIGINT) AS days_stale FROM v_{n}"""
        for n, c in _TIMED.items()
    )
)
QUERIES["kpi_n3"] = lambda s, d: shaped(health.completeness_index(prof(s, d)).drop("run_id"))
ORACLE["kpi_n3"] = over_profile(
    "SELECT round(avg(1 - null_percent / 100), 6) AS completeness_index FROM p"
)
QUERIES["kpi_n4"] = lambda s, d: shaped(health.duplicate_rate(D.duplicates(lake(s, d))))
ORACLE["kpi_n4"] = over_views(
    f"""SELECT table_name, duplicate_rows AS duplicate_count, round(duplicate_percent / 100, 6) AS dup_rate
        FROM ({sql_duplicates(SHOP)})"""
)


def _two_snapshots(spark, sf):
    """Profiles of the shop before and after a migration of two tables."""
    old = stored(spark, sf)
    new_tables = lake(spark, sf, ["orders", "order_items", "customers", "activity"])
    new_tables["orders"] = new_tables["orders"].selectExpr(
        "CAST(order_id AS STRING) AS order_id", "* EXCEPT (order_id, promo_code)", "'EUR' AS currency"
    )
    from assay.sinks.runs import materialize

    new = materialize(P.profile_tables(new_tables, parts=(P.STATS,)))
    return old, new


QUERIES["kpi_n5"] = lambda s, d: shaped(health.schema_drift(*_two_snapshots(s, d)))
_OLD = ", ".join(f"('{t}', '{c}', '{k}')" for t in SHOP for c, k, _ in VIEWS[t][1])
_DRIFT = f"""
WITH o(table_name, column_name, old_type) AS (VALUES {_OLD}),
n AS (SELECT table_name, column_name, CASE WHEN table_name = 'orders' AND column_name = 'order_id' THEN 'string' ELSE old_type END AS new_type
      FROM o WHERE table_name <> 'products' AND column_name <> 'promo_code'
      UNION ALL SELECT 'orders', 'currency', 'string'),
x AS (SELECT table_name, column_name, old_type, new_type,
        CASE WHEN old_type IS NULL THEN 'added' WHEN new_type IS NULL THEN 'removed'
             WHEN old_type <> new_type THEN 'type_changed' END AS change_type
      FROM o FULL JOIN n USING (table_name, column_name))
"""
ORACLE["kpi_n5"] = _DRIFT + "SELECT * FROM x WHERE change_type IS NOT NULL"
QUERIES["schema_drift_score"] = lambda s, d: shaped(
    health.drift_score(health.schema_drift(*_two_snapshots(s, d)))
)
ORACLE["schema_drift_score"] = (
    _DRIFT
    + """SELECT table_name, count(*) AS changes, count(*) FILTER (change_type = 'added') AS added,
                count(*) FILTER (change_type = 'removed') AS removed, count(*) FILTER (change_type = 'type_changed') AS type_changed
         FROM x WHERE change_type IS NOT NULL GROUP BY 1"""
)

# --- detection and readiness --------------------------------------------------

_NAMES = f"""
names AS (SELECT DISTINCT 'table' AS kind, table_name AS name FROM p UNION SELECT DISTINCT 'column', column_name FROM p),
sig(industry, kind, name) AS (VALUES {", ".join(
    f"('{i}', '{k}', '{n}')" for i, kinds in catalog.SIGNALS.items() for k, ns in kinds.items() for n in ns)}),
sc AS (SELECT *, row_number() OVER (ORDER BY score DESC, industry) AS rank FROM (
  SELECT industry, count(names.name) AS hits, count(*) AS signals, round(count(names.name) / count(*), 4) AS score
  FROM sig LEFT JOIN names USING (kind, name) GROUP BY industry)),
det AS (SELECT CASE WHEN a.score >= 0.3 THEN a.industry ELSE 'general' END AS industry, 'auto_detected' AS method,
               a.score AS confidence, CASE WHEN a.score >= 0.3 THEN b.industry ELSE a.industry END AS runner_up
        FROM sc a, sc b WHERE a.rank = 1 AND b.rank = 2)
"""


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


KPI_SQL = f"""{_NAMES},
cat(industry, priority, name, required_tables, required_fields, any_of) AS (VALUES {", ".join(
    f"('{k.industry}', {k.priority}, '{k.name}', {_list(k.tables)}, {_list(k.fields)}, {_list(k.any_of)})" for k in catalog.KPIS)}),
nl AS (SELECT list(name) FILTER (kind = 'table') AS tn, list(name) FILTER (kind = 'column') AS cn FROM names),
rd AS (
  SELECT cat.*, list_sort(list_filter(required_tables, lambda t: NOT list_contains(tn, t))) AS mt,
         list_sort(list_filter(required_fields, lambda f: NOT list_contains(cn, f))) AS mf,
         len(any_of) = 0 OR list_has_any(any_of, list_concat(tn, cn)) AS any_ok
  FROM cat, nl),
fill AS (SELECT column_name, max(1 - null_percent / 100) AS f FROM p GROUP BY 1),
ready AS (
  SELECT industry, priority, name, array_to_string(mt, '|') AS missing_tables, array_to_string(mf, '|') AS missing_fields,
         len(mt) = 0 AND len(mf) = 0 AND any_ok AS is_ready,
         (SELECT round(min(f), 6) FROM fill WHERE list_contains(required_fields, column_name)) AS field_fill
  FROM rd)
"""

QUERIES["industry_scores"] = lambda s, d: shaped(
    detect.industry_scores(stored(s, d)).drop("run_id")
)
ORACLE["industry_scores"] = over_profile(f"WITH {_NAMES.strip()} SELECT * FROM sc")
QUERIES["industry_detected"] = lambda s, d: shaped(
    detect.detect_industry(stored(s, d)).drop("run_id")
)
ORACLE["industry_detected"] = over_profile(f"WITH {_NAMES.strip()} SELECT * FROM det")
_SHOWN = ["industry", "priority", "name", "missing_tables", "missing_fields", "is_ready", "field_fill"]
QUERIES["kpi_readiness"] = lambda s, d: shaped(detect.kpi_readiness(stored(s, d)).select(*_SHOWN))
ORACLE["kpi_readiness"] = over_profile(f"WITH {KPI_SQL.strip()} SELECT * FROM ready")
QUERIES["kpi_recommend"] = lambda s, d: shaped(
    detect.recommend(stored(s, d)).select("industry", "rank", "name", "priority", "field_fill", "confidence")
)
ORACLE["kpi_recommend"] = over_profile(
    f"""WITH {KPI_SQL.strip()}
    SELECT industry, row_number() OVER (ORDER BY priority) AS rank, name, priority, field_fill, 1.0::DOUBLE AS confidence
    FROM ready SEMI JOIN det USING (industry) WHERE is_ready QUALIFY rank <= 7"""
)


def _contract(spark, sf):
    """The contract row of every KPI that can run, with its readiness and a sentence."""
    rows = detect.recommend(stored(spark, sf))
    return shaped(
        rows.select(
            "name", "category", "grain", "description", "required_tables", "required_fields", "dimensions", "blocked_by",
            "readiness.is_ready", "readiness.missing_tables", "readiness.missing_fields",
        )
    )


def _contract_sql() -> str:
    """The catalogue's rows, for the KPIs that are ready."""
    lists = lambda values: "'" + "|".join(values) + "'"
    rows = ", ".join(
        f"('{k.industry}', {k.priority}, '{k.name}', '{k.category}', '{k.grain}', '{k.formula.replace(chr(39), chr(39) * 2)}; {k.grain.replace('_', ' ')}', "
        f"{lists(k.tables)}, {lists(k.fields)}, {lists(k.dimensions)}, {lists(k.blocked_by)})"
        for k in catalog.KPIS
    )
    return over_profile(f"""WITH {KPI_SQL.strip()},
    book(industry, priority, name, category, grain, description, required_tables, required_fields, dimensions, blocked_by) AS (VALUES {rows})
    SELECT book.name, category, book.grain, description, book.required_tables, book.required_fields, book.dimensions, book.blocked_by,
           true AS is_ready, '' AS missing_tables, '' AS missing_fields
    FROM book JOIN (SELECT * FROM ready SEMI JOIN det USING (industry) WHERE is_ready ORDER BY priority LIMIT 7) r
      ON r.name = book.name AND r.industry = book.industry""")


QUERIES["kpi_contract"] = _contract
ORACLE["kpi_contract"] = _contract_sql()
