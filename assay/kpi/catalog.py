"""The KPI catalogue: what each KPI needs, and the query that computes it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from assay.functions import literal_rows

# Names whose presence points to an industry.
SIGNALS = {
    "ecommerce": {
        "table": [
            "orders", "products", "customers", "payments", "cart", "transactions",
            "order_items", "invoices",
        ],
        "column": [
            "order_id", "product_id", "customer_id", "order_total", "order_date", "quantity",
            "price", "revenue", "discount",
        ],
    },
    "saas": {
        "table": [
            "subscriptions", "users", "invoices", "payments", "events", "plans", "trials",
            "accounts",
        ],
        "column": [
            "subscription_id", "user_id", "mrr", "arr", "status", "plan_id", "churn", "trial",
        ],
    },
    "iot": {
        "table": [
            "device", "telemetry", "sensor", "gateway", "tracker", "equipment", "asset", "fleet",
        ],
        "column": [
            "device_id", "device", "sensor", "battery", "voltage", "signal", "temperature",
            "humidity", "latitude", "longitude", "telemetry", "reading", "measurement",
            "timestamp", "last_seen", "last_report",
        ],
    },
    "marketing": {
        "table": [
            "leads", "campaigns", "conversions", "contacts", "channels", "ads", "landing_pages",
            "events",
        ],
        "column": [
            "lead_id", "campaign_id", "source", "channel", "conversion", "click", "impression",
            "spend", "cost",
        ],
    },
}


@dataclass(frozen=True)
class Kpi:
    industry: str
    priority: int
    name: str
    category: str
    grain: str
    formula: str
    query: str
    tables: list[str] = field(default_factory=list)
    fields: list[str] = field(default_factory=list)
    dimensions: list[str] = field(default_factory=list)
    any_of: list[str] = field(default_factory=list)
    blocked_by: list[str] = field(default_factory=list)


# Names, categories, grains, needed tables and fields, dimensions.
# Formulas are short readings of the queries named next to them.
KPIS = [
    Kpi("ecommerce", 1, "Average Order Value (AOV)", "Revenue", "monthly",
        "avg(order_total) by month, last 12 months", "ecommerce.average_order_value",
        ["orders"], ["order_total", "order_id", "order_date"], ["channel", "region", "segment"]),
    Kpi("ecommerce", 2, "Customer Lifetime Value (LTV)", "Revenue", "per_customer",
        "sum(order_total) by customer", "ecommerce.customer_lifetime_value",
        ["orders", "customers"], ["customer_id", "order_total", "order_id"],
        ["segment", "acquisition_channel", "cohort"]),
    Kpi("ecommerce", 3, "Conversion Rate", "Acquisition", "weekly",
        "distinct orders / distinct customers by week", "ecommerce.conversion_rate",
        ["orders"], ["order_id", "customer_id", "order_date"],
        ["channel", "device_type", "landing_page"]),
    Kpi("ecommerce", 4, "Cart Abandonment Rate", "Acquisition", "daily",
        "1 - distinct orders from carts / distinct carts", "ecommerce.cart_abandonment",
        ["cart"], ["cart_id"], ["device_type", "payment_method"]),
    Kpi("ecommerce", 5, "Revenue Growth Rate", "Revenue", "monthly",
        "change of sum(order_total) to the month before", "ecommerce.revenue_growth",
        ["orders"], ["order_total", "order_date"], ["product_category", "region"]),
    Kpi("ecommerce", 6, "Customer Retention Rate", "Retention", "monthly",
        "customers ordering 30 days after their first order / customers",
        "ecommerce.retention_rate", ["orders", "customers"], ["customer_id", "order_date"],
        ["segment", "cohort"]),
    Kpi("ecommerce", 7, "Average Items Per Order", "Product", "monthly",
        "avg(items of an order) by month", "ecommerce.items_per_order",
        ["orders", "order_items"], ["order_id"], ["product_category"]),
    Kpi("saas", 1, "Monthly Recurring Revenue (MRR)", "Revenue", "monthly",
        "sum(mrr) of active subscriptions by month", "saas.recurring_revenue",
        ["subscriptions"], ["mrr", "subscription_id", "status"], ["plan_id", "segment", "region"]),
    Kpi("saas", 2, "Churn Rate", "Retention", "monthly",
        "cancelled since last month / active before this month", "saas.churn_rate",
        ["subscriptions"], ["subscription_id", "status"], ["plan_id", "cancellation_reason"]),
    Kpi("saas", 3, "Customer Acquisition Cost (CAC)", "Acquisition", "monthly",
        "sum(marketing_spend) / distinct users by month", "saas.acquisition_cost",
        ["users"], ["user_id"], ["channel", "campaign"], blocked_by=["campaigns"]),
    Kpi("saas", 4, "Net Revenue Retention (NRR)", "Revenue", "monthly",
        "active mrr before this month / before last month", "saas.net_revenue_retention",
        ["subscriptions"], ["mrr", "status"], ["plan_id", "segment"]),
    Kpi("saas", 5, "Trial-to-Paid Conversion Rate", "Acquisition", "monthly",
        "distinct active / distinct trial subscriptions", "saas.trial_conversion",
        ["subscriptions"], ["subscription_id", "status"], ["plan_id", "source"]),
    Kpi("saas", 6, "Average Revenue Per User (ARPU)", "Revenue", "monthly",
        "sum(mrr) / distinct users by month", "saas.revenue_per_user",
        ["subscriptions"], ["mrr", "user_id"], ["plan_id", "segment"]),
    Kpi("saas", 7, "LTV:CAC Ratio", "Unit Economics", "quarterly",
        "avg over users of sum(amount)", "saas.average_lifetime_value",
        ["invoices", "users"], ["user_id"], ["plan_id", "channel"], blocked_by=["campaigns"]),
    Kpi("iot", 1, "Device Health Score", "Operations", "daily",
        "avg(battery band), last 7 days", "iot.device_health",
        ["telemetry"], ["device_id"], ["model", "location"], any_of=["device", "device_id"]),
    Kpi("iot", 2, "Battery Performance Index", "Maintenance", "daily",
        "avg, min and low counts of battery, last 7 days", "iot.battery_index",
        ["telemetry"], ["battery"], ["device_id", "model"],
        any_of=["battery", "batterypercentage", "battery_level", "battery_percent"]),
    Kpi("iot", 3, "Device Uptime & Connectivity", "Operations", "hourly",
        "distinct devices by time of last report", "iot.uptime",
        ["telemetry"], ["device_id", "timestamp"], ["model", "location"],
        any_of=["last_report_time", "last_seen", "timestamp", "updated_at"]),
    Kpi("iot", 4, "Report Frequency & Data Quality", "Data Quality", "daily",
        "reports per day by device", "iot.report_frequency",
        ["telemetry"], ["device_id", "timestamp"], ["device_id"],
        any_of=["sequence_no", "number_of_reports", "report_count"]),
    Kpi("iot", 5, "Voltage Stability & Anomalies", "Maintenance", "daily",
        "readings with |z(voltage)| > 2", "iot.voltage_anomalies",
        ["telemetry"], ["voltage"], ["device_id"],
        any_of=["voltage", "battery_voltage", "batteryvoltage"]),
    Kpi("iot", 6, "Fleet Coverage & Deployment", "Operations", "weekly",
        "distinct devices, first and last activity", "iot.fleet_coverage",
        ["telemetry"], ["device_id"], ["model", "location"], any_of=["device", "device_id"]),
    Kpi("iot", 7, "Critical Alert Rate", "Alerts", "daily",
        "critical readings, last 24 hours", "iot.critical_alerts",
        ["telemetry"], ["battery", "voltage"], ["device_id", "alert_type"],
        any_of=["battery", "voltage"]),
    Kpi("marketing", 1, "Cost Per Lead (CPL)", "Acquisition", "monthly",
        "sum(spend) / distinct leads by month", "marketing.cost_per_lead",
        ["leads", "campaigns"], ["lead_id", "campaign_id"], ["channel", "campaign", "region"]),
    Kpi("marketing", 2, "Lead-to-Customer Conversion Rate", "Conversion", "monthly",
        "distinct converted leads / distinct leads", "marketing.lead_conversion",
        ["leads"], ["lead_id", "status"], ["source", "campaign", "segment"]),
    Kpi("marketing", 3, "Return on Ad Spend (ROAS)", "Revenue", "monthly",
        "sum(revenue) / sum(spend) by campaign", "marketing.return_on_spend",
        ["campaigns", "conversions"], ["campaign_id", "revenue", "spend"],
        ["channel", "campaign_type"]),
    Kpi("marketing", 4, "Click-Through Rate (CTR)", "Engagement", "daily",
        "sum(clicks) / sum(impressions) by campaign", "marketing.click_through",
        ["campaigns"], ["campaign_id"], ["channel", "ad_format", "audience"]),
    Kpi("marketing", 5, "Marketing Qualified Leads (MQL) Rate", "Quality", "monthly",
        "distinct qualified leads / distinct leads by month", "marketing.qualified_rate",
        ["leads"], ["lead_id"], ["source", "campaign"]),
    Kpi("marketing", 6, "Customer Acquisition Cost (CAC)", "Acquisition", "monthly",
        "sum(spend) / distinct converted leads by month", "marketing.acquisition_cost",
        ["leads", "campaigns"], ["lead_id", "campaign_id", "status"], ["channel"]),
    Kpi("marketing", 7, "Email Open / Engagement Rate", "Engagement", "weekly",
        "opened / sent by campaign", "marketing.email_engagement",
        ["events"], ["campaign_id"], ["segment", "campaign"]),
    Kpi("general", 1, "Row Growth Rate", "Data Health", "weekly",
        "row count against the snapshot before", "health.row_growth", dimensions=["table_name"]),
    Kpi("general", 2, "Data Freshness Score", "Data Health", "daily",
        "days since the newest value", "health.freshness", dimensions=["table_name"]),
    Kpi("general", 3, "Completeness Index", "Data Quality", "per_run",
        "avg(1 - null rate) over columns", "health.completeness_index",
        dimensions=["table_name", "column_name"]),
    Kpi("general", 4, "Duplicate Record Rate", "Data Quality", "per_table",
        "repeated rows / rows", "health.duplicate_rate", dimensions=["table_name"]),
    Kpi("general", 5, "Schema Drift Score", "Governance", "per_run",
        "columns added, removed or retyped", "health.schema_drift",
        dimensions=["table_name"]),
]


def catalog(spark: SparkSession) -> DataFrame:
    """One row per KPI; its size is fixed."""
    ddl = (
        "number int, industry string, priority int, name string, category string, grain string, "
        "formula string, query string, required_tables array<string>, "
        "required_fields array<string>, dimensions array<string>, any_of array<string>, "
        "blocked_by array<string>"
    )
    rows = [
        (i, k.industry, k.priority, k.name, k.category, k.grain, k.formula, k.query, k.tables,
         k.fields, k.dimensions, k.any_of, k.blocked_by)
        for i, k in enumerate(KPIS)
    ]
    return literal_rows(spark, ddl, rows)


def signals(spark: SparkSession) -> DataFrame:
    """(industry, kind, name): one row per signal; its size is fixed."""
    rows = [
        (industry, kind, name)
        for industry, kinds in SIGNALS.items()
        for kind, names in kinds.items()
        for name in names
    ]
    return literal_rows(spark, "industry string, kind string, name string", rows)
