"""Column classes, interesting columns, correlations, missing data, readiness."""

from __future__ import annotations

from assay import rules
from assay.kpi import detect
from assay.operators import duplicates as D
from assay.operators import hidden as H
from assay.operators import missing as X
from assay.operators import privacy as Y
from assay.operators import profile as P
from assay.operators import readiness as Z
from assay.operators import relate as R
from assay.operators import semantics as C
from assay.operators import structure as T
from checks.lake import lake, over_profile, over_views, rounded, shaped, view
from checks.q_kpi import KPI_SQL
from checks.q_privacy import GDPR_RISK_SQL, PII_SQL
from checks.q_profile import prof, stored
from checks.q_quality import FLAGGED_SQL, OVERVIEW_TOTAL_SQL, VERDICT_SQL
from checks.q_relate import RELATE_SQL

QUERIES, ORACLE = {}, {}
BASE = (P.STATS, P.DISTINCT)


def _class_sql() -> str:
    boosts = {
        "revenue": "CASE WHEN type_category = 'numeric' AND coalesce(min_value, 0) >= 0 THEN 0.2 ELSE 0 END",
        "timestamp": "CASE WHEN data_type LIKE '%date%' OR data_type LIKE '%time%' THEN 0.3 ELSE 0 END",
        "geographic": "0",
        "status_lifecycle": "CASE WHEN type_category = 'string' AND unique_count BETWEEN 2 AND 20 THEN 0.2 ELSE 0 END",
        "device_identifier": "CASE WHEN unique_percent > 80 THEN 0.15 ELSE 0 END",
        "customer_identifier": "CASE WHEN unique_percent > 80 THEN 0.15 ELSE 0 END",
    }
    parts = []
    for i, (cls, words) in enumerate(rules.COLUMN_CLASSES.items()):
        listed = ", ".join(f"'{w}'" for w in words)
        long = "|".join(w for w in words if len(w) >= 3)
        parts.append(
            f"""SELECT table_name, column_name, {i} AS o, '{cls}' AS category,
                  round(CASE WHEN list_has_any(regexp_split_to_array(lower(column_name), '[_\\s]+'), [{listed}]) THEN 0.6
                       WHEN regexp_matches(lower(column_name), '{long}') THEN 0.4 ELSE 0 END + {boosts[cls]}, 2) AS score FROM p"""
        )
    return f"""
cs AS ({" UNION ALL ".join(parts)}),
cl AS (
  SELECT table_name, column_name, category, CAST(least(score, 1) AS DOUBLE) AS confidence,
         CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS confidence_label
  FROM cs WHERE score >= 0.35
  QUALIFY row_number() OVER (PARTITION BY table_name, column_name ORDER BY score DESC, o) = 1)
"""


CLASS_SQL = _class_sql()

QUERIES["column_classes"] = lambda s, d: shaped(
    C.column_classes(prof(s, d, parts=BASE)).drop("run_id")
)
ORACLE["column_classes"] = over_profile(f"WITH {CLASS_SQL.strip()} SELECT * FROM cl")
QUERIES["column_class_summary"] = lambda s, d: shaped(
    C.column_class_summary(C.column_classes(prof(s, d, parts=BASE))).drop("run_id")
)
ORACLE["column_class_summary"] = over_profile(
    f"""WITH {CLASS_SQL.strip()} SELECT category, count(*) AS column_count, count(DISTINCT table_name) AS table_count,
        round(avg(confidence), 4) AS mean_confidence FROM cl GROUP BY category"""
)


def _bound(spark, sf):
    p = stored(spark, sf, parts=BASE)
    wanted = {"revenue": ["amount", "price"], "timestamp": ["order_date"], "device": ["device_id", "event_id"]}
    return shaped(C.bind_columns(C.column_classes(p), p, wanted).drop("run_id"))


QUERIES["kpi_columns_bound"] = _bound
ORACLE["kpi_columns_bound"] = over_profile(
    f"""WITH {CLASS_SQL.strip()},
    want(role, pref, name) AS (VALUES ('revenue', 0, 'amount'), ('revenue', 1, 'price'), ('timestamp', 0, 'order_date'),
                                      ('device', 0, 'device_id'), ('device', 1, 'event_id')),
    hits AS (SELECT table_name, role, column_name, pref::DOUBLE AS cost FROM p JOIN want ON name = column_name
             UNION ALL SELECT table_name, category, column_name, 1000 - confidence FROM cl
             WHERE category IN ('revenue', 'timestamp', 'device'))
    SELECT table_name, role, column_name FROM hits
    QUALIFY row_number() OVER (PARTITION BY table_name, role ORDER BY cost, column_name) = 1"""
)

REASON_SQL = """
vr AS (SELECT table_name, column_name, 'high_variance' AS reason, abs(std / mean) AS value,
              CASE WHEN abs(std / mean) > 2 THEN 0.35 WHEN abs(std / mean) > 1 THEN 0.2 END AS weight
       FROM p WHERE mean <> 0),
tv AS (SELECT table_name, column_name, count(*) AS k, min(count) * 100.0 / sum(count) AS low,
              list(count) AS cs, sum(count) AS total FROM tops GROUP BY ALL),
rv AS (SELECT table_name, column_name, 'rare_events' AS reason,
              CASE WHEN low < 1 THEN len(list_filter(cs, lambda x: x * 100.0 / total < 1)) ELSE low END AS value,
              CASE WHEN low < 1 THEN 0.25 WHEN low < 5 THEN 0.15 END AS weight
       FROM tv WHERE k >= 3),
bv AS (SELECT table_name, column_name, 'bimodal_hint' AS reason, kurtosis AS value, CASE WHEN kurtosis < -1 THEN 0.3 END AS weight
       FROM p WHERE total_count - null_count >= 30),
sv AS (SELECT table_name, column_name,
              CASE WHEN abs(skewness) > 3 THEN 'high_skew_' ELSE 'moderate_skew_' END
                || CASE WHEN skewness > 0 THEN 'right' ELSE 'left' END AS reason, skewness AS value,
              CASE WHEN abs(skewness) > 3 THEN 0.25 WHEN abs(skewness) > 1.5 THEN 0.15 END AS weight FROM p),
reasons AS (SELECT * FROM vr WHERE weight IS NOT NULL UNION ALL SELECT * FROM rv WHERE weight IS NOT NULL
            UNION ALL SELECT * FROM bv WHERE weight IS NOT NULL UNION ALL SELECT * FROM sv WHERE weight IS NOT NULL)
"""


def _interest(key, fn, parts, cte):
    QUERIES[f"interesting_{key}"] = lambda s, d: shaped(fn(prof(s, d, parts=parts)).drop("run_id"), 4)
    ORACLE[f"interesting_{key}"] = over_profile(
        f"""WITH {REASON_SQL.strip()} SELECT table_name, column_name, reason, round(value::DOUBLE, 4) AS value,
            weight::DOUBLE AS weight FROM {cte} WHERE weight IS NOT NULL""",
        tops=True,
    )


_interest("variance", C.high_variance, (P.STATS,), "vr")
_interest("rare", C.rare_values, (P.STATS, P.TOP), "rv")
_interest("bimodal", C.bimodal, (P.STATS,), "bv")
_interest("skew", C.skewed, (P.STATS,), "sv")
QUERIES["interesting_columns"] = lambda s, d: shaped(
    C.interesting_columns(stored(s, d, parts=(P.STATS, P.TOP))).drop("run_id")
)
ORACLE["interesting_columns"] = over_profile(
    f"""WITH {REASON_SQL.strip()} SELECT table_name, column_name, string_agg(reason, ',' ORDER BY reason) AS reasons,
        round(least(sum(weight), 1), 2)::DOUBLE AS interest_score FROM reasons GROUP BY ALL""",
    tops=True,
)


def _correlations(spark, sf):
    p = stored(spark, sf, parts=BASE)
    classes = C.column_classes(p)
    out = None
    for name in ("activity", "customers", "order_items", "orders", "products"):
        part = C.correlations(view(spark, sf, name), name, classes)
        out = part if out is None else out.unionByName(part)
    return shaped(out)


def _pairs(names):
    from itertools import combinations

    from checks.lake import VIEWS

    parts = []
    for t in names:
        cols = [c for c, _, k in VIEWS[t][1] if k == "numeric"]
        parts += [
            f"SELECT '{t}' AS table_name, '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS r FROM v_{t}"
            for a, b in combinations(cols, 2)
        ]
    return " UNION ALL ".join(parts)


QUERIES["correlations"] = _correlations
ORACLE["correlations"] = over_profile(
    f"""WITH {CLASS_SQL.strip()}, pairs AS ({_pairs(("activity", "customers", "order_items", "orders", "products"))})
    SELECT table_name, col_a, col_b, round(r, 3) AS pearson_r,
           CASE WHEN abs(r) > 0.8 THEN 'very_strong' ELSE 'strong' END AS strength,
           EXISTS (SELECT 1 FROM cl WHERE cl.table_name = pairs.table_name AND category = 'revenue'
                   AND column_name IN (col_a, col_b)) AS involves_revenue
    FROM pairs WHERE abs(r) >= 0.6"""
)


def _all_pairs(spark, sf):
    return shaped(C.correlation_pairs(view(spark, sf, "order_items")))


QUERIES["correlation_pairs"] = _all_pairs
ORACLE["correlation_pairs"] = over_views(
    f"SELECT col_a, col_b, round(r, 6) AS r FROM ({_pairs(['order_items'])})", ["order_items"]
)

# --- missing data -------------------------------------------------------------

MISSING_SQL = """
ms AS (
  SELECT p.table_name, p.column_name, type_category, null_percent, skewness, unique_count, cl.column_name IS NOT NULL AS imp,
         type_category = 'numeric' AS num, type_category = 'string' AS txt
  FROM p LEFT JOIN cl ON p.table_name = cl.table_name AND p.column_name = cl.column_name),
mt AS (
  SELECT *, CASE WHEN null_percent = 0 THEN 'none' WHEN null_percent > 80 AND imp THEN 'flag_and_default'
       WHEN null_percent > 80 THEN 'drop_column'
       WHEN null_percent > 20 AND num AND abs(coalesce(skewness, 0)) > 1.5 THEN 'impute_median_and_flag'
       WHEN null_percent > 20 AND num THEN 'impute_mean_and_flag'
       WHEN null_percent > 20 AND txt AND unique_count <= 10 THEN 'impute_mode'
       WHEN null_percent > 20 AND txt THEN 'flag_and_unknown' WHEN null_percent > 20 THEN 'investigate'
       WHEN null_percent > 1 AND num THEN 'impute_median' WHEN null_percent > 1 AND txt THEN 'impute_mode'
       WHEN null_percent > 1 THEN 'drop_rows_or_default' ELSE 'drop_rows' END AS treatment FROM ms),
mk AS (
  SELECT table_name, column_name, type_category, null_percent, treatment,
         CASE treatment WHEN 'none' THEN 'no_action' WHEN 'flag_and_default' THEN 'transform' WHEN 'drop_column' THEN 'drop'
              WHEN 'flag_and_unknown' THEN 'transform' WHEN 'investigate' THEN 'flag' WHEN 'drop_rows' THEN 'drop'
              ELSE 'impute' END AS treatment_type,
         CASE WHEN treatment = 'none' THEN 'none' WHEN treatment = 'flag_and_default' THEN 'high'
              WHEN treatment = 'drop_column' OR null_percent <= 20 THEN 'low'
              WHEN num AND imp THEN 'high' ELSE 'medium' END AS priority FROM mt)
"""


def _strategy(spark, sf):
    p = stored(spark, sf, parts=BASE)
    return X.missing_strategy(p, C.column_classes(p))


QUERIES["missing_strategy"] = lambda s, d: shaped(_strategy(s, d).drop("run_id"))
ORACLE["missing_strategy"] = rounded(
    over_profile(f"WITH {CLASS_SQL.strip()}, {MISSING_SQL.strip()} SELECT * FROM mk"), ["null_percent"]
)
QUERIES["missing_summary"] = lambda s, d: shaped(X.missing_summary(_strategy(s, d)).drop("run_id"))
ORACLE["missing_summary"] = over_profile(
    f"""WITH {CLASS_SQL.strip()}, {MISSING_SQL.strip()}
    SELECT count(*) FILTER (null_percent > 0) AS columns_with_nulls,
           count(*) FILTER (treatment_type = 'drop') AS drop_count, count(*) FILTER (treatment_type = 'impute') AS impute_count,
           count(*) FILTER (treatment_type = 'transform') AS transform_count,
           count(*) FILTER (treatment_type = 'flag') AS flag_count,
           count(*) FILTER (treatment_type = 'no_action') AS no_action_count FROM mk"""
)


def _impute(spark, sf):
    orders = view(spark, sf, "orders")
    p = P.column_profile(orders, "orders", parts=(P.STATS, P.QUANTILES))
    plan = {
        "customer_id": ["flag", "median"],
        "cart_id": ["drop_rows"],
        "promo_code": ["unknown"],
        "order_total": ["mean"],
        "channel": ["drop_column"],
        "status": ["mode"],
    }
    return shaped(X.apply_treatment(orders, plan, p))


QUERIES["impute_apply"] = _impute
ORACLE["impute_apply"] = over_views(
    """SELECT order_id, round(coalesce(customer_id, (SELECT median(customer_id) FROM v_orders)), 6)::DOUBLE AS customer_id,
              (customer_id IS NULL)::INT AS customer_id_is_missing, round(order_total, 6) AS order_total, order_date,
              status, coalesce(promo_code, 'Unknown') AS promo_code, is_gift, cart_id
       FROM v_orders WHERE cart_id IS NOT NULL""",
    ["orders"],
)


def _impute_text(spark, sf):
    customers = view(spark, sf, "customers")
    plan = {"email": ["flag", "unknown"], "credit_limit": ["mean"], "signup_date": ["mode"]}
    return shaped(X.apply_treatment(customers, plan).select(
        "customer_id", "email", "email_is_missing", "credit_limit", "signup_date"
    ), 4)


QUERIES["impute_modes"] = _impute_text
ORACLE["impute_modes"] = over_views(
    """SELECT customer_id, coalesce(email, 'Unknown') AS email, (email IS NULL)::INT AS email_is_missing,
              round(coalesce(credit_limit, (SELECT avg(credit_limit) FROM v_customers)), 4) AS credit_limit,
              coalesce(signup_date, (SELECT signup_date FROM v_customers WHERE signup_date IS NOT NULL
                                     GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS signup_date
       FROM v_customers""",
    ["customers"],
)

# --- readiness ----------------------------------------------------------------


def readiness(spark, sf):
    p = stored(spark, sf, parts=(P.STATS, P.DISTINCT, P.TOP, P.PATTERNS))
    classes = C.column_classes(p)
    return Z.readiness(
        p,
        T.dataset_overview(p, D.duplicates(lake(spark, sf))),
        H.verdicts(H.hidden_types(p)),
        Y.gdpr_risk(Y.gdpr_findings(Y.pii_columns(p))),
        detect.recommend(p),
        classes,
        R.relationships(p),
    )


READINESS_SQL = f"""{PII_SQL.strip()}, {CLASS_SQL.strip()}, {RELATE_SQL.strip()}, {FLAGGED_SQL.strip()}, {VERDICT_SQL.strip()},
{KPI_SQL.strip()},
o AS ({OVERVIEW_TOTAL_SQL}), g AS ({GDPR_RISK_SQL}),
z1 AS (SELECT greatest(20 - CASE WHEN duplicate_percent > 20 THEN 6 WHEN duplicate_percent > 5 THEN 3 WHEN duplicate_percent > 0 THEN 1 ELSE 0 END
   - CASE WHEN constant_columns > 3 THEN 4 WHEN constant_columns > 0 THEN 2 ELSE 0 END
   - CASE WHEN columns_fully_null > 2 THEN 4 WHEN columns_fully_null > 0 THEN 2 ELSE 0 END
   - CASE WHEN suspicious_id_columns > 5 THEN 2 ELSE 0 END, 0) AS structure_quality FROM o),
z2 AS (SELECT greatest(20 - CASE WHEN a > 30 THEN 8 WHEN a > 15 THEN 5 WHEN a > 5 THEN 2 ELSE 0 END
   - CASE WHEN h > 5 THEN 6 WHEN h > 2 THEN 3 WHEN h > 0 THEN 1 ELSE 0 END - CASE WHEN m >= 99 THEN 3 ELSE 0 END, 0) AS null_health
   FROM (SELECT avg(null_percent) AS a, max(null_percent) AS m, count(*) FILTER (null_percent > 50) AS h FROM p)),
z3 AS (SELECT CAST(round_even(greatest(20 - least(3 * count(*) FILTER (severity = 'critical'), 10)
   - least(1.5 * count(*) FILTER (severity = 'warning'), 6), 0), 0) AS INT) AS type_consistency FROM verdict),
z4 AS (SELECT greatest(20 - CASE WHEN has_special_category THEN 8 WHEN overall_risk = 'critical' THEN 6 WHEN overall_risk = 'high' THEN 4
     WHEN overall_risk = 'medium' THEN 2 ELSE 0 END
   - CASE WHEN findings > 10 THEN 4 WHEN findings > 5 THEN 2 WHEN findings > 0 THEN 1 ELSE 0 END
   - CASE WHEN categories > 4 THEN 3 ELSE 0 END, 0) AS compliance_risk FROM g),
kn AS (SELECT least(count(*), 7) AS n FROM ready SEMI JOIN det USING (industry) WHERE is_ready),
z5 AS (SELECT least(5 + CASE WHEN n >= 5 THEN 5 WHEN n >= 2 THEN 3 WHEN n > 0 THEN 1 ELSE 0 END
   + CASE WHEN list_contains(cats, 'revenue') THEN 3 ELSE 0 END + CASE WHEN list_contains(cats, 'timestamp') THEN 2 ELSE 0 END
   + CASE WHEN list_contains(cats, 'customer_identifier') THEN 2 ELSE 0 END + CASE WHEN len(cats) >= 4 THEN 2 ELSE 0 END
   + CASE WHEN EXISTS (FROM jc) THEN 1 ELSE 0 END, 20) AS business_value
   FROM kn, (SELECT list(DISTINCT category) AS cats FROM cl)),
z AS (SELECT *, structure_quality + null_health + type_consistency + compliance_risk + business_value AS total_score
      FROM z1, z2, z3, z4, z5)
"""

QUERIES["readiness"] = lambda s, d: shaped(readiness(s, d).drop("run_id"))
ORACLE["readiness"] = over_profile(
    f"""WITH {READINESS_SQL.strip()} SELECT *, CASE WHEN total_score >= 70 THEN 'green' WHEN total_score >= 40 THEN 'yellow'
        ELSE 'red' END AS grade FROM z""",
    duplicates=True,
)
