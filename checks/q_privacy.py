"""Personal data and masking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay import rules
from assay.operators import masking as M
from assay.operators import privacy as Y
from assay.operators import profile as P
from checks.lake import from_sql, over_profile, over_views, shaped, view
from checks.q_profile import prof, stored

QUERIES, ORACLE = {}, {}

PARTS = (P.STATS, P.PATTERNS)


def _any(words):
    return "|".join(words)


def _first_keyword() -> str:
    words = [w for tier in rules.PII_KEYWORDS.values() for w in tier]
    listed = ", ".join(f"'{w}'" for w in words)
    return f"list_filter([{listed}], lambda w: contains(lower(column_name), w))[1]"


_KNOWN = " ".join(
    f"WHEN pii_type = '{t}' THEN '{c}'" for t, c in rules.GDPR_TYPES.items()
)
_GUESS = " ".join(
    f"WHEN regexp_matches(lower(pii_type || ' ' || column_name), '{_any(words)}') THEN '{c}'"
    for words, c in rules.GDPR_GUESSES
)
_LABEL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.GDPR_LABELS.items())
_RISK = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.GDPR_RISK.items())
_RANK = "list_position(['none', 'low', 'medium', 'high', 'critical'], risk)"
_NAMED = "['none', 'low', 'medium', 'high', 'critical']"

PII_SQL = f"""
pn AS (
  SELECT table_name, column_name,
         CASE WHEN regexp_matches(lower(column_name), '{_any(rules.PII_KEYWORDS["high"])}') THEN 'high'
              WHEN regexp_matches(lower(column_name), '{_any(rules.PII_KEYWORDS["medium"])}') THEN 'medium'
              WHEN regexp_matches(lower(column_name), '{_any(rules.PII_KEYWORDS["low"])}') THEN 'low' END AS by_name,
         {_first_keyword()} AS keyword,
         CASE WHEN email_count * 2 > total_count - null_count THEN 'email'
              WHEN phone_count * 2 > total_count - null_count THEN 'phone'
              WHEN ssn_count * 2 > total_count - null_count THEN 'ssn'
              WHEN credit_card_count * 2 > total_count - null_count THEN 'credit_card'
              WHEN ip_address_count * 2 > total_count - null_count THEN 'ip_address' END AS pattern
  FROM p),
pii AS (
  SELECT table_name, column_name, coalesce(by_name, 'medium') AS sensitivity,
         CASE WHEN by_name IS NULL THEN 'value_pattern' WHEN pattern IS NULL THEN 'column_name'
              ELSE 'column_name_and_values' END AS detection_method,
         coalesce(pattern, keyword) AS pii_type
  FROM pn WHERE by_name IS NOT NULL OR pattern IS NOT NULL),
tr AS (
  SELECT t.table_name, count(column_name) AS pii_column_count,
         count(*) FILTER (sensitivity = 'high') AS high_count,
         count(*) FILTER (sensitivity = 'medium') AS medium_count,
         count(*) FILTER (sensitivity = 'low') AS low_count
  FROM (SELECT DISTINCT table_name FROM p) t LEFT JOIN pii USING (table_name) GROUP BY t.table_name),
trisk AS (
  SELECT *, CASE WHEN high_count > 0 OR medium_count > 3 THEN 'high' WHEN medium_count > 0 THEN 'medium'
                 WHEN pii_column_count > 0 THEN 'low' ELSE 'none' END AS risk FROM tr),
gc AS (
  SELECT table_name, column_name, pii_type,
         CASE {_KNOWN} {_GUESS} ELSE 'personal_identifier' END AS gdpr_category FROM pii),
gf AS (
  SELECT *, CASE gdpr_category {_LABEL} END AS label, CASE gdpr_category {_RISK} END AS risk FROM gc)
"""


def _sql(body: str) -> str:
    return over_profile(f"WITH {PII_SQL.strip()}\n{body}")


def _pii(spark, sf):
    return Y.pii_columns(prof(spark, sf, parts=PARTS))


def _risks(spark, sf):
    p = stored(spark, sf, parts=PARTS)
    return Y.table_risk(p, Y.pii_columns(p))


QUERIES["pii_columns"] = lambda s, d: shaped(_pii(s, d).drop("run_id"))
ORACLE["pii_columns"] = _sql("SELECT * FROM pii")
QUERIES["pii_patterns"] = lambda s, d: shaped(
    Y.pattern_findings(prof(s, d, parts=PARTS)).drop("run_id", "pattern_order")
)
ORACLE["pii_patterns"] = over_profile(
    " UNION ALL ".join(
        f"""SELECT table_name, column_name, '{k}' AS pattern,
                   round({k}_count / (total_count - null_count), 6) AS match_rate
            FROM p WHERE type_category = 'string' AND {k}_count * 2 > total_count - null_count"""
        for k in rules.PII_PATTERNS
    )
)
# phone numbers kept as integers, beside integers as long under a name that isn't personal
_PHONES = "SELECT c_custkey, 15550000000 + c_custkey AS phone, 15550000000 + c_nationkey AS batch_no FROM {customer}"


def _number_patterns(spark, sf):
    df = P.profile_tables({"calls": from_sql(spark, sf, _PHONES)}, parts=PARTS)
    return shaped(Y.pattern_findings(df).drop("run_id", "pattern_order"))


QUERIES["pii_patterns_numbers"] = _number_patterns
ORACLE["pii_patterns_numbers"] = f"""
SELECT 'calls' AS table_name, 'phone' AS column_name, 'phone' AS pattern,
       round(avg(CAST(regexp_matches(CAST(phone AS VARCHAR), '^1?[0-9]{{10,15}}$') AS INT)), 6) AS match_rate
FROM ({_PHONES.format(customer="customer")})"""
QUERIES["pii_risk"] = lambda s, d: shaped(_risks(s, d).drop("run_id"))
ORACLE["pii_risk"] = _sql("SELECT * FROM trisk")
QUERIES["pii_summary"] = lambda s, d: shaped(Y.summary(_risks(s, d)).drop("run_id"))
ORACLE["pii_summary"] = _sql(
    f"""SELECT count(*) AS tables_scanned, count(*) FILTER (pii_column_count > 0) AS tables_with_pii,
               CAST(sum(pii_column_count) AS BIGINT) AS pii_columns, CAST(sum(high_count) AS BIGINT) AS high_count,
               CAST(sum(medium_count) AS BIGINT) AS medium_count, CAST(sum(low_count) AS BIGINT) AS low_count,
               {_NAMED}[max({_RANK})] AS risk FROM trisk"""
)
QUERIES["gdpr_findings"] = lambda s, d: shaped(Y.gdpr_findings(_pii(s, d)).drop("run_id"))
ORACLE["gdpr_findings"] = _sql("SELECT * FROM gf")
QUERIES["gdpr_risk"] = lambda s, d: shaped(Y.gdpr_risk(Y.gdpr_findings(_pii(s, d))).drop("run_id"))
GDPR_RISK_SQL = f"""SELECT count(*) AS findings, count(DISTINCT gdpr_category) AS categories,
       {_NAMED}[max({_RANK})] AS overall_risk,
       bool_or(gdpr_category = 'special_category') AS has_special_category,
       bool_or(gdpr_category = 'national_id') AS has_national_id,
       bool_or(gdpr_category = 'financial_data') AS has_financial_data FROM gf"""
ORACLE["gdpr_risk"] = _sql(GDPR_RISK_SQL)
QUERIES["gdpr_categories"] = lambda s, d: shaped(
    Y.gdpr_categories(Y.gdpr_findings(_pii(s, d))).drop("run_id")
)
ORACLE["gdpr_categories"] = _sql(
    """SELECT gdpr_category, any_value(label) AS label, any_value(risk) AS risk, count(*) AS column_count,
              count(DISTINCT table_name) AS table_count FROM gf GROUP BY gdpr_category"""
)


def _mask_tops(spark, sf):
    p = stored(spark, sf, parts=(P.STATS, P.TOP, P.PATTERNS))
    masked = Y.mask_top_values(p, Y.pii_columns(p))
    return shaped(P.exploded_top_values(masked).select("table_name", "column_name", "rank", "value", "count"))


QUERIES["mask_top_values"] = _mask_tops
ORACLE["mask_top_values"] = over_profile(
    f"""WITH {PII_SQL.strip()}
    SELECT tops.table_name, tops.column_name, rank,
           CASE WHEN pii.column_name IS NULL THEN value ELSE '***MASKED***' END AS value, count
    FROM tops LEFT JOIN pii ON tops.table_name = pii.table_name AND tops.column_name = pii.column_name""",
    tops=True,
)

# --- masking ------------------------------------------------------------------

_STRATEGY_SQL = {
    "redact": "CASE WHEN {x} IS NOT NULL THEN '***REDACTED***' END",
    "hash": "'HASH_' || left(sha256('pepper' || {x}), 16)",
    "partial": "CASE WHEN length({x}) <= 4 THEN '***' ELSE left({x}, 1) || repeat('*', length({x}) - 2) || right({x}, 1) END",
    "null": "CAST(NULL AS VARCHAR)",
    "truncate": "CASE WHEN length({x}) > 3 THEN left({x}, 3) || '***' WHEN {x} IS NOT NULL THEN '***' END",
    "fake": "CASE WHEN {x} IS NOT NULL THEN '***FAKE***' END",
}


def _strategy(name):
    def run(spark, sf):
        c = F.col
        mask = (lambda x: M.hashed(x, "pepper")) if name == "hash" else M.STRATEGIES[name]
        return shaped(
            view(spark, sf, "customers").select(
                "customer_id", mask(c("email")).alias("email"), mask(c("phone")).alias("phone"),
                mask(c("country_code")).alias("country_code"),
            )
        )

    QUERIES[f"mask_{name}"] = run
    sql = _STRATEGY_SQL[name]
    ORACLE[f"mask_{name}"] = over_views(
        f"""SELECT customer_id, {sql.format(x='email')} AS email, {sql.format(x='phone')} AS phone,
                   {sql.format(x='country_code')} AS country_code FROM v_customers""",
        ["customers"],
    )


for _name in _STRATEGY_SQL:
    _strategy(_name)


def _mask_frame(spark, sf):
    return shaped(M.mask(view(spark, sf, "customers"), salt="pepper"))


QUERIES["mask_dataframe"] = _mask_frame
ORACLE["mask_dataframe"] = over_views(
    f"""SELECT * REPLACE (round(balance, 6) AS balance, round(credit_limit, 6) AS credit_limit,
          {_STRATEGY_SQL['hash'].format(x='full_name')} AS full_name,
          {_STRATEGY_SQL['hash'].format(x='email')} AS email,
          {_STRATEGY_SQL['partial'].format(x='phone')} AS phone) FROM v_customers""",
    ["customers"],
)
