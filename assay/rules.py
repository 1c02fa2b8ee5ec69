"""Keyword lists, patterns, weights and thresholds.

All of these must keep exactly these values for results to agree with the
diagnostics this package reproduces.
"""

from __future__ import annotations

# --- personal data -----------------------------------------------------------

# Name keywords by sensitivity; the first tier that matches wins.
PII_KEYWORDS = {
    "high": [
        "ssn", "social_security", "tax_id", "passport", "driver_license",
        "credit_card", "card_number", "cvv", "account_number", "routing",
        "password", "secret", "token", "api_key",
    ],
    "medium": [
        "email", "phone", "mobile", "telephone", "address", "street", "zip",
        "postal", "dob", "birth", "age", "salary", "income", "firstname",
        "lastname", "first_name", "last_name", "full_name",
    ],
    "low": [
        "name", "user", "customer", "client", "gender", "sex", "city", "state",
        "country", "ip_address",
    ],
}

# Whole-value patterns.
PII_PATTERNS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone": r"^\+?1?\d{10,15}$|^\(\d{3}\)\s?\d{3}-?\d{4}$",
    "ssn": r"^\d{3}-?\d{2}-?\d{4}$",
    "credit_card": r"^\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}$",
    "ip_address": r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$",
}

# The characters that count as blank at the ends of a value.
BLANKS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Lengths a value must have for the pattern to be able to match; checked before
# the pattern, so that long text never reaches it.
PII_PATTERN_LENGTHS = {
    "email": (6, None),
    "phone": (10, 17),
    "ssn": (9, 11),
    "credit_card": (16, 19),
    "ip_address": (7, 15),
}

# Personal-data type -> GDPR category.
GDPR_TYPES = {
    "email": "contact_data",
    "phone": "contact_data",
    "ip_address": "online_identifier",
    "ip": "online_identifier",
    "name": "personal_identifier",
    "first_name": "personal_identifier",
    "last_name": "personal_identifier",
    "full_name": "personal_identifier",
    "postcode": "location_data",
    "postal_code": "location_data",
    "zip_code": "location_data",
    "address": "location_data",
    "ssn": "national_id",
    "national_id": "national_id",
    "passport": "national_id",
    "credit_card": "financial_data",
    "iban": "financial_data",
    "bank_account": "financial_data",
    "health": "special_category",
    "medical": "special_category",
    "diagnosis": "special_category",
    "religion": "special_category",
    "ethnicity": "special_category",
    "political": "special_category",
    "biometric": "special_category",
    "date_of_birth": "personal_identifier",
    "dob": "personal_identifier",
    "age": "personal_identifier",
    "gender": "personal_identifier",
    "sex": "personal_identifier",
}

# Ordered guess for types the map above does not list.
GDPR_GUESSES = [
    (["email", "mail"], "contact_data"),
    (["phone", "tel", "mobile"], "contact_data"),
    (["ip", "mac_addr"], "online_identifier"),
    (["name", "person", "user"], "personal_identifier"),
    (["address", "city", "zip", "post", "country", "lat", "lon", "geo"], "location_data"),
    (["ssn", "passport", "national", "license", "licence"], "national_id"),
    (["card", "iban", "bank", "account", "payment"], "financial_data"),
    (
        ["health", "medical", "diagnosis", "religion", "ethnic", "biometric"],
        "special_category",
    ),
]
GDPR_DEFAULT = "personal_identifier"

# Category -> risk, and its label.
GDPR_RISK = {
    "contact_data": "medium",
    "online_identifier": "medium",
    "location_data": "medium",
    "personal_identifier": "high",
    "national_id": "critical",
    "financial_data": "critical",
    "special_category": "critical",
}
GDPR_LABELS = {
    "contact_data": "Contact Data",
    "online_identifier": "Online Identifiers",
    "personal_identifier": "Personal Identifiers",
    "location_data": "Location Data",
    "national_id": "National / Government IDs",
    "financial_data": "Financial Data",
    "special_category": "Special Category Data (Art. 9)",
}
RISK_ORDER = ["none", "low", "medium", "high", "critical"]

# Masking rules as (name pattern, strategy, priority).
MASK_RULES = [
    (r"(email|e_mail|email_address)", "hash", 10),
    (r"(password|passwd|secret|token|api_key)", "redact", 20),
    (r"(ssn|social_security|national_id|tax_id)", "redact", 20),
    (r"(credit_card|card_number|ccn|pan)", "redact", 20),
    (r"(phone|mobile|fax|tel)", "partial", 5),
    (r"(first_name|last_name|full_name|surname)", "hash", 5),
    (r"(address|street|zip|postal)", "truncate", 5),
    (r"(ip_address|ip_addr|remote_ip)", "hash", 5),
    (r"(date_of_birth|dob|birth_date)", "redact", 10),
]

# --- string content ----------------------------------------------------------

# Patterns searched anywhere in a string, and words that read as booleans.
CONTAINS_PHONE = r"\d{3}[-\s]?\d{3}[-\s]?\d{4}"
CONTAINS_URL = r"http[s]?://"
CONTAINS_DATE = r"\d{4}[-/]\d{1,2}[-/]\d{1,2}"
# a value that reads as a floating point number once commas are gone
NUMBER = r"^\s*[+-]?(?:(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?|(?i:nan|inf|infinity))\s*$"
# what such a value can begin with
NUMBER_STARTS = " \t\n\x0b\x0c\r+-.,0123456789nNiI"
BOOLEAN_WORDS = ["true", "false", "yes", "no", "1", "0", "y", "n"]
BOOLEAN_WORDS_AND_LETTERS = [*BOOLEAN_WORDS, "t", "f"]

# --- quality -----------------------------------------------------------------

# Component weights in percent.
QUALITY_WEIGHTS = {
    "missingness": 30,
    "validity": 30,
    "uniqueness": 20,
    "freshness": 10,
    "integrity": 10,
}
# Words in the names of dates and of amounts.
DATE_NAME_WORDS = ["date", "time", "created", "updated"]
AMOUNT_NAME_WORDS = ["amount", "total", "quantity", "price", "count"]

# --- structure ---------------------------------------------------------------

# Parts of the names of ids, and words in the names of join columns.
ID_TOKENS = ["id", "uid", "uuid", "key", "pk", "index", "idx", "code", "ref"]
JOIN_NAME_WORDS = ["id", "key", "code"]

# --- column classes ----------------------------------------------------------

# Category -> keywords; the order of categories settles ties.
COLUMN_CLASSES = {
    "revenue": [
        "revenue", "amount", "price", "cost", "total", "sales", "payment", "fee", "charge",
        "income", "profit", "margin", "discount", "tax", "subtotal", "balance", "spend", "budget",
        "invoice", "billing", "mrr", "arr", "arpu", "ltv", "aov",
    ],
    "timestamp": [
        "date", "time", "timestamp", "created", "updated", "modified", "datetime", "day", "month",
        "year", "period", "start", "end", "open", "close", "expire", "deadline", "schedule", "born",
    ],
    "geographic": [
        "country", "city", "state", "region", "zip", "postal", "address", "lat", "latitude", "lon",
        "longitude", "geo", "location", "place", "province", "county", "district", "territory",
        "continent",
    ],
    "status_lifecycle": [
        "status", "state", "stage", "phase", "lifecycle", "category", "type", "class", "level",
        "tier", "grade", "rank", "flag", "active", "enabled", "approved", "completed", "pending",
    ],
    "device_identifier": [
        "device", "sensor", "machine", "equipment", "asset", "serial", "imei", "mac", "hardware",
        "firmware", "model", "manufacturer", "iot", "gateway", "node", "beacon", "tag",
    ],
    "customer_identifier": [
        "customer", "client", "user", "account", "member", "subscriber", "patient", "student",
        "employee", "contact", "person", "tenant", "buyer", "seller", "vendor", "partner",
    ],
}

# --- impact rules ------------------------------------------------------------

# Metric, comparison, threshold, severity, owner. The statements
# are our own wording.
IMPACT_RULES = [
    ("order_conversion_rate", "<", 2.0, "major", "growth_analytics",
     "drop-off between visit and order", "review funnel tracking and checkout"),
    ("mrr_churn_rate", ">", 5.0, "critical", "revops",
     "recurring revenue is shrinking", "analyse cohorts and cancellation reasons"),
    ("freshness_days", ">", 3.0, "major", "data_engineering",
     "decisions may rest on old data", "repair the load and alert on age"),
    ("duplicate_rate_percent", ">", 1.0, "major", "analytics_engineering",
     "repeated rows inflate figures", "define a key and enforce it"),
]
