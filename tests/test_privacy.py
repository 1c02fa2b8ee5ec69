from conftest import rows
from pyspark.sql import functions as F

from assay.operators import masking as M
from assay.operators import privacy as Y
from assay.operators import profile as P

FRAME = "user_id int, email string, contact string, notes string, revenue double"


def frame(spark):
    return spark.createDataFrame(
        [
            (1, "a@x.org", "5551234567", "call 10.0.0.1", 1.0),
            (2, "b@x.org", "5551234568", "none", 2.0),
            (3, None, "5551234569", "none", 3.0),
        ],
        FRAME,
    )


def test_names_and_values(spark):
    profile = P.column_profile(frame(spark), "t", parts=(P.STATS, P.PATTERNS, P.TOP))
    pii = Y.pii_columns(profile)
    got = {r["column_name"]: r for r in rows(pii)}
    assert set(got) == {"user_id", "email", "contact"}
    assert got["email"]["detection_method"] == "column_name_and_values"
    assert got["contact"]["pii_type"] == "phone" and got["contact"]["detection_method"] == "value_pattern"
    assert Y.table_risk(profile, pii).first()["risk"] == "medium"
    masked = {r["column_name"]: r for r in rows(Y.mask_top_values(profile, pii))}
    assert {t["value"] for t in masked["email"]["top_values"]} == {"***MASKED***"}
    assert masked["notes"]["top_values"][0]["value"] == "none"


def test_sensitivity_tiers(spark):
    names = ["credit_card_no", "home_address", "city", "page", "total"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(Y.name_sensitivity(F.col("n"))).collect()]
    # substrings count: "page" holds "age"
    assert got == ["high", "medium", "low", "medium", None]


def test_gdpr_categories(spark):
    pairs = [
        ("email", "e"), ("passport", "p"), ("token", "bank_ref"), ("religion", "r"), ("zip", "zip"),
        ("secret", "secret"), ("customer", "client_ip"),
    ]
    df = spark.createDataFrame(pairs, "t string, c string")
    got = [r[0] for r in df.select(Y.gdpr_category(F.col("t"), F.col("c"))).collect()]
    # "zip" holds "ip", which is asked first
    assert got == [
        "contact_data", "national_id", "financial_data", "special_category", "online_identifier",
        "personal_identifier", "online_identifier",
    ]


def test_strategies(spark):
    df = spark.createDataFrame([("123 Main Street",), ("abc",), ("abcd",), (None,)], "v string")
    pick = lambda e: [r[0] for r in df.select(e).collect()]
    c = F.col("v")
    assert pick(M.truncated(c)) == ["123***", "***", "abc***", None]
    assert pick(M.partial(c)) == ["1" + "*" * 13 + "t", "***", "***", None]
    assert pick(M.redact(c))[0] == "***REDACTED***" and pick(M.redact(c))[3] is None
    digest = pick(M.hashed(c, "s"))
    assert digest[0].startswith("HASH_") and len(digest[0]) == 21 and digest[3] is None
    assert pick(M.hashed(c, "other"))[0] != digest[0]


def test_mask_frame_picks_highest_priority():
    assert M.plan(["email_address", "API_Key", "Phone", "amount", "dob", "street"]) == {
        "email_address": "hash", "API_Key": "redact", "Phone": "partial", "dob": "redact",
        "street": "truncate",
    }


def test_mask_keeps_other_columns(spark):
    masked = M.mask(frame(spark))
    assert masked.columns == frame(spark).columns
    got = rows(masked, "user_id")
    assert got[0]["email"].startswith("HASH_") and got[2]["email"] is None and got[0]["revenue"] == 1.0
