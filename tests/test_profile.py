import math

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from assay.operators import profile as P
from assay.operators import quantiles as QT


def by_column(df):
    return {r["column_name"]: r for r in rows(df)}


@pytest.fixture(scope="module")
def customers(spark):
    return spark.createDataFrame(
        [
            (1, "a@x.org", "Ann", "Lee"),
            (2, "b@x.org", "Bo", "Kim"),
            (3, "c@x.org", "Cy", "Fox"),
            (4, "d@x.org", None, None),
        ],
        "customer_id int, email string, first_name string, last_name string",
    )


def test_recorded_statistics(customers):
    got = by_column(P.column_profile(customers, "customers"))["customer_id"]
    assert got["mean"] == 2.5
    assert math.isclose(got["std"], 1.2909944, rel_tol=1e-6)
    assert (got["q25"], got["median"], got["q75"]) == (1.75, 2.5, 3.25)
    assert (got["iqr_lower"], got["iqr_upper"]) == (-2.75, 7.75)
    assert got["iqr_outliers"] == 0 and got["unique_percent"] == 100.0


def test_completeness(customers):
    # two of four columns have one null in four rows
    score = P.completeness(P.column_profile(customers, "customers")).first()["completeness_score"]
    assert score == 87.5


def test_strings_and_top_values(customers):
    got = by_column(P.column_profile(customers, "customers"))
    assert got["email"]["has_email"] and not got["first_name"]["has_email"]
    assert got["email"]["email_count"] == 4
    assert got["first_name"]["null_count"] == 1
    assert [t["value"] for t in got["first_name"]["top_values"]] == ["Ann", "Bo", "Cy"]
    assert got["first_name"]["top_values"][0]["percent"] == 25.0


def test_types_nan_and_nulls(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (true, 1.5D, DATE '2024-01-01', array(1,2), CAST(2.50 AS DECIMAL(10,2)), CAST(NULL AS STRING)),"
        "(false, double('nan'), DATE '2024-01-03', array(1,2), NULL, NULL),"
        "(NULL, NULL, NULL, NULL, CAST(3.50 AS DECIMAL(10,2)), NULL) AS t(b, d, day, arr, price, nothing)"
    )
    got = by_column(P.column_profile(df, "t", as_of="2024-01-02"))
    assert [got[c]["type_category"] for c in ("b", "d", "day", "arr", "price", "nothing")] == [
        "boolean", "numeric", "datetime", "complex", "numeric", "string",
    ]
    assert got["d"]["null_count"] == 2 and got["d"]["unique_count"] == 1 and got["d"]["std"] == 0.0
    assert (got["b"]["true_count"], got["b"]["false_count"], got["b"]["true_percent"]) == (1, 1, 50.0)
    assert got["day"]["range_days"] == 2 and got["day"]["future_count"] == 1
    assert got["arr"]["unique_count"] == 1 and got["arr"]["avg_size"] == 2.0
    assert got["price"]["mean"] == 3.0 and got["price"]["median"] == 3.0
    assert got["nothing"]["null_percent"] == 100.0 and got["nothing"]["unique_count"] == 0


def test_empty_table_is_an_error_row(spark):
    df = spark.createDataFrame([], "id int, name string")
    got = rows(P.column_profile(df, "empty"))
    assert [r["error"] for r in got] == ["empty table"] * 2
    assert P.completeness(P.column_profile(df, "empty")).count() == 0


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "`free sulfur.dioxide` int, `a``b` string")
    got = by_column(P.column_profile(df, "wine"))
    assert got["free sulfur.dioxide"]["mean"] == 1.5 and got["a`b"]["unique_count"] == 2


def test_long_texts_are_counted_whole(spark):
    # equal for 300 characters, different at the end
    base = "x" * 300
    df = spark.createDataFrame([(base + "a",), (base + "b",), (base + "b",), ("short",)], "t string")
    got = by_column(P.column_profile(df, "texts"))["t"]
    assert got["unique_count"] == 3
    assert got["top_values"][0]["value"] == base + "b" and got["top_values"][0]["count"] == 2


def test_many_columns_and_tables(spark):
    wide = spark.range(20).select(*[(F.col("id") % (i + 1)).alias(f"c{i}") for i in range(120)])
    profile = P.profile_tables({"wide": wide, "other": spark.range(5).toDF("id")}, run_id="r")
    got = {(r["table_name"], r["column_name"]): r for r in rows(profile)}
    assert len(got) == 121 and {r["run_id"] for r in got.values()} == {"r"}
    assert all(got["wide", f"c{i}"]["unique_count"] == min(i + 1, 20) for i in range(120))


@pytest.mark.parametrize("shape", ["uniform", "hot", "ties", "tiny"])
def test_quantiles_match_a_sort(spark, shape):
    rng = np.random.default_rng(3)
    v = {
        "uniform": rng.normal(size=60_000),
        # one value holds a third of all rows
        "hot": np.concatenate([np.full(30_000, 0.25), rng.random(60_000)]),
        "ties": rng.integers(0, 7, 50_000).astype(float),
        "tiny": np.array([3.0, 1.0]),
    }[shape]
    values = spark.createDataFrame(pd.DataFrame({"cid": 0, "v": v}))
    freq = values.groupBy("cid", "v").agg(F.count("*").alias("n"))
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = QT.quantiles(freq, probs).first()
    want = np.quantile(v, probs)
    assert np.allclose([got[f"p{i}"] for i in range(len(probs))], want, rtol=1e-12, atol=1e-12)


def test_percents_and_top_counts_are_bounded(spark):
    df = spark.range(1000).selectExpr("id % 7 AS a", "CASE WHEN id % 3 = 0 THEN NULL ELSE id END AS b")
    for r in rows(P.column_profile(df, "t")):
        for name in ("null_percent", "unique_percent", "iqr_outlier_percent"):
            assert 0 <= r[name] <= 100
        assert sum(t["count"] for t in r["top_values"]) <= r["total_count"]


def test_sketched_profile_is_close(spark):
    df = spark.range(20_000).selectExpr("id AS a", "CAST(id % 50 AS STRING) AS s")
    got = by_column(P.column_profile(df, "t", exact=False))
    assert abs(got["a"]["median"] - 10_000) < 100
    assert abs(got["a"]["unique_count"] - 20_000) < 2_000 and abs(got["s"]["unique_count"] - 50) < 5


def test_a_column_is_sorted_by_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if there were more data
    freq = spark.range(200_000).selectExpr("id % 2 AS cid", "CAST(id AS DOUBLE) AS v", "1L AS n")
    blocks = {(r.cid, r.block): r["count"] for r in QT.ranged(freq.repartition(8)).groupBy("cid", "block").count().collect()}
    assert sum(cid == 0 for cid, _ in blocks) >= 4 and max(blocks.values()) < 60_000
    got = {r.cid: r.p0 for r in QT.quantiles(freq, [0.5]).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {0: 99_999.0, 1: 100_000.0}


def test_frequencies_are_shuffled_once_and_pruned(spark, monkeypatch):
    """One scan and one exchange of raw values for what is counted, one scan for statistics; all else reads stored counts."""
    frames, store = [], P.materialize

    def stored(df, label):
        frames.append((label, df))
        return store(df, label)

    monkeypatch.setattr(P, "materialize", stored)
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_quantity", "l_tax", "l_shipdate", "l_orderkey")
    profile = P.column_profile(df, "lineitem")
    profile.collect()
    of = lambda frame: frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    plans = {label: of(df) for label, df in frames}
    final = of(profile)
    for plan in (*plans.values(), final):
        assert "l_comment" not in plan and "CartesianProduct" not in plan and "PythonUDF" not in plan
    assert set(plans) == {"statistics", "frequencies", "top-values"} and "WindowGroupLimit" in plans["top-values"]
    scans = lambda text: text.count("lineitem.parquet")
    assert plans["frequencies"].count("Exchange") == 1 and scans(plans["top-values"]) == 0
    assert scans(plans["statistics"]) == 1 and scans(final) == 0
    assert sum(map(scans, plans.values())) <= 4


def test_long_texts_are_read_again_only_where_they_win(spark):
    texts = spark.range(50).selectExpr("repeat(CAST(id AS STRING), 200) AS long", "CAST(id % 3 AS STRING) AS short", "id")
    best = P._top(P.Lake({"t": texts}), P._frequencies(P.Lake({"t": texts})), 2)
    assert {len(v.value) for r in best.where("cid = 0").collect() for v in r.tops} == {200}
    short = texts.select("short", "id")
    plan = P._top(P.Lake({"t": short}), P._frequencies(P.Lake({"t": short})), 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (" not in plan and "Join" not in plan


def test_values_are_told_apart(spark):
    long = "x" * 300
    texts = spark.sql(f"SELECT '{long}' AS s UNION ALL SELECT concat('sha256:', sha2('{long}', 256))")
    got = P.column_profile(texts, "t", parts=(P.STATS, P.DISTINCT, P.TOP)).first()
    assert got["unique_count"] == 2 and {v["value"] for v in got["top_values"]} == {r["s"] for r in texts.collect()}
    at = "timestamp_ntz'2024-01-01 00:00:00.000001'"
    nested = spark.sql(f"SELECT struct({at} AS t) AS s UNION ALL SELECT struct({at} + INTERVAL 1 MICROSECOND AS t)")
    assert P.column_profile(nested, "t", parts=(P.STATS, P.DISTINCT)).first()["unique_count"] == 2


def test_decimals_tie_by_value(spark):
    df = spark.sql("SELECT CAST(v AS DECIMAL(10, 2)) AS d FROM VALUES (100), (9), (10) AS t(v)")
    got = P.column_profile(df, "t", parts=(P.STATS, P.TOP)).first()
    assert [v["value"] for v in got["top_values"]] == ["9.00", "10.00", "100.00"]


@pytest.mark.parametrize("shape", ["uniform", "tail", "hot", "few", "endless", "narrow"])
def test_quantiles_number_few_values(spark, monkeypatch, shape):
    numbered, ranged = [], QT.ranged
    monkeypatch.setattr(QT, "FEW", 0)
    monkeypatch.setattr(QT, "ranged", lambda freq: (numbered.append(freq.count()), ranged(freq))[1])
    rng = np.random.default_rng(5)
    v = {
        "uniform": rng.random(40_000),
        "tail": np.exp(rng.normal(size=40_000) * 4),
        "hot": np.concatenate([np.full(30_000, 0.25), rng.random(10_000), [1e300, -1e300]]),
        "few": rng.integers(-3, 4, 40_000).astype(float),
        "endless": np.concatenate([rng.normal(size=40_000), np.full(100, np.inf), np.full(50, -np.inf)]),
        "narrow": 1 + rng.integers(0, 9, 40_000) * 2.0**-52,
    }[shape]
    values = spark.createDataFrame(pd.DataFrame({"cid": 0, "v": v, "n": 1}))  # rows as they come, not counted before
    probs = [0.01, 0.25, 0.5, 0.75, 0.99]
    got = QT.quantiles(values, probs).first()
    assert [got[f"p{i}"] for i in range(len(probs))] == pytest.approx(list(np.quantile(v, probs)), rel=1e-12, abs=1e-300)
    assert sum(numbered) <= 2_000


def test_quantiles_of_several_columns(spark, monkeypatch):
    monkeypatch.setattr(QT, "FEW", 0)
    freq = spark.sql("SELECT CAST(id % 3 AS INT) AS cid, CAST(id % 3 * id AS DOUBLE) AS v, id % 5 + 1 AS n FROM range(9000)")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.cid: list(r[1:]) for r in QT.quantiles(freq, probs).collect()}
    data = freq.toPandas()
    for cid, own in data.groupby("cid"):
        assert got[cid] == pytest.approx(list(np.quantile(np.repeat(own.v, own.n), probs)), rel=1e-12)
    assert set(got) == {0, 1, 2} and QT.quantiles(freq.where("false"), probs).count() == 0


def test_outliers_alone_store_no_value_counts(spark, monkeypatch):
    labels, store = [], P.materialize
    monkeypatch.setattr(P, "materialize", lambda df, label: (labels.append(label), store(df, label))[1])
    df = spark.sql("SELECT IF(id % 100 = 0, 1000000D, CAST(id % 10 AS DOUBLE)) AS a, CAST(id AS STRING) AS s, IF(id = 0, NULL, id) AS b FROM range(1000)")
    got = by_column(P.column_profile(df, "t", parts=(P.OUTLIERS,)))
    assert labels == ["statistics"]
    assert (got["a"]["iqr_outliers"], got["a"]["zscore_outliers"], got["a"]["median"]) == (10, 10, 5.0)
    assert (got["b"]["iqr_outliers"], got["b"]["q25"], got["s"]["iqr_outliers"]) == (0, 250.5, None)


def test_few_values_are_sorted_for_the_top(spark):
    freq = spark.sql("""
        SELECT 0 AS cid, id AS lng, NULL AS dbl, NULL AS txt, 1L AS n FROM range(20000)
        UNION ALL SELECT 1, NULL, id / 2D, NULL, IF(id < 4, 9L, id % 2) FROM range(20000) WHERE id % 2 = 1 OR id < 4
        UNION ALL SELECT 2, NULL, NULL, CAST(id AS STRING), id % 100 + 1 FROM range(2000)
        UNION ALL SELECT 3, NULL, NULL, CAST(id AS STRING), 1L FROM range(300)
        UNION ALL SELECT 4, id, NULL, NULL, id FROM range(3)
        UNION ALL SELECT 5, NULL, CAST(floor(id / 3) AS DOUBLE), CAST(id AS STRING), 2L FROM range(2000)
    """).selectExpr("cid", "CAST(lng AS BIGINT) AS lng", "CAST(dbl AS DOUBLE) AS dbl", "CAST(txt AS STRING) AS txt", "n")
    left = P._leading(freq, 10)
    assert rows(P._best(left, 10), "cid", "rank") == rows(P._best(freq, 10), "cid", "rank")
    assert left.where("cid NOT IN (2, 3)").count() < 300 and left.where("cid = 2").count() <= 200


def test_numbers_do_not_pass_through_patterns(spark):
    values = ["", " ", "1", " +1.5e3 ", ",1,000", ".5", "-", "NaN", "Infinity", "inf", "x1", "+x", "\t7", "tel 555-123-4567", "5551234567", "555123456",
              "http://a", "https:/", "2001-1-1", "1/2001-01-1", " {}", "[", " <a> ", "é", " yes ", "Y", "no", "a,b"]
    df = spark.createDataFrame([(v, i, float(i)) for i, v in enumerate(values)], "s string, i int, d double")
    lake = P.Lake({"t": df})
    plan = P._statistics(lake, True, None)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("stack(") == 2 and "octet_length" in plan
    got = by_column(P.column_profile(df, "t", parts=(P.STATS, P.PATTERNS)))
    assert (got["s"]["number_count"], got["s"]["date_count"], got["s"]["boolean_count"]) == (10, 2, 4)
    assert (got["s"]["has_phone"], got["s"]["has_url"], got["s"]["nonblank_count"]) == (True, True, 26)
    assert (got["s"]["object_count"], got["s"]["array_count"], got["s"]["markup_count"]) == (1, 1, 1)
    assert (got["d"]["mean"], got["d"]["empty_count"], got["d"]["has_url"], got["s"]["mean"]) == (13.5, None, None, None)
