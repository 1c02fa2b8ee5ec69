import pytest
from conftest import rows

from assay.operators import duplicates as D
from assay.operators import profile as P
from assay.operators import quality as Q
from assay.operators import structure as T


def component_rows(tables, as_of="2024-01-10"):
    profile = P.profile_tables(tables, as_of=as_of, parts=(P.STATS, P.DISTINCT))
    return profile, Q.component_rows(profile, D.duplicates(tables), as_of)


def test_components(spark):
    df = spark.createDataFrame(
        [(1, -5.0, "2024-01-08"), (1, 5.0, "2024-01-01"), (None, 5.0, None), (4, 5.0, "2024-01-01")],
        "ref_id int, amount double, created string",
    )
    _, found = component_rows({"t": df})
    got = Q.scores(found).first().asDict()
    # nulls: 25, 0, 25 percent; a quarter of the amounts is negative
    assert got["missingness"] == 83.3
    assert got["validity"] == 91.7
    assert got["uniqueness"] == 100.0
    assert got["freshness"] == 97.8
    # key column 100 - 2 * 25, amounts 100 - 5 * 25 floored at 0
    assert got["integrity"] == 25.0
    checks = {(r["check"], r["column_name"]): r for r in rows(Q.checks(found))}
    assert checks["integrity", "ref_id"]["status"] == "error"
    assert checks["integrity", "ref_id"]["severity"] == "major"
    assert checks["freshness", "created"]["value"] == 2.0
    assert checks["validity", "amount"]["status"] == "warning"
    assert checks["validity", "amount"]["value"] == 75.0


def test_twenty_percent_repeats_score_zero(spark):
    df = spark.range(8).union(spark.createDataFrame([(0,), (0,)], "id bigint"))
    _, found = component_rows({"t": df})
    got = Q.scores(found).first()
    assert got["uniqueness"] == 0.0
    assert got["freshness"] == 100.0  # no date column


def test_future_dates_do_not_score_above_100(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2030-01-01' AS updated_at, 1 AS id")
    _, found = component_rows({"t": df})
    got = Q.scores(found).first()
    assert got["freshness"] == 100.0 and got["validity"] == 75.0


def test_all_null_columns_and_empty_tables(spark):
    tables = {
        "gone": spark.sql("SELECT CAST(NULL AS STRING) AS a, 1 AS b"),
        "empty": spark.createDataFrame([], "a int"),
    }
    profile, found = component_rows(tables)
    got = {r["table_name"]: r for r in rows(Q.scores(found))}
    assert list(got) == ["gone"] and got["gone"]["missingness"] == 50.0
    flags = {(r["column_name"], r["flag"]) for r in rows(Q.flags(profile, found))}
    assert ("a", "High Null Rate") in flags and ("b", "Constant Column") in flags


def test_aggregate_over_tables(spark):
    a = spark.range(10).selectExpr("CASE WHEN id = 0 THEN NULL ELSE id END AS x")
    b = spark.range(10).selectExpr("CASE WHEN id < 3 THEN NULL ELSE id END AS x")
    _, found = component_rows({"a": a, "b": b})
    got = Q.overall(found).first()
    # nulls count as one distinct row each: 2 of 10 rows of b repeat
    assert got["missingness"] == 80.0 and got["table_count"] == 2


def test_nulls_equal_nulls_in_repeats(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "a"), (None, "a"), (2, "b")], "i int, s string")
    got = D.duplicate_rows(df, "t").first()
    assert (got["row_count"], got["duplicate_rows"]) == (5, 2)


def test_structure_of_a_known_frame(spark):
    df = spark.range(100).selectExpr(
        "id", "concat('n', id) AS name", "CAST(20 + id % 50 AS INT) AS age", "'x' AS constant",
        "CAST(NULL AS DOUBLE) AS empty",
    )
    df = df.union(df.limit(5))
    profile = P.column_profile(df, "people", parts=(P.STATS, P.DISTINCT))
    got = T.table_overview(profile, D.duplicates({"people": df})).first()
    assert got["duplicate_rows"] == 5 and got["columns_fully_null"] == 1
    assert got["constant_columns"] == ["constant"] and got["suspicious_id_columns"] == ["id"]
    assert got["columns_with_nulls"] == 1


def test_repeated_rows_are_equal_rows(spark):
    from assay.operators.duplicates import duplicate_rows

    one = lambda df: rows(duplicate_rows(df, "t"))[0]["duplicate_rows"]
    at = "timestamp_ntz'2024-01-01 00:00:00.000001'"
    twins = spark.sql(f"SELECT {at} AS t, array(1) AS a UNION ALL SELECT {at} + INTERVAL 1 MICROSECOND, array(1)")
    assert one(twins) == 0 and one(twins.unionAll(twins)) == 2
    long = "x" * 300
    shas = spark.sql(f"SELECT '{long}' AS s UNION ALL SELECT concat('sha256:', sha2('{long}', 256))")
    assert one(shas) == 0 and one(shas.unionAll(shas.limit(1))) == 1
    zeros = spark.createDataFrame([(0.0, [0.0]), (-0.0, [-0.0])], "d double, a array<double>")
    assert one(zeros) == 1
    wide = spark.range(4).selectExpr(*[f"id % 2 AS c{i}" for i in range(70)], "map('a', id % 2) AS m")
    assert one(wide) == 2 and one(spark.range(0)) == 0


@pytest.mark.parametrize("few", [4_000_000, 0])
def test_repeated_rows_move_once_per_task(spark, monkeypatch, few):
    from assay.operators import duplicates as D

    monkeypatch.setattr(D, "FEW", few)
    hot = spark.range(0, 30_000, 1, 6).selectExpr("0L AS a", "'hot' AS b", "map('k', 1) AS m")
    twice = spark.range(0, 500, 1, 2).selectExpr("id + 1 AS a", "CAST(NULL AS STRING) AS b", "map('k', 2) AS m")
    once = spark.range(0, 60_000, 1, 6).selectExpr("id AS a", "'x' AS b", "map('k', 3) AS m")
    df = hot.unionAll(twice).unionAll(twice).unionAll(once)
    groups = D.repeated_groups(df.drop("m"))
    assert {(r.copies, r.groups) for r in groups.collect()} == {(1, 60_000), (2, 500), (30_000, 1)}
    got = D.duplicate_rows(df.drop("m"), "t").first()
    assert (got.row_count, got.duplicate_rows) == (91_000, 30_499)
    assert D.duplicate_rows(once.drop("m"), "t").first().duplicate_rows == 0
    assert D.duplicate_rows(once.drop("m").limit(0), "t").first().row_count == 0
