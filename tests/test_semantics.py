import numpy as np
import pandas as pd
from conftest import rows
from pyspark.sql import functions as F

from assay.operators import hidden as H
from assay.operators import missing as X
from assay.operators import profile as P
from assay.operators import semantics as C


def test_classes(spark):
    df = spark.range(30).selectExpr(
        "id AS customer_id", "id * 1.5D AS order_total", "TIMESTAMP_NTZ '2024-01-01' AS created_at",
        "IF(id % 2 = 0, 'a', 'b') AS status", "-id AS net_amount", "id AS blurb", "id AS `Zip-Code`",
    )
    got = {r["column_name"]: r for r in rows(C.column_classes(P.column_profile(df, "t", parts=(P.STATS, P.DISTINCT))))}
    assert got["customer_id"]["category"] == "customer_identifier" and got["customer_id"]["confidence"] == 0.75
    assert got["order_total"]["category"] == "revenue" and got["order_total"]["confidence"] == 0.8
    assert got["created_at"]["confidence"] == 0.9 and got["status"]["confidence"] == 0.8
    assert got["net_amount"]["confidence"] == 0.6
    assert got["Zip-Code"]["category"] == "geographic"
    assert "blurb" not in got


def test_interesting_and_correlations(spark):
    df = spark.range(100).selectExpr(
        "id AS a", "id * 2 + id % 3 AS b", "IF(id = 0, 1000D, 0D) AS spike", "xxhash64(id) % 97 AS noise"
    )
    profile = P.column_profile(df, "t", parts=(P.STATS, P.TOP))
    got = {r["column_name"]: r for r in rows(C.interesting_columns(profile))}
    assert got["spike"]["reasons"] == "high_skew_right,high_variance"
    assert got["spike"]["interest_score"] == 0.6
    assert got["a"]["reasons"] == "bimodal_hint"
    pairs = rows(C.correlations(df, "t"))
    assert [(r["col_a"], r["col_b"], r["strength"]) for r in pairs] == [("a", "b", "very_strong")]


def test_correlations_leave_nulls_out_by_pair(spark):
    pdf = spark.range(50).selectExpr(
        "id AS a", "IF(id % 5 = 0, NULL, id * 1D) AS b", "IF(id % 7 = 0, double('nan'), -id * 1D) AS c", "1 AS k"
    )
    got = {(r["col_a"], r["col_b"]): r["r"] for r in rows(C.correlation_pairs(pdf))}
    assert round(got["a", "b"], 9) == 1.0 and round(got["b", "c"], 9) == -1.0 and len(got) == 6


def test_missing_strategy(spark):
    df = spark.range(1000).selectExpr(
        "id", "IF(id < 900, NULL, id) AS mostly", "IF(id < 900, NULL, id) AS price",
        "IF(id < 300, NULL, id * 1D) AS third", "IF(id < 300, NULL, pow(id / 100D, 9)) AS steep",
        "IF(id < 300, NULL, CAST(id % 3 AS STRING)) AS few", "IF(id < 300, NULL, CAST(id AS STRING)) AS many",
        "IF(id < 50, NULL, id) AS some", "IF(id < 5, NULL, id) AS rare",
    )
    profile = P.column_profile(df, "t", parts=(P.STATS, P.DISTINCT))
    got = {r["column_name"]: r for r in rows(X.missing_strategy(profile, C.column_classes(profile)))}
    pick = {k: (v["treatment_type"], v["treatment"]) for k, v in got.items()}
    assert pick["id"] == ("no_action", "none")
    assert pick["mostly"] == ("drop", "drop_column")
    assert pick["price"] == ("transform", "flag_and_default") and got["price"]["priority"] == "high"
    assert pick["third"] == ("impute", "impute_mean_and_flag")
    assert pick["steep"] == ("impute", "impute_median_and_flag")
    assert pick["few"] == ("impute", "impute_mode") and pick["many"] == ("transform", "flag_and_unknown")
    assert pick["some"] == ("impute", "impute_median") and pick["rare"] == ("drop", "drop_rows")


def test_apply_treatment(spark):
    df = spark.createDataFrame(
        [(1, 10.0, "a"), (2, None, "a"), (3, 30.0, None), (4, 50.0, "b")], "id int, v double, s string"
    )
    profile = P.column_profile(df, "t", parts=(P.STATS, P.QUANTILES))
    got = rows(X.apply_treatment(df, {"v": ["flag", "median"], "s": ["mode"]}, profile), "id")
    assert [r["v"] for r in got] == [10.0, 30.0, 30.0, 50.0]
    assert [r["v_is_missing"] for r in got] == [0, 1, 0, 0] and got[2]["s"] == "a"
    assert X.apply_treatment(df, {"v": ["drop_rows"]}).count() == 3


def hidden(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    screen = H.hidden_types(P.column_profile(df, "t"))
    found = screen.first()
    verdict = H.verdicts(screen).first()
    return set(found["signals"]), verdict["detected_type"] if verdict else None


def test_hidden_types(spark):
    assert hidden(spark, ['{"a": 1}', '{"b": 2}']) == ({"json"}, "json_object")
    assert hidden(spark, ["1,000", "2.5", "-3e4", " 7 "]) == ({"number"}, "numeric_as_string")
    assert hidden(spark, ["2024-01-02", "2024/3/4"]) == ({"date"}, "date_as_string")
    assert hidden(spark, ["yes", "No", "Y"])[1] == "boolean_as_string"
    assert hidden(spark, ["red", "green"] * 200)[1] == "categorical_enum"
    assert hidden(spark, ["Ann Lee", "Bo Kim", "Cy Fox"]) == (set(), None)
    assert hidden(spark, ["", "  ", None]) == (set(), None)
    assert hidden(spark, ["word " * 150, "text " * 150]) == ({"long"}, "free_text")
    assert "number" not in hidden(spark, ["1d", "2f", "0x1"])[0]


def test_correlations_of_blocks_and_tasks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = rng.normal(1e6, 1.0, (3000, 7))
    data[:, 1] = data[:, 0] * 2 + rng.normal(0, 0.1, 3000)
    data[:, 5] = 4.2
    data[rng.random(data.shape) < 0.2] = np.nan
    frame = pd.DataFrame(data, columns=[f"v.{i}" for i in range(7)])
    want = frame.corr(min_periods=1)
    df = spark.createDataFrame(frame).repartition(5).selectExpr("*", "'text' AS s", "IF(`v.0` IS NULL, 1D, 2D) AS rare")
    for block in (1024, 3):
        monkeypatch.setattr(C, "BLOCK", block)
        got = {(r["col_a"], r["col_b"]): r["r"] for r in rows(C.correlation_pairs(df))}
        assert len(got) == 28
        for (a, b), r in got.items():
            if a == "v.5" or b == "v.5" or (a, b) == ("v.0", "rare"):
                assert r is None  # one value only, at least beside the other column's values
            elif b != "rare":
                assert abs(r - want.loc[a, b]) < 1e-9
    plan = C.correlation_pairs(df.drop("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_infinite_values_have_no_correlation(spark):
    df = spark.range(9).selectExpr("IF(id = 3, double('inf'), id) AS a", "id AS b", "IF(id = 3, NULL, id) AS c")
    got = {(r["col_a"], r["col_b"]): r["r"] for r in rows(C.correlation_pairs(df))}
    assert np.isnan(got["a", "b"]) and round(got["a", "c"], 9) == 1.0


def test_treatment_reads_modes_of_all_types_at_once(spark):
    df = spark.sql(
        "SELECT * FROM VALUES (1, 2.50BD, DATE '2024-01-02', true, 'x', 1.5D), (1, 2.50BD, DATE '2024-01-02', true, 'y', NULL), "
        "(2, 1.00BD, DATE '2024-01-01', false, NULL, double('nan')), (NULL, NULL, NULL, NULL, NULL, 2.5D) AS t(i, d, day, b, s, m)"
    )
    long = "z" * 400
    df = df.withColumn("l", F.when(F.col("i") == 1, F.lit(long)))
    got = rows(X.apply_treatment(df, {c: ["mode"] for c in ("i", "d", "day", "b", "s", "l")} | {"m": ["mean"]}).where("m = 2.5"))[0]
    assert (got["i"], str(got["d"]), str(got["day"]), got["b"], got["s"], got["l"]) == (1, "2.50", "2024-01-02", True, "x", long)
    assert {r["m"] for r in rows(X.apply_treatment(df, {"m": ["mean"]}))} == {1.5, 2.0, 2.5}
    empty = rows(X.apply_treatment(df.where("false"), {"s": ["mode"], "m": ["mean"]}))
    nulls = rows(X.apply_treatment(df.selectExpr("CAST(NULL AS STRING) AS s"), {"s": ["mode"]}))
    assert empty == [] and {r["s"] for r in nulls} == {None}
