import pytest
from conftest import rows
from pyspark.sql import functions as F

from assay.operators import profile as P
from assay.operators import relate as R

PARTS = (P.STATS, P.DISTINCT)


def shop(spark):
    return {
        "customers": spark.range(100).selectExpr("id AS customer_id", "concat('n', id) AS label"),
        "orders": spark.range(300).selectExpr("id AS order_id", "id % 100 AS customer_id"),
        "order_items": spark.range(900).selectExpr("id % 300 AS order_id", "id % 40 AS product_id"),
    }


def test_keys_and_candidates(spark):
    profile = P.profile_tables(shop(spark), parts=PARTS)
    keys = {(r["table_name"], r["column_name"]): r["confidence"] for r in rows(R.candidate_keys(profile))}
    assert keys["customers", "customer_id"] == "high" and keys["orders", "order_id"] == "high"
    got = {(r["table1"], r["table2"]): r for r in rows(R.join_candidates(profile))}
    assert set(got) == {("customers", "orders"), ("order_items", "orders")}
    assert got["customers", "orders"]["cardinality"] == "one-to-many"
    assert got["customers", "orders"]["reference_label"] == "many-to-one"
    assert got["order_items", "orders"]["cardinality"] == "many-to-one"
    assert {r["confidence"] for r in got.values()} == {"high"}


def test_paths_and_nodes(spark):
    edges = R.relationships(P.profile_tables(shop(spark), parts=PARTS))
    got = rows(R.join_paths(edges))
    assert [(r["start_table"], r["middle_table"], r["end_table"]) for r in got] == [
        ("customers", "orders", "order_items"), ("order_items", "orders", "customers"),
    ]
    assert {r["id"] for r in rows(R.erd_nodes(edges))} == set(shop(spark))


def test_table_limit(spark):
    profile = P.profile_tables(shop(spark), parts=PARTS)
    assert [r["table_name"] for r in rows(R.top_tables(profile, 2), "size_rank")] == ["order_items", "orders"]
    got = rows(R.join_candidates(profile, 2))
    assert [(r["table1"], r["table2"]) for r in got] == [("order_items", "orders")]


def test_fk_naming_both_directions(spark):
    tables = {
        "users": spark.range(3),
        "audits": spark.range(3).selectExpr("id", "id AS user_id"),
        "team": spark.range(3).selectExpr("id", "id AS audits_id"),
    }
    got = {(r["table1"], r["column1"], r["table2"]) for r in rows(R.fk_naming(P.profile_tables(tables, parts=PARTS)))}
    assert got == {("audits", "user_id", "users"), ("team", "audits_id", "audits")}


def test_runs_are_kept_apart(spark):
    tables = shop(spark)
    a = P.profile_tables({"customers": tables["customers"]}, run_id="a", parts=PARTS)
    b = P.profile_tables({"orders": tables["orders"]}, run_id="b", parts=PARTS)
    assert R.join_candidates(a.unionAll(b)).count() == 0


def test_checks_on_data_with_a_hot_key(spark):
    # one key holds most rows, one is unknown, some are null
    child = spark.range(10_000).selectExpr(
        "CASE WHEN id % 10 < 7 THEN 1 WHEN id % 10 = 7 THEN NULL WHEN id = 9 THEN 777 ELSE id % 50 END AS k"
    )
    parent = spark.range(50).toDF("p")
    got = rows(R.fk_orphans(child, ["k"], parent, ["p"]))
    assert got == [{"k": 777, "row_count": 1}]
    share = R.value_overlap(child, "k", parent, "p").first()
    assert share["child_values"] == share["matched_values"] + 1 and share["is_included"]
    bad = {r["k"]: r for r in rows(R.pk_violations(child, ["k"]))}
    assert bad[None]["violation"] == "null key" and bad[None]["row_count"] == 1000
    assert bad[1]["violation"] == "repeated key" and 777 not in bad


def test_inclusion_over_a_lake(spark):
    tables = {
        "parents": spark.range(100).selectExpr("id AS pk", "CAST(id AS STRING) AS code", "id * 0.5D AS half"),
        "children": spark.range(500).selectExpr("CAST(id % 90 AS INT) AS parent", "IF(id % 9 = 0, NULL, CAST(id % 120 AS STRING)) AS said"),
        "others": spark.range(50).selectExpr("id + 1000 AS far", "array(id) AS nested", "true AS flag"),
    }
    got = {(r["child_table"], r["child_column"], r["parent_table"], r["parent_column"]): r for r in rows(R.inclusion_dependencies(tables))}
    assert set(got) == {
        ("children", "parent", "parents", "pk"), ("parents", "pk", "children", "parent"), ("children", "said", "parents", "code"),
        ("parents", "code", "children", "said"),
    }
    whole = got["children", "parent", "parents", "pk"]
    assert (whole["child_values"], whole["matched_values"], whole["is_included"]) == (90, 90, True)
    assert got["parents", "pk", "children", "parent"]["overlap_percent"] == 90.0
    assert R.inclusion_dependencies({"others": tables["others"]}).count() == 0
    assert R.inclusion_dependencies({"flags": tables["others"].select("flag")}).count() == 0


def test_classes_of_many_tables_stay_small(spark):
    tables = {f"t{i}": spark.range(20 + i).toDF("id") for i in range(12)}
    profile = P.profile_tables(tables, parts=PARTS)
    got = rows(R.join_classes(profile))
    assert len(got) == 12 and {(r["members"], r["keys"], r["confidence"]) for r in got} == {(12, 12, "high")}
    assert R.join_candidates(profile).count() == 66


def test_hubs_count_the_paths_that_are_listed(spark):
    edges = spark.createDataFrame(
        [(a, b, f"c{a}", f"c{b}", k) for a, b, k in [
            ("a", "m", "high"), ("b", "m", "high"), ("c", "m", "medium"), ("d", "m", "low"), ("a", "b", "low"), ("a", "m", "low"),
        ]], "table1 string, table2 string, column1 string, column2 string, confidence string",
    ).selectExpr("CAST(NULL AS STRING) AS run_id", "*")
    hubs = {r["middle_table"]: r for r in rows(R.path_hubs(edges))}
    listed = {}
    for r in rows(R.join_paths(edges)):
        listed.setdefault(r["middle_table"], []).append(r["confidence"])
    assert {m: r["paths"] for m, r in hubs.items()} == {m: len(x) for m, x in listed.items()}
    for m, x in listed.items():
        assert hubs[m]["sure_paths"] == x.count("high")
        assert hubs[m]["confidence"] == min(x, key=["high", "medium", "low"].index)


def test_inclusion_shuffles_a_value_and_a_mark(spark, monkeypatch):
    frames, store = [], R.materialize
    monkeypatch.setattr(R, "materialize", lambda df, label: (frames.append(df), store(df, label))[1])
    tables = {
        "a": spark.sql("SELECT id AS i, CAST(id AS DOUBLE) AS d, CAST(id AS STRING) AS s FROM range(100)"),
        "b": spark.sql("SELECT id AS i, IF(id = 0, -0.0D, CAST(id AS DOUBLE)) AS d, CAST(id AS STRING) AS s FROM range(90)"),
    }
    found = R.inclusion_dependencies(tables)
    got = {(r["child_table"], r["child_column"]): (r["child_values"], r["matched_values"]) for r in rows(found)}
    assert got == {("a", c): (100, 90 - (c == "d")) for c in "ids"} | {("b", c): (90, 90 - (c == "d")) for c in "ids"}
    of = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert len(frames) == 1 and "collect_set" not in of(frames[0]) and "bit_or" in of(frames[0])
    assert of(found).count("stack(") * 3 == of(frames[0]).count("stack(")  # only texts are compared again


@pytest.mark.parametrize("words", [8, 0])
def test_inclusion_of_many_columns(spark, monkeypatch, words):
    monkeypatch.setattr(R, "WORDS", words)
    wide = spark.range(20).select(*[(F.col("id") + (i % 2) * 100).alias(f"c{i}") for i in range(70)])
    got = {(r["child_column"], r["parent_column"]) for r in rows(R.inclusion_dependencies({"t": wide}))}
    assert got == {(f"c{i}", f"c{j}") for i in range(70) for j in range(70) if i != j and i % 2 == j % 2}
