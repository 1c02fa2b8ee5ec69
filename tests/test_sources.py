import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from assay.sinks import audit, runs
from assay.sources import files, inventory, jdbc, sampling
from checks import q_sources


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_csv_and_tsv(spark, tmp_path):
    users = files.read(spark, put(tmp_path, "users.csv", "id,name,email\n1,Ann,a@x.org\n2,Bo,b@x.org\n"))
    assert users.schema.simpleString() == "struct<id:int,name:string,email:string>" and users.count() == 2
    orders = files.read(spark, put(tmp_path, "orders.tsv", "order_id\tuser_id\ttotal\n1\t1\t9.5\n2\t1\t1.5\n3\t2\t3.0\n"))
    assert dict(orders.dtypes)["total"] == "double" and orders.count() == 3


def test_csv_dates_stay_text(spark, tmp_path):
    df = files.read(spark, put(tmp_path, "d.csv", "day,at\n2024-01-02,2024-01-02 03:04:05\n"))
    assert [t for _, t in df.dtypes] == ["string", "string"]
    assert rows(df) == [{"day": "2024-01-02", "at": "2024-01-02 03:04:05"}]


def test_awkward_csv(spark, tmp_path):
    assert files.read(spark, put(tmp_path, "header_only.csv", "id,name,value\n")).count() == 0
    mixed = files.read(spark, put(tmp_path, "mixed.csv", "id,value\n1,hello\n2,42\n3,true\n4,\n5,3.14\n"))
    assert dict(mixed.dtypes)["value"] == "string" and mixed.count() == 5
    city = files.read(spark, put(tmp_path, "unicode.csv", "name,city\n東京,大阪\nÅsa,Malmö\nИван,Москва\n"))
    assert {r["city"] for r in rows(city)} == {"大阪", "Malmö", "Москва"}
    ragged = files.read(spark, put(tmp_path, "ragged.csv", "a,b\n1,2\n3,4,5\n6,7\n"))
    assert ragged.count() == 3
    assert files.read(spark, put(tmp_path, "empty.csv", "")).columns == []


def test_json_documents_and_lines(spark, tmp_path):
    records = [{"a": 1, "b": "x"}, {"a": 2, "b": None}]
    doc = files.read(spark, put(tmp_path, "doc.json", json.dumps(records, indent=1)))
    lines = files.read(spark, put(tmp_path, "doc.jsonl", "\n".join(map(json.dumps, records))))
    assert rows(doc, "a") == rows(lines, "a") == records


def test_inventory_filters_and_sorts(spark, tmp_path):
    for name in ("b.csv", "a.parquet", "notes.txt", "c.JSON"):
        put(tmp_path, name, "x")
    got = rows(files.file_inventory(spark, str(tmp_path)))
    assert [r["name"] for r in got] == ["a", "b", "c"] and got[1]["asset_type"] == "file"
    assert rows(files.file_inventory(spark, str(tmp_path / "b.csv")))[0]["identifier"].endswith(".b")


def test_jdbc_options():
    got = jdbc.options(
        "postgres", "db", "shop", 'odd"name', schema="public", split_column="id", bounds=(0, 100), partitions=8
    )
    assert got["dbtable"] == '"public"."odd""name"' and got["url"] == "jdbc:postgresql://db:5432/shop"
    assert got["numPartitions"] == "8" and got["pushDownTableSample"] == "true"
    assert jdbc.options("mysql", "db", "shop", "t")["dbtable"] == "`t`"
    with pytest.raises(ValueError):
        jdbc.options("mysql", "db", "shop", "t", split_column="id")


def test_sampling_plan(spark):
    counts = spark.createDataFrame([("a", 50), ("b", 500_000), ("c", 20_000_000), ("d", 90_000_000)], "table_name string, row_count bigint")
    got = {r["table_name"]: (r["method"], r["rate"], r["expected_rows"]) for r in rows(sampling.sampling_plan(counts))}
    assert got["a"] == ("full", 1.0, 50) and got["b"] == ("sample", 0.1, 50_000)
    assert got["c"] == ("sample", 0.05, 1_000_000) and got["d"][2] == 1_000_000
    off = rows(sampling.sampling_plan(counts, enabled=False))
    assert {r["method"] for r in off} == {"full"}


def test_samples(spark):
    df = spark.range(10_000).selectExpr("id", "timestamp_ntz'2024-01-01' + make_dt_interval(CAST(id / 100 AS INT)) AS ts")
    kept = sampling.by_rate(df, F.col("id"), 10)
    assert 800 < kept.count() < 1200 and kept.exceptAll(sampling.by_rate(df, F.col("id"), 10)).count() == 0
    strata = sampling.stratified_by_date(df, "ts", ["id"], strata=4, per_stratum=7)
    assert {r["stratum"]: r["count"] for r in rows(strata.groupBy("stratum").count())} == {i: 7 for i in range(4)}
    assert sampling.extract(df, "full", 1.0, 5).count() == 10_000
    some = sampling.extract(df, "sample", 0.5, 100)
    assert some.count() == 100 and some.where("id > 5000").count() > 15  # from all of the table
    assert sampling.extract(df, "sample", 0.1, 100_000).count() == 1000


@pytest.mark.parametrize("n", [0, 1, 700, 39_999, 40_000, 50_000])
def test_exact_samples(spark, n):
    df = spark.range(40_000).selectExpr("id", "IF(id % 2 = 0, NULL, 'x') AS `odd.name`")
    kept = {r.id for r in sampling.exactly(df.repartition(3), n).collect()}
    assert len(kept) == min(n, 40_000) and kept == {r.id for r in sampling.exactly(df.repartition(7), n, seed=42).collect()}
    if n == 700:
        assert kept != {r.id for r in sampling.exactly(df, n, seed=1).collect()}


def test_exact_samples_of_equal_rows(spark):
    df = spark.range(30_000).selectExpr("IF(id < 20000, 0, id) AS v")
    assert [sampling.exactly(df, n).count() for n in (5, 15_000, 29_999)] == [5, 15_000, 29_999]


def test_csv_fields_hold_anything(spark, tmp_path):
    text = 'id,note,n\n1,"say ""hi"", ok",3\n2,"two\nlines",4\n3,"back\\slash",5\n4,\'single,6\n'
    got = rows(files.read(spark, put(tmp_path, "quoted.csv", text)), "id")
    assert [(r["id"], r["note"], r["n"]) for r in got] == [
        (1, 'say "hi", ok', 3), (2, "two\nlines", 4), (3, "back\\slash", 5), (4, "'single", 6),
    ]
    schema = "id int, note string, n int"
    lines = put(tmp_path, "lines.csv", text.replace("two\nlines", "one line"))
    assert files.read_csv(spark, lines, schema, multi_line=False).count() == 4
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_csv(spark, put(tmp_path, "broken.csv", text), schema, multi_line=False).collect()


def test_padded_run_ids_stay_text(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "name string, n int")
    for run in ("007", "7", "2024-01-02"):
        runs.save(df, str(tmp_path), "thing", run)
    assert [r["run_id"] for r in rows(runs.list_runs(spark, str(tmp_path), "thing"))] == ["007", "2024-01-02", "7"]
    for schema in (None, df.schema, "name string, n int"):
        assert runs.load(spark, str(tmp_path), "thing", schema, "007").count() == 1


def test_schema_and_freshness(spark):
    tables = {
        "t": spark.sql("SELECT 1 AS id, 'x' AS note, TIMESTAMP_NTZ '2024-01-02' AS at, CAST(NULL AS DOUBLE) AS v"),
        "s": spark.sql("SELECT '2024-03-04' AS day, 'q' AS c"),
        "n": spark.range(2),
    }
    got = {(r["table_name"], r["column_name"]): r for r in rows(inventory.schema_columns(tables))}
    assert got["t", "v"]["is_nullable"] and got["t", "v"]["sql_type"] == "numeric"
    assert got["t", "id"]["sql_type"] == "integer" and not got["t", "id"]["is_nullable"]
    fresh = {r["table_name"]: (r["column_name"], str(r["latest"])[:10]) for r in rows(inventory.asset_freshness(tables))}
    assert fresh == {"t": ("at", "2024-01-02"), "s": ("day", "2024-03-04"), "n": (None, "None")}


def test_freshness_without_dates(spark, tmp_path):
    put(tmp_path, "t.csv", "a,b\n1,12:30\n2,2024\n")
    table = spark.read.option("header", True).csv(str(tmp_path / "t.csv"))
    null_time = spark.sql("SELECT CAST(NULL AS TIMESTAMP_NTZ) AS at, '2024-03-04T05:06:07' AS said")
    got = {r["table_name"]: r for r in rows(inventory.asset_freshness({"t": table, "q": spark.range(2), "n": null_time}, files=True))}
    assert (got["t"]["basis"], got["t"]["column_name"]) == ("file", None) and got["t"]["latest"] is not None
    assert got["q"]["basis"] == "none" and got["n"]["column_name"] == "said" and str(got["n"]["latest"]) == "2024-03-04 05:06:07"


def test_run_store_and_audit(spark, tmp_path):
    root = str(tmp_path / "store")
    df = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, n int")
    runs.save_runs(df, root, "profile")
    runs.save(spark.createDataFrame([(3,)], "n int"), root, "profile", "r3")
    runs.save(spark.createDataFrame([(4,)], "n int"), root, "profile", "r3")
    assert [r["run_id"] for r in rows(runs.list_runs(spark, root, "profile"))] == ["r1", "r2", "r3"]
    assert [r["n"] for r in rows(runs.load(spark, root, "profile", run_id="r3"))] == [4]
    assert {(r["run_id"], r["artifact"]) for r in rows(runs.list_artifacts(spark, root))} == {
        ("r1", "profile"), ("r2", "profile"), ("r3", "profile"),
    }
    log = str(tmp_path / "audit")
    record = "SELECT TIMESTAMP_NTZ '2024-01-0{d}' AS timestamp, '{e}' AS event_type, 'me' AS actor, 't' AS resource, 'info' AS severity, map('k', 'v') AS details"
    for d, e in ((1, "read"), (2, "mask"), (3, "read")):
        audit.append(spark.sql(record.format(d=d, e=e)), log)
    (tmp_path / "audit" / "broken.json").write_text("{not json\n")
    got = audit.read_log(spark, log)
    assert got.count() == 3 and audit.tail(got, 1).first()["event_type"] == "read"
    assert {r["event_type"]: r["records"] for r in rows(audit.counts(got))} == {"read": 2, "mask": 1}


def test_json_documents_are_bounded_and_few(spark, tmp_path, monkeypatch):
    """Files grow with the records, not with the span of the keys, and no key makes a document large."""
    monkeypatch.setattr(q_sources, "scratch_path", lambda spark, label: f"{tmp_path}/{label}")
    orders = spark.range(0, 30_000, 1, 2).selectExpr(
        "IF(id < 15000, NULL, id * 1000) AS o_orderkey", "id % 7 AS o_custkey", "'O' AS o_orderstatus", "id * 0.5D AS o_totalprice",
        "timestamp_ntz'2001-01-01 00:00:00' AS o_orderdate", "'1-URGENT' AS o_orderpriority",
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    got = q_sources.QUERIES["src_json"](spark, str(tmp_path))
    assert got.agg({"o_totalprice": "sum", "o_orderkey": "count"}).first().asDict() == {
        "sum(o_totalprice)": sum(range(30_000)) / 2, "count(o_orderkey)": 15_000,
    }
    sizes = [len(json.loads(f.read_text())) for f in (tmp_path / "json").glob("part-*")]
    assert sum(sizes) == 30_000 and max(sizes) <= 10_000 and len(sizes) <= 5
