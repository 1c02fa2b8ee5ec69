from conftest import rows
from pyspark.sql import functions as F

from assay.diagnose import diagnose, stored_profile
from assay.operators.structure import input_file_bytes
from assay.sinks import runs
from checks.lake import AS_OF, lake


def test_a_run_is_stored_masked_and_comparable(spark, tmp_path):
    root = str(tmp_path / "store")
    tables = lake(spark, "/root/testdata/sf0.001", ["orders", "customers", "order_items"])
    stored = diagnose(tables, root, "run-1", AS_OF, label="shop")
    report = runs.compare(stored["report_data"]).first()
    assert report["run_id"] == "run-1" and report["label"] == "shop"
    assert 0 <= report["total_score"] <= 100 and report["grade"] in ("green", "yellow", "red")
    assert report["total_duplicate_rows"] == 30 and report["kpis"] > 0
    assert {"correlations", "gdpr_categories", "class_summary", "missing_summary", "table_facts", "dataset_summary", "impact"} <= set(stored)
    assert stored["table_facts"].count() == 3 and stored["dataset_summary"].first()["total_tables"] == 3
    assert {r["metric"] for r in rows(stored["impact"])} <= {"freshness_days", "duplicate_rate_percent"}
    email = stored["profile"].where("column_name = 'email'").first()
    assert {t["value"] for t in email["top_values"]} == {"***MASKED***"}
    # nothing that was stored shows an address
    text = spark.read.option("recursiveFileLookup", True).text(root)
    assert text.where("value LIKE '%@example.com%'").count() == 0
    assert {r["artifact"] for r in rows(runs.list_artifacts(spark, root))} == set(stored)


def test_no_raw_value_is_written_on_the_way(spark, tmp_path, monkeypatch):
    scratch = tmp_path / "scratch"
    monkeypatch.setattr("assay.session.shared_dir", lambda _: str(scratch))
    tables = {"people": spark.range(20).selectExpr("id", "concat('user', id, '@example.com') AS email")}
    prof = stored_profile(tables, "007", "2024-01-01")
    assert len(prof.where("column_name = 'email'").first()["top_values"]) > 0
    folders = list(scratch.iterdir())
    assert folders
    for folder in folders:
        text = spark.read.parquet(str(folder)).select(F.to_json(F.struct("*")).alias("t"))
        assert text.where("t LIKE '%@example.com%'").count() == 0


def test_file_bytes(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    got = input_file_bytes(df).first()
    assert got["files"] == 1 and got["bytes"] > 1000


def test_a_run_without_findings(spark, tmp_path):
    """Nothing related, personal or due: empty artifacts load with their columns."""
    tables = {"t": spark.range(5).selectExpr("id AS n")}
    stored = diagnose(tables, str(tmp_path / "store"), "r", "2024-01-01")
    assert stored["relationships"].count() == 0 and "confidence" in stored["relationships"].columns
    assert runs.compare(stored["report_data"]).first()["quality"] == 100.0
    assert stored["profile"].first()["mean"] == 2.0
