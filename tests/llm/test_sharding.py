import zlib
from collections import Counter

import pytest

from assay.llm.sharding import op2_sharding, write_shards
from assay.session import scratch_path

from .helpers import SCHEMA, odd


def test_rows_are_dealt_evenly_in_random_order(spark):
    docs = odd(spark, [f"text {i}" for i in range(93)])
    got = write_shards(docs, scratch_path(spark, "shards"), 4).collect()
    assert Counter(r.record for r in got) == Counter(docs.collect())
    counts = Counter(r.shard for r in got)
    assert sorted(counts) == [0, 1, 2, 3] and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    order = [r.record.doc_id or 0 for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    rising = sum(a < b for a, b in zip(order, order[1:], strict=False))
    assert 30 < rising < 70  # of 100


def test_reruns_agree_and_seeds_differ(spark):
    docs = odd(spark, [f"text {i}" for i in range(40)])
    run = lambda n, **kw: {
        (r.record.doc_id, r.record.text): (r.shard, r.slot)
        for r in write_shards(docs.repartition(n), scratch_path(spark, "shards"), 3, **kw).collect()
        if r.record.doc_id != 6
    }
    assert run(1) == run(5) != run(1, seed=1)


def test_many_buckets(spark):
    docs = odd(spark, [f"text {i}" for i in range(40)])
    got = write_shards(docs, scratch_path(spark, "shards"), 2, bucket_bytes=50_000).collect()
    assert Counter(r.shard for r in got) == {0: 24, 1: 24}


def test_fewer_rows_than_shards_and_none(spark):
    assert {r.slot for r in write_shards(odd(spark), scratch_path(spark, "shards"), 24).collect()} == {0}
    assert write_shards(spark.createDataFrame([], SCHEMA), scratch_path(spark, "shards"), 3).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = op2_sharding(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1


def test_null_texts(spark, tmp_path):
    odd(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.size, r.text_crc32) for r in op2_sharding(spark, str(tmp_path)).collect()}
    assert got[1] == got[2] == (8, 0)


@pytest.mark.parametrize("n", [1, 7, 24, 25])
def test_counts_for_any_number_of_rows(spark, n):
    docs = spark.range(n).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text")
    counts = Counter(r.shard for r in write_shards(docs, scratch_path(spark, "shards"), 7).collect())
    assert sum(counts.values()) == n and max(counts.values()) - min(counts.get(s, 0) for s in range(7)) <= 1
