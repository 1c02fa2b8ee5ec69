import math

import pytest

from assay.llm.mixing import copies, mixed, op6_mixing, targets

from .helpers import SCHEMA, documents, odd


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, free = {}, share * sum(sizes.values()), list(names)
    while free:
        rate = left / math.fsum(weight[s] for s in free)
        above = [s for s in free if rate * weight[s] > most * sizes[s]]
        if not above:
            return out | {s: rate * weight[s] for s in free}
        for s in above:
            out[s] = most * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 100, "b": 100, "c": 100},
        {"b": 1000, "a": 10, None: 50, "": 7, "é": 900, "z": 1},
        {"a": 5},
        {"a": 0, "b": 0},
        {"a": 0, "b": 12, "c": 90_000, "d": 3},
    ],
)
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_words_come_near_targets_and_reruns_agree(spark):
    texts = [" ".join(["w"] * (1 + i * 7 % 23)) for i in range(900)]
    sources = ["big" if i % 3 else f"s{i % 4}" for i in range(900)]
    docs = documents(spark, texts, sources)
    out = copies(docs, block=50).select("record.doc_id", "record.source", "size", "source_size", "target", "copies", "taken")
    rows = out.collect()
    assert len(rows) == 900 and all(0 <= r.copies <= 2 and r.taken == r.copies * r["size"] for r in rows)
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want = plain_targets(sizes)
    for s, n in sizes.items():
        taken = sum(r.taken for r in rows if r.source == s)
        assert abs(taken - want[s]) <= 12, s  # half of the longest text
        assert all(r.source_size == n and r.target == pytest.approx(want[s]) for r in rows if r.source == s)
    again = copies(docs.repartition(5), block=50).select("record.doc_id", "taken").collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in rows}
    assert {r.doc_id: r.taken for r in copies(docs, block=50, seed=1).select("record.doc_id", "taken").collect()} != {
        r.doc_id: r.taken for r in rows
    }


def test_odd_rows_and_the_mix(spark):
    docs = odd(spark, ["some more words"] * 20)
    out = copies(docs)
    assert out.count() == docs.count() and out.filter("size = 0 AND taken > 0").count() == 0
    taken = mixed(docs)
    assert taken.columns == docs.columns and taken.count() == out.agg({"copies": "sum"}).first()[0]


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    assert copies(docs).count() == 0 and mixed(docs).count() == 0
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert op6_mixing(spark, str(tmp_path)).count() == 0


def test_reruns_agree_on_rows_that_differ_elsewhere(spark):
    """Rows equal in source, id and text, told apart by other columns alone."""
    docs = spark.range(60).selectExpr("7L AS doc_id", "'four words of text' AS text", "'s' AS source", "id AS other", "map('k', id) AS m")
    both = docs.unionAll(spark.range(40).selectExpr("id AS doc_id", "'more words' AS text", "'t' AS source", "id AS other", "map('k', id) AS m"))
    run = lambda n: sorted((r.record.source, r.record.other, r.copies) for r in copies(both.repartition(n)).collect())
    assert run(1) == run(7)
