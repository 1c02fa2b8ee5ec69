import hashlib
import re

import pytest

from assay.llm.decontaminate import contamination, n_hit, op5_decontaminate, without_contaminated

from .helpers import SCHEMA, documents, odd

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(text, items, span=10):
    w, hit, ids = words(text), set(), set()
    for item, t in items:
        v = words(t)
        m = min(span, len(v))
        runs = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if v else set()
        for i in range(len(w) - m + 1):
            if m and tuple(w[i : i + m]) in runs:
                hit.update(range(i, i + m))
                ids.add(str(item))
    joined = ",".join(sorted(ids))
    return len(w), len(hit), len(ids), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)


ITEM = "one two three four five six seven eight nine ten eleven twelve"
TEXTS = [
    f"before {ITEM} after",
    "X " + " ".join(ITEM.upper().split()[:10]) + ", y",
    " ".join(ITEM.split()[:9]) + " other",
    "short ITEM here, and short item again",
    ITEM + " " + ITEM,
    "a " * 40,
    "Über, straße; one-two",
    " ".join(ITEM.split()[2:]) + " " + " ".join(ITEM.split()[:10]),
]
ITEMS = [(1, ITEM), (2, "short item"), (3, "a a a a a a a a a a a"), (4, None), (5, "?!"), (10, "short item"), (7, "ÜBER")]


def write(spark, folder, docs, items):
    docs.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))


def test_all_hits_and_no_others(spark, tmp_path):
    docs = odd(spark, TEXTS)
    write(spark, tmp_path, docs, ITEMS)
    want = sorted(((r.doc_id, *plain(r.text, ITEMS)) for r in docs.collect()), key=str)
    got = op5_decontaminate(spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=str) == want


@pytest.mark.parametrize("docs,items", [(0, 3), (3, 0)])
def test_empty_tables(spark, tmp_path, docs, items):
    rows = odd(spark, TEXTS[:docs]) if docs else spark.createDataFrame([], SCHEMA)
    write(spark, tmp_path, rows, ITEMS[:items])
    got = op5_decontaminate(spark, str(tmp_path)).collect()
    assert len(got) == rows.count() and not any(r.contaminated for r in got)


def test_clean_rows_stay(spark):
    docs = odd(spark, TEXTS)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = without_contaminated(docs, items)
    assert kept.columns == docs.columns
    want = [r.doc_id for r in docs.collect() if not plain(r.text, ITEMS)[4]]
    assert sorted(map(str, want)) == sorted(str(r.doc_id) for r in kept.collect())


def test_covered_words(spark):
    runs = [(0, 10), (3, 2), (3, 10), (20, 1), (20, 10)]
    df = spark.createDataFrame([(runs,)], "starts array<struct<s:int,length:int>>")
    assert df.select(n_hit(df.starts)).first()[0] == 23


def test_other_spans(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    hits = contamination(documents(spark, TEXTS), items, span=6, gram=3).collect()
    found = {r.id for r in hits}
    assert found == {i for i, t in enumerate(TEXTS, 1) if plain(t, ITEMS, 6)[4]}
