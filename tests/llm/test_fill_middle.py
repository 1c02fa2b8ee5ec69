import hashlib
import re

import numpy as np
import pytest

from assay.llm import fill_middle as fim

from .helpers import SCHEMA, documents, odd


def by_hand(doc_id, text):
    """The contract, character by character."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def check(spark, docs):
    from pyspark.sql import functions as F

    got = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == docs.count()
    for r in got:
        want = by_hand(r.record.doc_id, r.record.text)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == want
        assert r.back == (r.record.text or "")
    return got


def test_odd_rows_and_clashing_columns(spark):
    docs = odd(spark, ["<P>", "a<S", "<M", "M>x", "é", "日本語 text", "a\x00b\nc", "𝒳yz😀", "ab" * 70_000])
    docs = docs.selectExpr("*", "1 AS n", "'x' AS form", "'y' AS output", "2 AS cut", "3 AS h1", "'z' AS record")
    assert {r.form for r in check(spark, docs)} >= {"plain", "psm"}


def test_no_rows(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0


def test_all_forms_of_many_texts(spark):
    rng = np.random.default_rng(3)
    letters = list("abcXYZ  \n<>PSM@[`{éß日😀\x7f\x80")
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(3000)]
    got = check(spark, documents(spark, texts))
    assert {r.form for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("block", [1, 8, 1000])
def test_blocks_and_offsets_inside_a_buffer(monkeypatch, block):
    monkeypatch.setattr(fim, "BLOCK", block)
    texts = ["", "ab", "é", "", "a b", "日本", "x" * 30, ""]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    h = np.arange(8) * 7
    whole = fim.cuts(data, offsets, h, h[::-1])
    for s in fim._blocks(offsets):
        part = fim.cuts(data, offsets[s.start : s.stop + 1], h[s], h[::-1][s])
        assert all((w[s] == p).all() for w, p in zip(whole, part, strict=True))
    assert [len(re.findall(r"[A-Za-z]+|[^A-Za-z]", t)) for t in texts] == whole[0].tolist()
