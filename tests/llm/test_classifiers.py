import zlib

import numpy as np
import pytest

from assay.llm import quality_classifier as qc
from assay.llm import toxicity as tox
from assay.llm.quality_rules import op10_quality_rules, ratio_weights, with_rules

from .helpers import SCHEMA, odd

SF = "/root/testdata/sf0.01"


def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def accuracy(rows, known, name):
    pairs = [(r.predicted, known[r.doc_id][name]) for r in rows if r.held_out and r.doc_id in known]
    return np.mean([a == b for a, b in pairs]), len(pairs)


def test_toxicity_of_rows_it_has_not_seen(spark):
    got, known = tox.op3_toxicity(spark, SF).collect(), labels(spark)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    share, n = accuracy(got, known, "toxic")
    assert len(got) == 1000 and n > 50 and share > 0.95


def test_factors_learn_what_weights_cannot():
    """Two terms are bad together and fine alone."""
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(1500):
        a, b = rng.random(2) < 0.5
        noise = rng.choice(np.arange(100, 130), 5, replace=False)
        rows.append(np.array([*noise, *([1] if a else []), *([2] if b else [])], np.int32))
        y.append(int(a and b))
    model = tox.trained(rows, np.array(y), epochs=40)
    places = model.lookup()
    ask = lambda *t: model.scores([(p := places[np.array(t, np.int32)])[p < len(model.terms)]])[0]
    assert ask(1, 2) > 0.5 > max(ask(1), ask(2), ask())


def test_toxicity_without_labels_and_odd_rows(spark):
    docs = odd(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = tox.scored(docs, tox.learned(docs, none))
    assert {r.toxicity for r in out.collect()} == {0.5} and out.count() == 8
    some = spark.createDataFrame([(4, 1), (5, 0), (6, None), (None, 1), (77, 0)], "doc_id long, toxic int")
    assert all(0 < r.toxicity < 1 for r in tox.scored(docs, tox.learned(docs, some)).collect())
    assert tox.scored(spark.createDataFrame([], SCHEMA), tox.trained([], np.empty(0))).count() == 0


def test_a_bounded_sample_is_enough(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = tox.learned(docs, spark.read.parquet(f"{SF}/labels.parquet"), sample=50)
    assert 0 < len(model.terms) <= tox.TERMS


def test_quality_of_rows_it_has_not_seen(spark):
    got = qc.op9_quality(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    share, n = accuracy(got, labels(spark), "quality")
    assert len(got) == 1000 and n > 80 and share > 0.95


def test_discriminant_is_the_textbook_one():
    rng, width = np.random.default_rng(0), len(qc.NAMES)
    x = [rng.normal(0, 1, (200, width)), rng.normal(0.3, 2, (300, width))]
    sums = {c: (len(a), a.sum(axis=0), a.T @ a) for c, a in enumerate(x)}
    model = qc.discriminant(sums, shrinkage=0.2)
    spread = [(len(a) - 1) * np.cov(a.T) for a in x]
    pooled = np.diag(np.diag(spread[0] + spread[1]) / 498)
    score = []
    for a, s in zip(x, spread, strict=True):
        cov, d = 0.8 * s / (len(a) - 1) + 0.2 * pooled, np.ones(width) - a.mean(axis=0)
        score.append(np.log(len(a) + 0.5) - 0.5 * (np.linalg.slogdet(cov)[1] + d @ np.linalg.solve(cov, d)))
    assert model.scores(np.ones((1, width)))[0] == pytest.approx(1 / (1 + np.exp(score[0] - score[1])))


def test_statistics_of_odd_texts():
    for t in (None, "", " \n\t", "x", "| | |", "a " * 100_000, "é\x00ß"):
        assert len(qc.statistics(t)) == len(qc.NAMES) and np.isfinite(qc.statistics(t)).all()


def test_quality_without_labels(spark):
    stats = qc.described(odd(spark))
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r.score for r in qc.scored(stats, qc.learned(stats, none)).collect()} == {0.5}


def plain_rules(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    places = {}
    for i in range(len(w) - 4):
        places.setdefault(tuple(w[i : i + 5]), []).append(i)
    repeated = len({j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + 5)})
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 10 or 100 * repeated > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated, failed


def test_rules_by_hand(spark):
    texts = [
        "a b c d e x a b c d e", "same line\nsame line\n\n  \nother", "# * $ % & | < >", "a " * 500,
        "1 2 3 4 5 1 2 3 4 5 1 2 3 4 5 9 8 7 6 é", "x y z w", "\n\n", "tab\tand\x0bmore\x0c words\r\n",
    ]
    docs = odd(spark, texts).select("doc_id", "text")
    for r in with_rules(docs).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == plain_rules(r.text), r.text


def test_ratios_tell_junk(spark):
    got, known = op10_quality_rules(spark, SF).collect(), labels(spark)
    assert len(got) == 1000 and not any(r.kept and r.base_failed for r in got)
    judged = [(r.kept, known[r.doc_id].quality) for r in got if r.doc_id in known and not r.base_failed]
    assert np.mean([bool(q) == k for k, q in judged]) > 0.97


def test_weights_are_log_ratios(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "c"), (None, "a"), (3, None)], "doc_id long, text string")
    good = spark.createDataFrame([(1,)], "doc_id long")
    w = ratio_weights(docs, good, buckets=64, prior=1.0)
    assert w.shape == (64,) and w.max() > 0 > w.min()
    assert not ratio_weights(docs, good.limit(0), buckets=64).any()


def test_a_repeated_labelled_id_is_learned_from_once(spark):
    from assay.llm import toxicity

    texts = [(i, f"you are a fool number {i}" if i % 2 else f"a kind word number {i}") for i in range(1, 200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic")
    hot = spark.range(5000).selectExpr("3L AS doc_id", "'you are a fool number 3' AS text")
    plain, repeated = toxicity.learned(docs, labels), toxicity.learned(docs.unionAll(hot), labels)
    assert (plain.terms == repeated.terms).all() and abs(plain.bias - repeated.bias) < 1e-9
    other = spark.range(500).selectExpr("3L AS doc_id", "concat('you are ', id) AS text")
    assert toxicity.learned(docs.unionAll(other), labels, sample=50) is not None
