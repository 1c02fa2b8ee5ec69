import itertools
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from assay.llm import language_model as lm

from .helpers import SCHEMA, odd


def chain(states, symbols, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return lm.Chain(
        norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((symbols, states)), 0)
    )


def by_paths(c, text):
    k = len(c.start)
    total, start, steps, emitted = 0.0, np.zeros(k), np.zeros((k, k)), np.zeros_like(c.emit)
    for path in itertools.product(range(k), repeat=len(text) + 1):
        p = c.start[path[0]]
        for a, b, x in zip(path, path[1:], text, strict=False):
            p *= c.step[a, b] * c.emit[x, b]
        total += p
        start[path[0]] += p
        for a, b, x in zip(path, path[1:], text, strict=False):
            steps[a, b] += p
            emitted[x, b] += p
    return total, start / total, steps / total, emitted / total


@pytest.mark.parametrize("segment", [2, 3, 128])
def test_likelihoods_and_counts_are_those_of_all_paths(monkeypatch, segment):
    monkeypatch.setattr(lm, "SEGMENT", segment)
    c, rng = chain(3, 5), np.random.default_rng(1)
    texts = [rng.integers(0, 5, n) for n in (1, 2, 3, 7, 6)]
    want = [by_paths(c, t) for t in texts]
    assert np.allclose(lm.Segments(texts).likelihoods(c), np.log([w[0] for w in want]))
    got = lm.Segments(texts).expected(c)
    for i in (1, 2, 3):
        assert np.allclose(got[i], sum(w[i] for w in want))


def test_the_chain_sums_to_one_and_training_raises_likelihood():
    rng = np.random.default_rng(2)
    texts = [np.append(rng.integers(3 * (i % 2), 3 * (i % 2) + 3, 30), 6) for i in range(40)]
    unigram = (np.bincount(np.concatenate(texts), minlength=7) + 0.5) / (40 * 31 + 3.5)
    c, seen = lm.first_chain(unigram, 2), []
    for _ in range(8):
        value, *sums = lm.Segments(texts).expected(c)
        seen.append(value)
        c = lm.next_chain(*sums, unigram)
    assert all(b >= a - 1 for a, b in zip(seen, seen[1:], strict=False)) and seen[-1] > seen[0] + 100
    pairs = [np.array(t) for t in itertools.product(range(7), repeat=2)]
    assert np.exp(lm.Segments(pairs).likelihoods(c)).sum() == pytest.approx(1)


def test_query_against_plain_counts(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    counts, ends = Counter(), 0
    for i, t in docs.items():
        if not held[i]:
            counts.update(t.encode().lower().split())
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    got = lm.op7_language_model(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        c = [counts[w] for w in docs[r.doc_id].encode().lower().split()] + [ends]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(c), sum(x > 0 for x in c), n)
        assert r.base_score == pytest.approx(sum(log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in c))
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # held-out texts are likelier to the model


def test_the_rare_class_and_odd_rows(spark):
    """With a head of two words most are rare; the model still has a probability for all texts of one word."""
    docs = odd(spark, ["a a a b b c", "a b", "d d new"]).selectExpr("doc_id", "text", "coalesce(doc_id = 9, false) AS held")
    got = {r.record.doc_id: r for r in lm.language_model_scores(docs, head=2, states=2, rounds=1).collect()}
    assert got[1].n_tokens == got[2].n_tokens == got[3].n_tokens == 1 and got[1].score == got[2].score < 0
    assert got[5].n_tokens == 30_001 and got[9].held and got[9].n_known == 1
    assert all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in got.values())


def test_no_rows_and_no_training_rows(spark):
    docs = spark.createDataFrame([], SCHEMA).selectExpr("doc_id", "text", "false AS held")
    assert lm.language_model_scores(docs).count() == 0
    docs = odd(spark).selectExpr("doc_id", "text", "true AS held")
    got = lm.language_model_scores(docs, states=2, rounds=1).collect()
    assert len(got) == 8 and {r.train_tokens for r in got} == {0} and {r.n_known for r in got} == {0}


def test_the_split_of_the_input_does_not_matter(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id", "text", "doc_id % 5 = 1 AS held")
    run = lambda n: {r.record.doc_id: r.score for r in lm.language_model_scores(docs.repartition(n), rounds=2).collect()}
    one, other = run(1), run(6)
    assert set(one) == set(other) and all(abs(one[i] - other[i]) < 1e-6 * abs(one[i]) for i in one)
