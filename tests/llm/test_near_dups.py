import random
from collections import defaultdict

import numpy as np
import pytest

from assay.llm import near_dups
from assay.llm.components import components
from assay.llm.near_dups import near_duplicates, op4_near_dups, without_near_duplicates

from .helpers import SCHEMA, documents, odd


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset(w)


def plain(rows, percent=80):
    """doc_id to component by comparing every two documents."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(x)] = root(y)
    groups = defaultdict(list)
    for x, (i, _) in enumerate(sets):
        groups[root(x)].append(i)
    return {i: min(g) for g in groups.values() for i in g}


def families(seed, groups, sizes, words=60):
    """Texts in groups of near copies, each with some words of the first replaced."""
    rng, out = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(400)]
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(rng.choice(sizes)):
            text = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
                text[rng.randrange(words)] = rng.choice(vocabulary)
            out.append(" ".join(text))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("leaf,block,depth", [(16, 128, 10), (2, 4, 3)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, leaf, block, depth):
    """Small limits send the same documents through branching, pivots and blocks."""
    monkeypatch.setattr(near_dups, "LEAF", leaf)
    monkeypatch.setattr(near_dups, "BLOCK", block)
    texts = families(1, 25, [1, 2, 3, 8]) + families(2, 1, [60])
    docs = documents(spark, texts)
    want = plain([(i, t) for i, t in enumerate(texts, 1)])
    got = {r.doc_id: r for r in near_duplicates(docs, depth=depth).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == want[i]) and r.n_shingles == len(shingle_set(texts[i - 1])) for i, r in got.items())


def test_the_threshold_is_met_exactly(spark):
    base = [f"a{i}" for i in range(10)]  # 9 shingles
    texts = [" ".join(base), " ".join(base[:-1]), " ".join(base[1:-1]), " ".join(base[:-2]), "x y", "Y X", "X  y"]
    got = {r.doc_id: r.component_id for r in near_duplicates(documents(spark, texts)).collect()}
    # 8 of 9; 7 of 8 with the second; 7 of 9 with the first alone
    assert got == plain(list(enumerate(texts, 1)))
    assert got[7] == 5 and got[6] == 6


def test_odd_rows(spark):
    docs = odd(spark, ["Word", "an ID is missing here", "", "twice the same row"])
    got = sorted(near_duplicates(docs).collect(), key=lambda r: (r.doc_id or 0, r.n_shingles))
    by = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got}
    assert by[1] == (0, 1, True) and by[2] == (0, 2, True) and by[3] == (0, 3, True) and by[9] == (0, 9, True)
    assert by[4] == (1, 4, True) and by[7] == (1, 4, False)
    assert by[8] == (4, 8, True) and by[None] == (4, 8, False)
    assert by[5][0] == 29_999 and by[6] == (3, 6, True) and by[10] == (3, 6, False)
    assert len(got) == 12


def test_one_row_of_each_group_stays(spark):
    docs = odd(spark, ["Word", "an ID is missing here", "", "twice the same row"])
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 6, 8, 9]


@pytest.mark.parametrize("similarity,depth", [(0.8, 8), (0.8, 10), (0.82, 10)])
def test_trees_are_independent(similarity, depth):
    """Of simulated pairs, each coordinate equal with this probability, 0.999 share a node of some tree at this depth."""
    rng, trees, pairs, met = np.random.default_rng(1), near_dups.TREES, 2000, 0
    width = len(near_dups.signature(np.arange(9, dtype=np.uint64)))
    for _ in range(10):
        a = rng.integers(0, 1 << 16, (pairs, width), dtype=np.uint16)
        b = np.where(rng.random((pairs, width)) < similarity, a, a ^ np.uint16(1))
        node, rows = np.repeat(near_dups._roots(trees), pairs), np.tile(np.arange(pairs), trees)
        for _ in range(depth):
            x, origin = near_dups._branch(node, a[rows], 0.8)
            y, _ = near_dups._branch(node, b[rows], 0.8)
            node, rows = x[x == y], rows[origin][x == y]
        met += len(np.unique(rows))
    assert met >= 0.999 * 10 * pairs


def test_marks_that_must_agree_follow_from_the_threshold():
    assert [near_dups.agree(x) for x in (0.5, 0.8, 0.9, 1.0)] == [23, 42, 50, 64]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(docs).count() == 0 and without_near_duplicates(docs).count() == 0


def test_long_chains_are_one_component(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 500), (7, 7)]
    got = {r.key: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {400: 400, 500: 400}


def test_query_against_all_pairs(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert {r.doc_id: r.component_id for r in op4_near_dups(spark, folder).collect()} == plain(rows)
