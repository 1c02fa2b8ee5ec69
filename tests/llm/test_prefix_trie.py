import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from assay.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, conv long, d int, len string, p1 double"


def frame(spark, turns):
    return spark.createDataFrame([(*t, 5, 1, "x", 0.5) for t in turns], SCHEMA)


def rebuild(turns):
    """The contract, in dictionaries."""
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - (c - int(c / 5) * 5), [])[:h] + mine[h:]
    return out


def nodes(convs):
    members = defaultdict(list)
    for c, x in convs.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)

    def below(k):
        return [k, *(u for child in children[k] for u in below(child))]

    out = []
    for k, cs in members.items():
        tree = below(k)
        saved = sum((len(members[u]) - 1) * len(u[-1][1].encode()) for u in tree if u)
        ends = ",".join(map(str, sorted(c for c in cs if len(convs[c]) == len(k))))
        out.append((
            min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), len(children[k]),
            sum(not children[u] for u in tree), saved, hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def check(spark, turns, family=True):
    read = trie.numbered(frame(spark, turns).repartition(5))
    rows, convs = trie.rebuilt(*read) if family else trie.conversations(*read)
    got = sorted((tuple(r) for r in trie.prefix_trie(rows, convs).collect()), key=str)
    if family:
        assert got == nodes(rebuild(turns))
    return got


def random_turns(seed, n, words="ab"):
    rng = random.Random(seed)
    return [
        (c, t, rng.choice(["user", "bot", None]) if t else "user", rng.choice([*words, "", None]))
        for c in rng.sample(range(-20, 5 * n), n)
        for t in rng.sample(range(20), rng.randint(1, 12))
    ]


ODD = [
    (None, 0, "user", "no id"), (1, None, "user", "first"), (1, None, "user", "first"), (1, 3, None, None), (1, 3, "", ""),
    (2, 1, "user", "é" * 50_000), (7, 0, "user", "tie"), (7, 0, "bot", "tie"), (10**15, 5, "x", "y"),
]


def test_odd_rows(spark):
    check(spark, ODD)


def test_without_rows_and_without_turns(spark):
    assert check(spark, []) == []
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    assert check(spark, [(c, 0, "user", "gives way to nothing")])[0][:4] == (c, 0, None, 1)


@pytest.mark.parametrize("tight", [False, True])
def test_random_conversations(spark, monkeypatch, tight):
    if tight:  # long conversations in many runs, a full sketch, many copies of hot parents, short pieces of ids
        for name, value in {"RUN": 3, "CHUNK": 16, "MOST_CELLS": 16, "OFTEN": 2, "COPIES": 3, "IDS": 2}.items():
            monkeypatch.setattr(trie, name, value)
    check(spark, random_turns(4, 60))


def test_copies_of_one_conversation(spark):
    turns = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(3)]
    check(spark, [*turns, *[(1000, t, "user", f"t{t}") for t in range(60)]])


def test_conversations_as_they_are(spark):
    turns = [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "a"), (3, 0, "v", "a")]
    empty = hashlib.sha256(b"").hexdigest()
    end = lambda c: hashlib.sha256(str(c).encode()).hexdigest()
    assert check(spark, turns, family=False) == sorted([
        (1, 0, None, 3, 2, 2, 1, empty), (1, 1, 1, 2, 1, 1, 1, end(2)), (1, 2, 1, 1, 0, 1, 0, end(1)), (3, 1, 1, 1, 0, 1, 0, end(3)),
    ], key=str)


def test_estimates_are_never_too_small(spark):
    rng = np.random.default_rng(0)
    p = rng.integers(-(2**63), 2**63, (400, 2))[rng.integers(0, 400, 2000)]
    counts = trie.sketch(spark.createDataFrame(pd.DataFrame(p, columns=["p1", "p2"])), 2000)
    cells = trie._cells(p[:, 0], p[:, 1], counts.shape[1])
    least = np.minimum.reduce([line[c] for line, c in zip(counts, cells, strict=True)])
    _, which, times = np.unique(p, axis=0, return_inverse=True, return_counts=True)
    assert (least >= times[which.ravel()]).all() and (least == times[which.ravel()]).mean() > 0.9
