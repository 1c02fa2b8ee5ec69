"""Near-duplicate documents by a chosen-path set similarity join.

Documents with equal shingle sets form one class. Every class gets ``OWN`` minwise hashes for each of ``trees`` trees, which
share none and so are independent. A node picks one coordinate of its tree's, and further ones (at 0.8 a second one for a
quarter of the nodes), so that a pair at the wanted similarity is expected to stay together on one branch; classes that agree
at a picked coordinate go to the same child.
Nodes of at most ``LEAF`` classes are compared exhaustively. Larger ones compare all members with one of them and branch on,
until they are small or branching no longer parts them; the rest is compared in blocks. Members already known to be connected need no comparison: a node mostly
of one component ends, and the classes that met the component there are compared with all of it, once for all trees. So a
large group of near copies costs comparisons in proportion to its size and to the number of strangers it met. Links are confirmed on the full sets.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.components import components
from assay.llm.store import table, written
from assay.llm.text import words

SIG, OWN, TREES, DEPTH, LEAF, BLOCK = 64, 16, 16, 10, 16, 128
TREE = np.uint64(0xFFF)  # the bits of a node's number that tell its tree
#: Where a level leaves more than this share of the rows in large nodes, they are alike and further branching is in vain.
SHRINK = 0.8
FEW = 1_000_000  # keys of 16 bytes that may be broadcast
ODD, ALONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x5851F42D4C957F2D)
PAIRS = np.uint64(0x5555555555555555)
NODES = "node long, key binary, n int, sketch binary"
CANDIDATES = "a binary, b binary"
MEMBER = ("key", "n", "sketch", "label")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hashes of words, remembered for up to a million of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The set of a text as sorted 64-bit hashes: its word pairs, or its only word, or nothing."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z only, and the six blanks
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(ids) < 2:
        return mix(ids ^ ALONE)
    return np.unique(mix(ids[:-1] * ODD + ids[1:]))


@functools.cache
def _hashing(trees: int) -> tuple[np.ndarray, np.ndarray]:
    rng, width = np.random.default_rng(20240607), max(SIG, trees * OWN)
    factors = rng.integers(0, 1 << 63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, rng.integers(0, 1 << 63, width, dtype=np.uint64)


def signature(found: np.ndarray, trees: int = TREES) -> np.ndarray:
    """Minwise values of a set, ``OWN`` for each tree, 16 bits of each."""
    factors, terms = _hashing(trees)
    least = np.full(len(terms), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        np.minimum(least, (found[at : at + 1024, None] * factors + terms).min(axis=0), out=least)
    return (mix(least) >> np.uint64(48)).astype(np.uint16)


def sketch(sig: np.ndarray) -> np.ndarray:
    """Two bits of each of the first SIG coordinates, 16 bytes a row."""
    two = mix(sig[:, :SIG].astype(np.uint64)) & np.uint64(3)
    shift = np.uint64(2) * np.arange(32, dtype=np.uint64)
    return np.bitwise_or.reduce(two.reshape(len(sig), 2, 32) << shift, axis=2)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    return SIG - np.bitwise_count((x | (x >> np.uint64(1))) & PAIRS).sum(axis=-1, dtype=np.int64)


def agree(ratio: float) -> int:
    """In how many marks a pair of this similarity agrees at least, 4.3 deviations below the mean (42 of 64 at 0.8)."""
    p = ratio + (1 - ratio) / 4
    return max(0, int(SIG * p - 4.3 * (SIG * p * (1 - p)) ** 0.5))


def _matrix(column: pd.Series, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), width)


def _signatures(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), -1)


def _bytes(rows: np.ndarray) -> list[bytes]:
    data, width = np.ascontiguousarray(rows).tobytes(), rows.shape[1] * rows.itemsize
    return [data[i : i + width] for i in range(0, len(data), width)]


def featured(docs: DataFrame, trees: int = TREES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, mark (hash of the text), n (set size), key (of the set) and sig."""

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            keys, sizes, sigs = [], [], []
            for text in batch["text"]:
                found = shingles(text, hashes)
                sizes.append(len(found))
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                sigs.append(signature(found, trees).tobytes() if len(found) else None)
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "mark": batch["mark"], "n": sizes, "key": keys, "sig": sigs}
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select(F.col("doc_id").cast("string"), F.xxhash64("text").alias("mark"), "text")
    found = source.mapInPandas(features, "doc_id string, mark long, n int, key binary, sig binary")
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def _roots(trees: int) -> np.ndarray:
    tree = np.arange(trees, dtype=np.uint64)
    return mix(tree + np.uint64(1)) & ~TREE | tree


def _branch(node: np.ndarray, sig: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Children of nodes and the row each comes from."""
    pick, tree = mix(node ^ ODD), (node & TREE).astype(int)
    first = (pick % np.uint64(OWN)).astype(int)
    step = (pick >> np.uint64(8)).astype(np.uint8).astype(int) | 1  # odd, so that OWN picks differ
    count = (1 / ratio + (pick >> np.uint64(32)).astype(float) / 2**32).astype(int).clip(1, OWN)
    rows = np.concatenate([np.flatnonzero(count > c) for c in range(count.max(initial=1))])
    nth = np.concatenate([np.full((count > c).sum(), c) for c in range(count.max(initial=1))])
    places = tree[rows] * OWN + (first[rows] + nth * step[rows]) % OWN
    value = sig[rows, places].astype(np.uint64) * np.uint64(sig.shape[1]) + places.astype(np.uint64)
    return mix(node[rows] * ODD + mix(value)) & ~TREE | node[rows] & TREE, rows


def _grown(levels: int, trees: int, ratio: float):
    """Rows of (key, n, sig[, node]) to their nodes ``levels`` further down; without node, from the roots."""

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 2000):
                batch = whole.iloc[at : at + 2000]
                sig = _signatures(batch["sig"])
                if "node" in batch:
                    node, rows = batch["node"].to_numpy().astype(np.uint64), np.arange(len(batch))
                else:
                    node, rows = np.repeat(_roots(trees), len(batch)), np.tile(np.arange(len(batch)), trees)
                for _ in range(levels):
                    node, origin = _branch(node, sig[rows], ratio)
                    rows = rows[origin]
                marks, keys = np.array(_bytes(sketch(sig)), object), batch["key"].to_numpy()
                yield pd.DataFrame(
                    {
                        "node": node.astype(np.int64),
                        "key": keys[rows],
                        "n": batch["n"].to_numpy()[rows],
                        "sketch": marks[rows],
                    }
                )

    return grow


def _near(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, ratio: float) -> np.ndarray:
    """Whether sizes and sketches allow the similarity."""
    return (np.minimum(n, m) >= ratio * np.maximum(n, m)) & (agreement(a, b) >= agree(ratio))


def _compare_neighbours(ratio: float):
    """Rows sorted by node, nodes of at most LEAF rows: all pairs of a node that may be similar."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            whole = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = whole["node"].iloc[-1] if len(whole) else None
            cut = int((whole["node"] == last).to_numpy().argmax()) if len(whole) else 0
            held = whole.iloc[cut:]
            yield pairs(whole.iloc[:cut])
        if held is not None:
            yield pairs(held)

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        node, key, n = rows["node"].to_numpy(), rows["key"].to_numpy(), rows["n"].to_numpy()
        label = rows["label"].to_numpy() if "label" in rows else key
        marks = _matrix(rows["sketch"], np.uint64, 2)
        a, b = [], []
        for k in range(1, min(LEAF, len(rows))):
            i = np.flatnonzero(node[:-k] == node[k:])
            if not len(i):
                break
            i = i[_near(marks[i], marks[i + k], n[i], n[i + k], ratio)]
            i = i[label[i] != label[i + k]]
            a.append(key[i])
            b.append(key[i + k])
        return _pair_frame(np.concatenate(a) if a else [], np.concatenate(b) if b else [])

    return compare


def _pair_frame(a, b) -> pd.DataFrame:
    low = [min(x, y) for x, y in zip(a, b, strict=True)]
    return pd.DataFrame({"a": low, "b": [max(x, y) for x, y in zip(a, b, strict=True)]}, dtype=object)


def _compare_pivots(ratio: float):
    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            near = _near(
                _matrix(rows["sketch"], np.uint64, 2), _matrix(rows["p_sketch"], np.uint64, 2),
                rows["n"].to_numpy(), rows["p_n"].to_numpy(), ratio,
            )
            near &= (rows["label"] != rows["p_label"]).to_numpy()
            yield _pair_frame(rows["key"].to_numpy()[near], rows["p_key"].to_numpy()[near])

    return compare


def _link_blocks(percent: int):
    """Groups of (unit, i, j): links of its ``other`` rows with the rest whose ends nothing before them connects."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        hashes, parent, found = WordHashes(), {}, []

        def root(x: bytes) -> bytes:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        rows = rows.sort_values(["other", "key"], ascending=False, kind="stable")
        others = int(rows["other"].sum())
        key, label, n = rows["key"].tolist(), rows["label"].tolist(), rows["n"].to_numpy()
        marks, sets = _matrix(rows["sketch"], np.uint64, 2), [shingles(t, hashes) for t in rows["text"]]
        for x in range(others):
            near = _near(marks[[x]], marks[others:], n[x], n[others:], percent / 100)
            for y in others + np.flatnonzero(near):
                a, b = root(label[x]), root(label[y])
                if a != b and similar(sets[x], sets[y], percent):
                    parent[a] = b
                    found.append((key[x], key[y]))
        return _pair_frame([a for a, _ in found], [b for _, b in found])

    return links


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it has at most FEW rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def texts_of(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``key`` and ``text`` of the classes in ``wanted`` (key, each once), by their representatives."""
    chosen = written(wanted.join(classes.select("key", "rep", "mark"), "key"), "near-wanted")
    texts = docs.select(F.col("doc_id").alias("rep"), F.xxhash64("text").alias("mark"), "text")
    few = _small(chosen.withColumnsRenamed({"rep": "r", "mark": "m"}))
    same = F.col("rep").eqNullSafe(F.col("r")) & (F.col("mark") == F.col("m"))
    return written(texts.join(few, same).select("key", "text").dropDuplicates(["key"]), "near-texts")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets are similar enough, from the texts of the classes' representatives."""
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), classes, docs)
    both = (
        pairs.join(texts.withColumnsRenamed({"key": "a", "text": "text_a"}), "a")
        .join(texts.withColumnsRenamed({"key": "b", "text": "text_b"}), "b")
    )

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, sets = WordHashes(), {}

        def of(key: bytes, text: str) -> np.ndarray:
            if key not in sets:
                if len(sets) >= 256:
                    sets.clear()
                sets[key] = shingles(text, hashes)
            return sets[key]

        for rows in batches:
            good = []
            for a, ta, b, tb in zip(rows["a"], rows["text_a"], rows["b"], rows["text_b"], strict=True):
                good.append(similar(of(a, ta), of(b, tb), percent))
            yield rows.loc[good, ["a", "b"]]

    return both.mapInPandas(check, CANDIDATES)


def near_duplicates(
    docs: DataFrame, percent: int = 80, trees: int = TREES, depth: int = DEPTH
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept, label and mark.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their sets of word pairs; a component is what
    links reach, named by its smallest doc_id. ``label`` names it too, also where ids repeat, and is null for empty sets;
    ``mark`` is a hash of the text. Null and wordless texts have empty sets and stand alone, as their own
    component. Rows that repeat a doc_id are judged by their own texts. A null doc_id is never the smallest unless all are
    null, in which case component_id is null and the row is kept.

    A pair at ``percent`` 80 stays together in a tree to depth 10 with probability 0.36, so 16 trees, with coordinates of
    their own, find 0.999 of such pairs there, and more where nodes get small sooner; more similar pairs are found more surely.
    """
    ratio = percent / 100
    docs = docs.select("doc_id", "text")
    features = written(featured(docs, trees), "near-features")
    classes = written(
        features.filter("n > 0").groupBy("key").agg(
            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("first"),
            F.min(F.struct("n", "sig")).alias("of"),
        ).select("key", F.col("first.doc_id").alias("rep"), F.col("first.mark").alias("mark"), "of.n", "of.sig"),
        "near-classes",
    )
    known, found, met, before = None, [], [], float("inf")  # known: (key, label) of classes with links so far
    frontier = classes.select("key", "n", "sig").mapInPandas(_grown(2, trees, ratio), NODES)
    for level in range(2, depth + 1):
        pairs, large, led = _compare_level(frontier, known, ratio, level == 2)
        found.append(written(pairs.distinct(), f"near-pairs-{level}"))
        if led is not None:
            met.append(written(led, f"near-led-{level}"))
        if level == 2:
            edges = written(confirmed(found.pop(), classes, docs, percent), "near-edges")
            known = components(edges)
        left = large.count()
        if not left:
            large = None
        if not left or left > SHRINK * before:
            break
        before = left
        if level < depth:
            joined = large.select("node", "key").join(classes.select("key", "n", "sig"), "key")
            frontier = written(joined.mapInPandas(_grown(1, trees, ratio), NODES), f"near-nodes-{level + 1}")
    if found:
        fresh = written(_apart(_union(found).distinct(), known), "near-pairs")
        edges = edges.unionByName(written(confirmed(fresh, classes, docs, percent), "near-edges"))
        known = components(edges)
    units = _units(_union(met), large, known)
    if units is not None and not units.isEmpty():
        edges = edges.unionByName(written(_exact_links(units, classes, docs, percent), "near-edges"))
        known = components(edges)

    named = classes.join(known, "key", "left").select("key", "rep", F.coalesce("label", "key").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    by_key = named.join(least, "label").select("key", "component_id", "label")
    alone = F.col("n") == 0
    return features.join(by_key, "key", "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"),
        "label",
        "mark",
    )


def _union(frames: list[DataFrame]) -> DataFrame | None:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out


def _labelled(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    if known is None:
        return rows.withColumn("label", F.col("key"))
    return rows.join(known, "key", "left").withColumn("label", F.coalesce("label", "key"))


def _compare_level(frontier: DataFrame, known: DataFrame | None, ratio: float, first: bool):
    """Candidate pairs of the nodes of a level, and the rows of those to branch on."""
    rows = _labelled(frontier, known)
    if not first:
        rows = written(rows, "near-labelled")
    if first:  # every label is one row
        sizes = rows.groupBy("node").agg(F.count("*").alias("size"), F.lit(1).alias("most"), F.lit(None).cast("binary").alias("main"))
    else:
        counted = rows.groupBy("node", "label").agg(F.count("*").alias("c"))
        sizes = counted.groupBy("node").agg(F.sum("c").alias("size"), F.max(F.struct("c", "label")).alias("top"))
        sizes = sizes.select("node", "size", F.col("top.c").alias("most"), F.col("top.label").alias("main"))
    over = written(sizes.filter(F.col("size") > LEAF).withColumn("others", F.col("size") - F.col("most")), "near-large")
    small = rows.join(_small(over.select("node")), "node", "left_anti").repartition("node").sortWithinPartitions("node")
    pairs = small.mapInPandas(_compare_neighbours(ratio), CANDIDATES)

    many = rows.join(_small(over.filter("2 * most < size").select("node")), "node", "left_semi")
    pivots = many.groupBy("node").agg(F.min(F.struct(*MEMBER)).alias("p"))
    pivots = written(pivots.select("node", *[F.col(f"p.{c}").alias(f"p_{c}") for c in MEMBER]), "near-pivots")
    pairs = pairs.unionByName(many.join(_small(pivots), "node").mapInPandas(_compare_pivots(ratio), CANDIDATES))
    led = rows.join(_small(over.filter("2 * most >= size AND others > 0").select("node", "main")), "node")
    led = led.filter("label <> main").select("main", "key").distinct()
    return pairs, many, None if first else led


def _apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs not known to be connected."""
    label = lambda side: known.select(F.col("key").alias(side), F.col("label").alias(f"label_{side}"))
    both = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left")
    apart = F.col("label_a").isNull() | F.col("label_b").isNull() | (F.col("label_a") != F.col("label_b"))
    return both.filter(apart).select("a", "b")


def _units(led: DataFrame | None, rows: DataFrame | None, known: DataFrame) -> DataFrame | None:
    """What remains to be compared: ``unit``, ``key``, ``label`` and ``other``; others with all rows of their unit.

    Units are components with the classes that met them in some node (``led``), and nodes still large at the last level
    (``rows``), in which all but the main component are others.
    """
    parts = []
    if led is not None:
        leader = known.select(F.col("key").alias("main"), F.col("label").alias("unit"))
        strange = _labelled(led.join(leader, "main").select("unit", "key").distinct(), known).filter("label <> unit")
        strange = written(strange.select("unit", "key", "label"), "near-strange")
        members = known.join(strange.select(F.col("unit").alias("label")).distinct(), "label").select(
            F.col("label").alias("unit"), "key", "label"
        )
        parts += [strange.withColumn("other", F.lit(True)), members.withColumn("other", F.lit(False))]
    if rows is not None:
        rows = _labelled(rows.select(F.col("node").cast("string").cast("binary").alias("unit"), "key"), known)
        rows = written(rows.select("unit", "key", "label"), "near-rest")
        counted = rows.groupBy("unit", "label").agg(F.count("*").alias("c"))
        main = counted.groupBy("unit").agg(F.max(F.struct("c", "label")).alias("top"), F.count("*").alias("labels"))
        main = main.filter("labels > 1").select("unit", F.col("top.label").alias("main"))
        parts.append(rows.join(main, "unit").withColumn("other", F.col("label") != F.col("main")).drop("main"))
    return written(_union(parts), "near-units") if parts else None


def _exact_links(units: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links of units' others, compared block by block on full sets; a block's links are no more than its rows."""
    sizes = units.groupBy("unit").agg(F.count("*").alias("n_all"), F.count_if("other").alias("n_others"))
    split = units.join(sizes.filter("n_others > 0"), "unit")
    all_blocks, other_blocks = F.ceil(F.col("n_all") / BLOCK).cast("int"), F.ceil(F.col("n_others") * 2 / BLOCK).cast("int")
    place = F.xxhash64("key")
    count = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rest = split.select("unit", "key", "label", F.lit(False).alias("other"), F.pmod(place, all_blocks).cast("int").alias("j"), count(other_blocks).alias("i"))
    others = split.filter("other").select("unit", "key", "label", "other", F.pmod(place, other_blocks).cast("int").alias("i"), count(all_blocks).alias("j"))

    @F.pandas_udf("binary")
    def sketched(sig: pd.Series) -> pd.Series:
        return pd.Series(_bytes(sketch(_signatures(sig))) if len(sig) else [], dtype=object)

    texts = texts_of(units.select("key").distinct(), classes, docs).join(classes.select("key", "n", "sig"), "key")
    texts = texts.select("key", "n", "text", sketched("sig").alias("sketch"))
    dealt = others.unionByName(rest).join(texts, "key")
    return dealt.groupBy("unit", "i", "j").applyInPandas(_link_blocks(percent), CANDIDATES)


def op4_near_dups(spark, folder):
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def without_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """One row of ``docs`` for each component, that with its smallest doc_id, and every row without words."""
    found = near_duplicates(docs, **how)
    chosen = found.filter("kept AND label IS NOT NULL").groupBy("label").agg(F.min(F.struct("doc_id", "mark")).alias("one"))
    chosen = chosen.select(F.col("one.doc_id").alias("id"), F.col("one.mark").alias("hash"))
    rows = docs.select(
        docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("mark"),
        (F.size(words(docs["text"])) > 0).alias("worded"), F.struct(*[docs[c] for c in docs.columns]).alias("record"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("hash"))
    first = rows.filter("worded").join(chosen, same, "left_semi").dropDuplicates(["doc_id", "mark"])
    return first.select("record.*").unionByName(rows.filter("NOT worded").select("record.*"))


OP4_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE
        list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g
    FROM d WHERE len(w) > 0
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
    GROUP BY ALL
), link AS (
    SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), both_ways AS (
    SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach AS (
    SELECT doc_id AS x, doc_id AS y FROM d
    UNION
    SELECT r.x, l.y FROM reach r JOIN both_ways l ON r.y = l.x
), least AS (
    SELECT x, min(y) AS component_id FROM reach GROUP BY x
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN least ON x = doc_id LEFT JOIN n USING (doc_id)
"""
