"""The trie of conversations: every distinct sequence of first turns is a node.

A conversation's prefixes are told apart by 128-bit digests. A count-min sketch over all of them is made first, per task, and
added up. Where its estimate is one, no other conversation has the prefix: the node is known in full where its row is, and
nothing of it moves. Only prefixes with larger estimates, which others may share, are grouped by digest. What a node needs of
its subtree is a sum over its members, so that no walk over levels is needed: a conversation owns the nodes whose smallest
member it is, and these are all from some depth on.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.store import written
from assay.session import scratch_path

#: The sketch: lines of cells, the largest line (three of 2 bytes a cell: 100 MB), cells that travel together.
LINES, MOST_CELLS, CHUNK = 3, 1 << 24, 1 << 16
#: Prefixes seen so often have their node copied for so many groups of children.
OFTEN, COPIES = 4096, 64
#: Turns of one conversation that are looked at together, and ids that are hashed together.
RUN, IDS = 4096, 10_000
NODE = ("p1", "p2")


# turns in order ------------------------------------------------------------------------------------------------------


def numbered(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(conv, block, at, digest, bytes) of every turn, and (conv, block, first, offset, n) to number them.

    A turn's number is ``offset + at - first + 1``. Turns are ordered by ``turn``, null first, then role and text. They are
    dealt by ranges, so a long conversation lies in many blocks, and its numbers need one row per block.
    """
    rows = turns.select(
        turns[conv_id].cast("long").alias("conv"),
        turns[turn].alias("turn"),
        F.coalesce(turns[role], F.lit("")).alias("role"),
        F.coalesce(turns[text], F.lit("")).alias("text"),
    ).filter("conv IS NOT NULL")
    order = ("conv", "turn", "role", "text")
    content = F.sha2(F.concat(F.octet_length("role"), F.lit(":"), "role", "text").cast("binary"), 256)
    slim = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv",
        F.monotonically_increasing_id().alias("at"),
        F.unhex(F.substring(content, 1, 32)).alias("digest"),
        F.octet_length("text").cast("long").alias("bytes"),
    )
    slim = written(slim, "turns").withColumn("block", F.shiftright("at", 33))
    each = slim.groupBy("conv", "block").agg(F.min("at").alias("first"), F.count("*").alias("here"))
    blocks = Window.partitionBy("conv").orderBy("block")
    starts = each.select(
        "conv",
        "block",
        "first",
        (F.sum("here").over(blocks) - F.col("here")).alias("offset"),
        F.sum("here").over(Window.partitionBy("conv")).alias("n"),
    )
    return slim, written(starts, "turn-starts")


NUMBER = "offset + at - first + 1"


def conversations(slim: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, d, digest, bytes, len) of all turns as they are, and (conv, len) of all conversations."""
    rows = slim.join(starts, ["conv", "block"]).selectExpr("conv", f"{NUMBER} AS d", "digest", "bytes", "n AS len")
    return rows, starts.filter("offset = 0").selectExpr("conv", "n AS len")


def rebuilt(slim: DataFrame, starts: DataFrame, family: int = 5, longest: int = 8) -> tuple[DataFrame, DataFrame]:
    """As ``conversations``, with the first turns of another conversation in place of a conversation's own.

    Of conversation ``c``, the first ``h`` turns give way to the first ``h`` of conversation ``c - c % family``, if there are
    any; ``h`` is the crc32 of the id modulo ``longest + 1``.
    """
    convs = starts.filter("offset = 0").select(
        "conv", "n", (F.crc32(F.col("conv").cast("string")) % (longest + 1)).alias("h"), (F.col("conv") - F.col("conv") % family).alias("head")
    )
    bases = convs.filter("conv = head").selectExpr("conv AS head", "n AS base_n")
    convs = convs.join(bases, "head", "left").withColumn("g", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = written(
        convs.select("conv", "head", "h", "g", (F.col("g") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")),
        "conversations",
    )
    known = starts.join(convs, "conv")
    rows = slim.join(known, ["conv", "block"]).withColumn("i", F.expr(NUMBER))
    own = rows.filter("i > h").selectExpr("conv", "i - h + g AS d", "digest", "bytes", "len")
    heads = rows.filter(f"conv = head AND i <= {longest}").select("head", "i", "digest", "bytes")
    begun = heads.join(convs, "head").filter("i <= h").selectExpr("conv", "i AS d", "digest", "bytes", "len")
    return own.unionByName(begun), convs.select("conv", "len")


# prefixes and the sketch ---------------------------------------------------------------------------------------------


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv, d, len, bytes, before, p1, p2, q1, q2) of every turn: bytes of the turns before, digests with and without it.

    A prefix's digest is the exclusive or of its turns' hashes, each hashed with its position, so that runs of turns can be
    digested apart and put together.
    """
    keyed = rows.select(
        "conv", "d", "len", "bytes", F.expr(f"(d - 1) div {RUN}").alias("run"),
        F.xxhash64(F.lit(1), "d", "digest").alias("t1"), F.xxhash64(F.lit(2), "d", "digest").alias("t2"),
    )
    upto = Window.partitionBy("conv", "run").orderBy("d")
    here = keyed.select(
        "*",
        F.bit_xor("t1").over(upto).alias("x1"),
        F.bit_xor("t2").over(upto).alias("x2"),
        (F.sum("bytes").over(upto) - F.col("bytes")).alias("ahead"),
    )
    # Only conversations of several runs have rows in here.
    runs = keyed.filter(F.col("len") > RUN).groupBy("conv", "run").agg(
        F.bit_xor("t1").alias("y1"), F.bit_xor("t2").alias("y2"), F.sum("bytes").alias("more")
    )
    earlier = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carried = runs.select("conv", "run", F.bit_xor("y1").over(earlier).alias("y1"), F.bit_xor("y2").over(earlier).alias("y2"), F.sum("more").over(earlier).alias("more"))
    none = F.lit(0).cast("long")
    whole = here.join(carried, ["conv", "run"], "left").select(
        "conv", "d", "len", "bytes", "t1", "t2",
        (F.col("ahead") + F.coalesce("more", none)).alias("before"),
        F.col("x1").bitwiseXOR(F.coalesce("y1", none)).alias("p1"),
        F.col("x2").bitwiseXOR(F.coalesce("y2", none)).alias("p2"),
    )
    before = [F.col(f"p{i}").bitwiseXOR(F.col(f"t{i}")).alias(f"q{i}") for i in (1, 2)]
    return whole.select("conv", "d", "len", "bytes", "before", "p1", "p2", *before)


def _cells(p1: np.ndarray, p2: np.ndarray, width: int) -> list[np.ndarray]:
    """The cell of each digest in every line."""
    a, b = p1.astype(np.int64).view(np.uint64), p2.astype(np.int64).view(np.uint64) | np.uint64(1)
    shift = np.uint64(64 - int(width).bit_length() + 1)
    return [((a + np.uint64(k) * b) * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int64) for k in range(LINES)]


def sketch(digests: DataFrame, prefixes_: int) -> np.ndarray:
    """Count-min counters of ``p1`` and ``p2``, ``LINES`` by a power of two; 65,535 stands for that many or more.

    It has two to four cells a prefix up to ``MOST_CELLS``; a fuller sketch proves less, which costs time and nothing else.
    """
    width = min(max(1 << (2 * prefixes_).bit_length(), CHUNK), MOST_CELLS)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((LINES, width), np.uint32)
        for batch in batches:
            for line, cells in zip(counts, _cells(batch.p1.to_numpy(), batch.p2.to_numpy(), width), strict=True):
                np.add.at(line, cells, 1)
        flat = np.minimum(counts.reshape(-1), 65535).astype(np.uint16)
        for i in range(0, len(flat), CHUNK):
            if (part := flat[i : i + CHUNK]).any():
                yield pd.DataFrame({"chunk": [i // CHUNK], "counts": [zlib.compress(part.tobytes(), 1)]})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, packed in zip(batch.chunk, batch.counts, strict=True):
                part = np.frombuffer(zlib.decompress(packed), np.uint16).astype(np.uint32)
                sums[chunk] = np.minimum(sums[chunk] + part, 65535) if chunk in sums else part
        for chunk, total in sums.items():
            yield pd.DataFrame({"chunk": [chunk], "counts": [zlib.compress(total.astype(np.uint16).tobytes(), 1)]})

    schema = "chunk long, counts binary"
    parts = digests.select(*NODE).mapInPandas(counted, schema).repartition("chunk").mapInPandas(added, schema)
    out = np.zeros(LINES * width, np.uint16)
    for chunk, packed in parts.toLocalIterator():
        out[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(zlib.decompress(packed), np.uint16)
    return out.reshape(LINES, width)


def estimate(spark: SparkSession, counts: np.ndarray):
    """A function of two digest columns: how many prefixes have them at most."""
    shared = spark.sparkContext.broadcast(counts)

    @F.arrow_udf(T.IntegerType())
    def estimated(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        lines = shared.value
        for p1, p2 in batches:
            cells = _cells(p1.to_numpy(zero_copy_only=False), p2.to_numpy(zero_copy_only=False), lines.shape[1])
            least = np.minimum.reduce([line[c] for line, c in zip(lines, cells, strict=True)])
            yield pa.array(least.astype(np.int32))

    return estimated


# nodes ---------------------------------------------------------------------------------------------------------------


def _screened(spark: SparkSession, rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The prefixes with ``seen`` and ``seen_before`` (of the parent), stored apart by ``alone``; the root is seen by all."""
    found = written(prefixes(rows), "prefixes")
    estimated = estimate(spark, sketch(found, found.count()))
    found = found.withColumn("seen", estimated("p1", "p2")).withColumn("seen_before", estimated("q1", "q2"))
    zero = F.lit(0).cast("long")
    roots = convs.select(
        "conv", zero.alias("d"), "len", *[zero.alias(c) for c in ("bytes", "before", "p1", "p2", "q1", "q2")],
        F.lit(65535).alias("seen"), F.lit(65535).alias("seen_before"),
    )
    path = scratch_path(spark, "screened")
    all_rows = found.unionByName(roots).withColumn("alone", F.col("seen") == 1)
    all_rows.write.partitionBy("alone").option("compression", "zstd").parquet(path)
    return spark.read.schema(all_rows.schema).parquet(path)


def _ownership(alone: DataFrame, shared: DataFrame) -> DataFrame:
    """(conv, own, kept, leaf, len): the depth from which a conversation is the smallest member, the bytes of the turns before
    that, and whether it owns a node without children."""
    groups = shared.groupBy(*NODE, "d").agg(
        F.min("conv").alias("conv"), F.count("*").alias("n"), F.count_if(F.col("d") == F.col("len")).alias("ends"), F.min("before").alias("before")
    )
    none = F.lit(None).cast("long")
    smallest = groups.select("conv", "d", "before", (F.col("n") == F.col("ends")).alias("leaf"), none.alias("len"))
    single = alone.select("conv", "d", "before", (F.col("d") == F.col("len")).alias("leaf"), none.alias("len"))
    ends = alone.unionByName(shared).filter("d = len").select(
        "conv", (F.col("d") + 1).alias("d"), (F.col("before") + F.col("bytes")).alias("before"), F.lit(False).alias("leaf"), "len"
    )
    first = F.min(F.struct("d", "before"))
    return (
        smallest.unionByName(single).unionByName(ends).groupBy("conv")
        .agg(first.alias("first"), F.max("leaf").alias("leaf"), F.max("len").alias("len"))
        .select("conv", F.col("first.d").alias("own"), F.col("first.before").alias("kept"), "leaf", "len")
    )


def _shared_nodes(alone: DataFrame, shared: DataFrame) -> DataFrame:
    """One row per node that may be shared. Each member adds what it owns below the node."""
    owned = _ownership(alone, shared).select(
        "conv", "own", "kept", "leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"len div {RUN}"))).alias("run")
    )
    members = shared.withColumn("run", F.expr(f"d div {RUN}")).join(owned, ["conv", "run"])
    child = (F.col("own") <= F.col("d") + 1) & (F.col("d") < F.col("len"))
    return members.groupBy(*NODE, "d").agg(
        F.min("conv").alias("conv"),
        F.count("*").alias("n_convs"),
        F.count_if(child).alias("n_children"),
        F.count_if("leaf").alias("n_leaves"),
        F.sum(F.greatest(F.col("kept") - F.col("before"), F.lit(0))).alias("saved_tokens"),
        *[F.min(c).alias(c) for c in ("q1", "q2", "seen", "seen_before")],
    )


def ends_digest(ends: DataFrame) -> DataFrame:
    """(p1, p2, ends_sha256) from (p1, p2, conv): the ids in ascending order, joined by commas.

    Ids are sorted over ranges and joined in bounded pieces first, so a node where very many end is put together from a row
    per ``IDS`` ids by one task that holds one batch.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            new = (batch[list(NODE)] != batch[list(NODE)].shift()).any(axis=1).to_numpy()
            starts = np.flatnonzero(new | (np.arange(len(batch)) % IDS == 0))
            ids, conv = batch.conv.astype(str).to_numpy(), batch.conv.to_numpy()
            joined = [",".join(ids[a:b]) for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)]
            yield pd.DataFrame({"p1": batch.p1.to_numpy()[starts], "p2": batch.p2.to_numpy()[starts], "first": conv[starts], "ids": joined})

    def digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, digest = None, None
        for batch in batches:
            done = []
            for p1, p2, ids in zip(batch.p1, batch.p2, batch.ids, strict=True):
                if (p1, p2) != node:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (p1, p2), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=[*NODE, "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(*node, digest.hexdigest())], columns=[*NODE, "ends_sha256"])

    order = (*NODE, "conv")
    parts = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = parts.mapInPandas(pieces, "p1 long, p2 long, first long, ids string")
    parts = parts.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return parts.mapInPandas(digested, "p1 long, p2 long, ends_sha256 string")


def prefix_trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the conversations whose turns are ``rows`` (conv, d, digest, bytes, len), listed in ``convs`` (conv, len).

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (bytes that members after the first need not keep, of the node and all below), ``ends_sha256`` (of the
    members that end there). The root is the one row of depth 0; without conversations there is none. Conversations without
    turns are members of the root. Null roles and texts are empty ones, rows without an id belong to no conversation, and
    repeated turns count as often as they stand.
    """
    spark = rows.sparkSession
    smallest = convs.agg(F.min("conv")).first()[0]
    screened = _screened(spark, rows, convs)
    alone, shared = screened.filter("alone").drop("alone"), screened.filter("NOT alone").drop("alone")
    nodes = written(_shared_nodes(alone, shared), "trie-nodes")

    def hashed(column: Column) -> Column:
        return F.sha2(column.cast("binary"), 256)

    last = F.col("d") == F.col("len")
    single = alone.select(
        "conv", "d", "q1", "q2", "seen_before",
        F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        hashed(F.when(last, F.col("conv").cast("string")).otherwise("")).alias("ends_sha256"),
    )
    several = nodes.join(ends_digest(shared.filter(last)), list(NODE), "left").select(
        "conv", "d", "q1", "q2", "seen_before", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", hashed(F.lit(""))).alias("ends_sha256"),
    )
    found = single.unionByName(several)
    # The parent of a node is the node itself less a turn: a prefix seen once, the root, or one of ``nodes``.
    near = found.filter("d < 2 OR seen_before = 1").withColumn(
        "parent", F.when(F.col("d") == 1, F.lit(smallest)).when(F.col("d") > 1, F.col("conv")).cast("long")
    )
    copies = lambda seen: F.when(F.col(seen) >= OFTEN, COPIES).otherwise(1)
    parents = nodes.filter("d > 0").select(
        F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv").alias("parent"), F.explode(F.sequence(F.lit(0), copies("seen") - 1)).alias("copy")
    )
    far = found.filter("d >= 2 AND seen_before <> 1").withColumn("copy", F.pmod(F.hash("conv", "d"), copies("seen_before")))
    far = far.join(parents, ["q1", "q2", "copy"], "left").drop("copy")
    return near.unionByName(far).select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    )


def op12_prefix_trie(spark, folder):
    """The trie of all rebuilt conversations."""
    return prefix_trie(*rebuilt(*numbered(spark.read.parquet(f"{folder}/conversations.parquet"))))


#: crc32 bit by bit over the digits of the id.
_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT],
        list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
        lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
            lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)), 4294967295::BIGINT)"""
OP12_SQL = f"""
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
    FROM conversations WHERE conv_id IS NOT NULL
), c AS (
    SELECT conv_id, {_CRC32} % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
    SELECT c.conv_id, 0 AS own, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND i <= h
    UNION ALL
    SELECT c.conv_id, 1, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND i > h
), n AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY own, i) AS d, count(*) OVER (PARTITION BY conv_id) AS size FROM r
), p AS (
    SELECT conv_id, d, size, strlen(text) AS bytes,
        list({{'r': role, 't': text}}) OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS k
    FROM n
), m AS (
    SELECT conv_id, d, size, bytes, k, k[1:d - 1] AS up FROM p
    UNION ALL
    SELECT conv_id, 0, coalesce(max(size), 0), 0, [], NULL FROM c LEFT JOIN n USING (conv_id) GROUP BY conv_id
), node AS (
    SELECT d, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
        coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = size), '') AS ends
    FROM m GROUP BY d, k
), kids AS (
    SELECT d - 1 AS d, up AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL
), below AS (
    SELECT a.d, a.k, sum((u.n_convs - 1) * u.bytes) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves
    FROM node u JOIN m AS a ON a.conv_id = u.conv_id AND a.d <= u.d LEFT JOIN kids ON kids.d = u.d AND kids.k = u.k
    GROUP BY a.d, a.k
)
SELECT node.conv_id, node.d AS depth, parent.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children,
    below.leaves AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, sha256(node.ends) AS ends_sha256
FROM node JOIN below ON below.d = node.d AND below.k = node.k LEFT JOIN kids ON kids.d = node.d AND kids.k = node.k
    LEFT JOIN node AS parent ON parent.d = node.d - 1 AND parent.k = node.up
"""
