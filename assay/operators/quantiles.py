"""Exact, linearly interpolated quantiles of any number of columns, without a task that holds a column.

Input are rows (cid, value, count), values repeated or not, that are read a few times. Each column's span is cut into bins,
which are counted in one scan that shuffles a row per column, bin and task; a wanted rank then lies in one known bin, and only
the values of such bins are counted one by one. These are dealt by ranges of (cid, value), so that a column lies in as many
tasks as it needs; totals per range and column, a few rows, are summed up along each column, and only the ranges that hold a
wanted rank are numbered row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.sinks.runs import materialize


#: bins of a span; how often spans are cut again, and the share of all rows (or number of rows) that may be left in them
BINS, ROUNDS, SHARE, FEW = 1024, 6, 1 / 64, 1_000_000


def ranged(freq: DataFrame) -> DataFrame:
    """(cid, v, n, block) stored in the order of (cid, v): every block is one range."""
    dealt = freq.select("cid", "v", "n").repartitionByRange("cid", "v").sortWithinPartitions("cid", "v")
    return materialize(dealt.withColumn("block", F.spark_partition_id()), "value-ranges")


def _half(v: str) -> str:
    """Half of a value, infinities as the largest doubles: differences of halves are finite."""
    return f"greatest(least({v}, 1.7976931348623157E308D), -1.7976931348623157E308D) / 2"


#: the bin of a value, which never falls as the value grows
_BIN = (
    f"CAST(coalesce(try_divide({_half('v')} - {_half('low')}, {_half('high')} - {_half('low')}), 0D) * {BINS} AS INT) AS bin"
)


def _within(freq: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows of ``freq`` whose value lies in a span; spans, a few per column, do not overlap."""
    bounds = F.broadcast(spans.selectExpr("cid AS c", "low", "high"))
    return freq.join(bounds, F.expr("cid = c AND v BETWEEN low AND high")).select("cid", "v", "n", "low", "high")


def _cut(freq: DataFrame, spans: DataFrame) -> DataFrame:
    """Smaller spans that hold the same ranks: the bins, from their least to their greatest value, in which these lie."""
    bins = _within(freq, spans).selectExpr("cid", "low", "v", "n", _BIN).groupBy("cid", "low", "bin").agg(
        F.expr("sum(n) AS total"), F.expr("min(v) AS least"), F.expr("max(v) AS most")
    )
    placed = bins.join(F.broadcast(spans.select("cid", "low", "before", "wanted")), ["cid", "low"]).selectExpr(
        "cid", "least AS low", "most AS high", "total", "wanted",
        "before + sum(total) OVER (PARTITION BY cid, low ORDER BY bin ROWS UNBOUNDED PRECEDING) - total AS before",
    )
    own = placed.withColumn("wanted", F.expr("filter(wanted, w -> before <= w.rank AND w.rank < before + total)"))
    return materialize(own.where("size(wanted) > 0"), "value-spans")


def quantiles(freq: DataFrame, probs: Sequence[float]) -> DataFrame:
    """(cid, p0, p1, …): one column per entry of ``probs``, from (cid, v, n) without nulls."""
    # two neighbours of each rank, which may lie in different ranges
    ranks = ", ".join(
        f"named_struct('i', {i}, 'at', {float(p)!r}D * (total - 1), 'rank', {end}({float(p)!r}D * (total - 1)))"
        for i, p in enumerate(probs)
        for end in ("floor", "ceil")
    )
    whole = freq.groupBy("cid").agg(F.expr("min(v) AS low"), F.expr("max(v) AS high"), F.expr("sum(n) AS total"))
    spans = materialize(whole.selectExpr("*", "0L AS before", f"array_distinct(array({ranks})) AS wanted"), "value-spans")
    size = "coalesce(sum(total) FILTER (WHERE low < high), 0)"
    rows = spans.selectExpr(f"{size} AS open", "coalesce(sum(total), 0) AS total").first()
    left = rows.open
    for _ in range(ROUNDS):
        if left <= max(FEW, rows.total * SHARE):
            break
        spans = _cut(freq, spans)
        left = spans.selectExpr(f"{size} AS open").first().open
    # spans of one value are that value; in the others, values are counted and numbered
    known = spans.where("low = high").selectExpr("cid", "low AS v", "inline(wanted)")
    found = known.unionByName(_numbered(freq, spans.where("low < high"))) if left else known
    ends = found.groupBy("cid", "i", "at").agg(F.expr("min_by(v, rank) AS a"), F.expr("max_by(v, rank) AS b"))
    values = ends.selectExpr("cid", "i", "a + (b - a) * (at - floor(at)) AS q")
    return values.groupBy("cid").agg(*[F.expr(f"max(CASE WHEN i = {i} THEN q END) AS p{i}") for i in range(len(probs))])


def _numbered(freq: DataFrame, spans: DataFrame) -> DataFrame:
    """(cid, v, i, at, rank): the values at the ranks that the spans hold."""
    ranges = ranged(_within(freq, spans).groupBy("cid", "v").agg(F.expr("sum(n) AS n")))
    totals = ranges.groupBy("cid", "block").agg(F.expr("sum(n) AS total")).selectExpr(
        "cid", "block",
        "sum(total) OVER (PARTITION BY cid ORDER BY block ROWS UNBOUNDED PRECEDING) - total AS before",
        "sum(total) OVER (PARTITION BY cid ORDER BY block ROWS UNBOUNDED PRECEDING) AS upto",
    )
    # a rank among the values of the column's spans alone
    ranks = spans.selectExpr(
        "cid", "wanted",
        "before - coalesce(sum(total) OVER (PARTITION BY cid ORDER BY low ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS skipped",
    ).selectExpr("cid", "skipped", "inline(wanted)").selectExpr("cid", "i", "at", "rank", "rank - skipped AS place")
    wanted = totals.join(F.broadcast(ranks), "cid").where("before <= place AND place < upto")
    blocks = wanted.groupBy("cid", "block").agg(
        F.first("before").alias("before"), F.collect_set(F.struct("i", "at", "rank", "place")).alias("wanted")
    )
    # one row per column, range and wanted rank: of the values, only these ranges are read further
    running = ranges.join(F.broadcast(blocks), ["cid", "block"]).selectExpr(
        "cid", "v", "wanted", "n",
        "before + sum(n) OVER (PARTITION BY cid, block ORDER BY v ROWS UNBOUNDED PRECEDING) AS upto",
    )
    found = running.selectExpr("cid", "v", "upto", "n", "inline(wanted)").where("place < upto AND place >= upto - n")
    return found.select("cid", "v", "i", "at", "rank")
