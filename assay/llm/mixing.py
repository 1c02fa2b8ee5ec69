"""A mix of sources to target weights, by pivotal dependent rounding.

Every document of a source should be taken target / size times, a number from 0 to 2 whose fraction must be rounded. Two
fractional documents at a time trade mass at random, keeping the words they stand for, until one of them is whole. That goes
on within blocks of documents, each of which leaves one fraction at most; those meet in further blocks, and so on up a tree.
Only the last fraction of a source goes to the nearest whole number, so a source misses its target by half a document at most.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.store import table, written
from assay.llm.text import words

SEED = 20240607
BLOCK = 4096
FEW = 100_000  # sources that may be broadcast
KEY = ["source", "doc_id", "mark", "nth"]


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: by weight, none above ``most`` times its size.

    Weights repeat over the sources in order of code point, null last. What a source can't take is shared by weight among
    the others. With sources in the order in which they fill up, the first k are full and the rest get a common rate per
    weight; k is the first for which the next source holds at that rate.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    given = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))))
    ranked = sizes.select("source", "source_size", given.alias("weight"), (F.col("source_size") * most).alias("cap"))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "weight", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.select(
        "*",
        F.sum("source_size").over(whole).alias("all"),
        F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)).alias("open"),
        F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)).alias("full"),
    ).withColumn("rate", (F.col("all") * share - F.col("full")) / F.col("open"))
    # the rate if this source and all after it share what those before it leave
    holds = F.col("cap") >= F.col("rate") * F.col("weight")
    rate = F.min(F.when(holds, F.struct(F.col("cap") / F.col("weight"), F.col("rate").alias("rate")))).over(whole)["rate"]
    return ranked.select(
        "source",
        "source_size",
        F.coalesce(F.least(F.col("cap"), rate * F.col("weight")), F.col("cap")).alias("target"),
    )


def _block(level: int, seed: int):
    """The rows of a block after pairing: ``p`` is 0 or 1 for all but one at most."""

    def pair(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "place", "doc_id", "mark", "nth"], ascending=[False, True, True, True, True])
        first = rows.iloc[0]
        name = f"{seed}|{level}|{first.source}|{first.block}"
        luck = np.random.default_rng(xxhash.xxh64_intdigest(name)).random(len(rows))
        p, size = rows["p"].tolist(), rows["size"].tolist()
        held = None
        for i in range(len(p)):
            if not 0 < p[i] < 1:
                continue
            if held is None:
                held = i
                continue
            a, b = p[held] * size[held], p[i] * size[i]
            up, down = min(size[held] - a, b), min(a, size[i] - b)
            if luck[i] * (up + down) < down:  # mass moves to the held one, by as much as keeps the mean
                ends = up == size[held] - a, up == b
                p[held], p[i] = (1.0 if ends[0] else (a + up) / size[held]), (0.0 if ends[1] else (b - up) / size[i])
            else:
                ends = down == a, down == size[i] - b
                p[held], p[i] = (0.0 if ends[0] else (a - down) / size[held]), (1.0 if ends[1] else (b + down) / size[i])
            held = held if 0 < p[held] < 1 else i if 0 < p[i] < 1 else None
        rows["p"] = p
        return rows[["source", "doc_id", "mark", "nth", "size", "whole", "p", "place"]]

    return pair


def copies(docs: DataFrame, seed: int = SEED, block: int = BLOCK, **shares) -> DataFrame:
    """``docs`` (doc_id, text, source and more) with size, source_size, target, copies and taken.

    ``size`` is the number of words, 0 for null; ``copies`` how often the mix takes the row, at most 2; ``taken`` their
    product. Rows equal in source, doc_id and text are told apart by a number, so repeated rows are rounded one by one. The
    choice depends on the rows alone, not on how they are partitioned (columns with maps don't tell rows apart). Columns of ``docs`` are kept in ``record``.
    """
    record = F.struct(*[docs[c] for c in docs.columns]).alias("record")
    keyed = docs.select(
        docs["source"].alias("source"), docs["doc_id"].cast("string").alias("doc_id"), F.xxhash64(docs["text"]).alias("mark"),
        F.size(words(docs["text"])).cast("long").alias("size"), record,
    )
    # rows that are equal in these are told apart by the rest of them, so that reruns number them alike
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    keyed = keyed.withColumn("rest", F.xxhash64(*[F.col("record")[c] for c in plain]))
    same = Window.partitionBy("source", "doc_id", "mark")
    keyed = keyed.withColumn("nth", F.row_number().over(same.orderBy("rest"))).drop("rest")
    sizes = written(
        keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "mix-sources"
    )
    goals = targets(sizes.select("source", "source_size"), **shares).withColumnRenamed("source", "s")
    goals = written(sizes.join(goals.drop("source_size"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mix-targets")
    few = goals.count() <= FEW
    sided = goals.withColumnRenamed("source", "s")
    place = F.xxhash64(F.lit(seed), "doc_id", "mark", "nth")
    # the fractions of a source are all equal to begin with
    often = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = keyed.drop("record").join(
        F.broadcast(sided) if few else sided, F.col("source").eqNullSafe(F.col("s"))
    )
    units = units.select(
        *KEY, "size", F.floor(often).cast("long").alias("whole"),
        F.when(F.col("size") > 0, often - F.floor(often)).otherwise(F.lit(0.0)).alias("p"), place.alias("place"),
        F.pmod(place, F.ceil(F.col("rows") / block)).alias("block"),
    )
    schema = units.drop("block").schema
    done, level = [], 0
    while True:
        settled = units.groupBy("source", "block").applyInPandas(_block(level, seed), schema)
        settled = written(settled, f"mix-level-{level}")
        loose = F.col("p").between(1e-300, 1 - 1e-16) & (F.col("p") < 1)
        done.append(settled.filter(~loose))
        rest = settled.filter(loose)
        left, level = rest.groupBy("source").agg(F.count("*").alias("left")), level + 1
        if (left.agg(F.max("left")).first()[0] or 0) <= 1:
            done.append(rest.withColumn("p", F.round("p")))
            break
        of = left.withColumnRenamed("source", "s")
        units = rest.join(F.broadcast(of) if few else of, F.col("source").eqNullSafe(F.col("s"))).select(
            *rest.columns, F.pmod(F.xxhash64(F.lit(seed + 2 + level), "place"), F.ceil(F.col("left") / block)).alias("block")
        )
    chosen = done[0]
    for more in done[1:]:
        chosen = chosen.unionByName(more)
    chosen = chosen.select(*[F.col(k).alias(f"c_{k}") for k in KEY], (F.col("whole") + F.col("p")).cast("long").alias("copies"))
    same_key = [F.col(k).eqNullSafe(F.col(f"c_{k}")) for k in KEY]
    match = same_key[0] & same_key[1] & same_key[2] & same_key[3]
    out = keyed.join(chosen, match).join(F.broadcast(sided) if few else sided, F.col("source").eqNullSafe(F.col("s")))
    return out.select("record", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of the mix: those taken twice appear twice, those not taken are gone."""
    out = copies(docs, **how)
    times = F.array_repeat(F.lit(0), F.col("copies").cast("int"))
    return out.filter("copies > 0").select("record", F.explode(times)).select("record.*")


def op6_mixing(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return copies(docs).select("record.doc_id", "size", "source_size", "target", "taken")
