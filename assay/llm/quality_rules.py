"""Document quality by fixed rules and by a likelihood ratio of hashed n-grams.

Two multinomials over ``buckets`` hashed word and word-pair counts are estimated, one from trusted documents and one from
all. A document's score is the mean over its n-grams of the log ratio of the two; it is kept from ``threshold`` on. All of
it is built-in functions; the two models are one bounded array.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.store import table
from assay.llm.text import lower_ascii, words

BUCKETS = 1 << 14
THRESHOLD = -0.3
#: Words and runs of other signs, so that marks glued to words count for themselves.
TOKENS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"
WINDOW = 5


def _starts(n: Column, run: int) -> Column:
    return F.when(n >= run, F.sequence(F.lit(0), n - run)).otherwise(F.array().cast("array<int>"))


def with_rules(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words and base_failed."""
    text = F.coalesce("text", F.lit(""))
    w, h, places = F.col("w"), F.col("h"), F.col("places")
    lines = F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))
    docs = docs.withColumns({"w": words(F.col("text")), "lines": lines})
    docs = docs.withColumn(
        "h",
        F.transform(_starts(F.size(w), WINDOW), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)])),
    )
    # Sorted by hash, equal windows are neighbours. Most texts repeat no window and need no sort.
    some = F.size(F.array_distinct(h)) < F.size(h)
    pairs = F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    docs = docs.withColumn("places", F.when(some, F.sort_array(pairs)))
    twice = F.transform(
        places,
        lambda p, i: F.when((F.get(places, i - 1)["x"] == p["x"]) | (F.get(places, i + 1)["x"] == p["x"]), p["i"]),
    )
    starts = F.sort_array(F.filter(twice, lambda p: p.isNotNull()))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(
        starts,
        zero,
        lambda a, s: F.struct(
            (s + WINDOW).alias("end"), (a["n"] + s + WINDOW - F.greatest(a["end"], s)).alias("n")
        ),
        lambda a: a["n"],
    )
    docs = docs.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    n = F.size(w).cast("long")
    return docs.withColumns({
        "n_words": n,
        "word_chars": F.char_length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "base_failed": (n < 10) | (100 * F.col("n_repeat_words") > 20 * n),
    }).drop("w", "h", "places", "lines")


def with_grams(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with ``grams``: the bucket of every token and of every pair of neighbouring tokens."""
    t = F.col("tokens")
    docs = docs.withColumn("tokens", F.regexp_extract_all(lower_ascii(F.coalesce("text", F.lit(""))), F.lit(TOKENS), F.lit(0)))
    one = F.transform(t, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
    two = F.transform(
        _starts(F.size(t), 2), lambda i: F.pmod(F.xxhash64(F.get(t, i), F.get(t, i + 1)), F.lit(buckets)).cast("int")
    )
    return docs.withColumn("grams", F.concat(one, two)).drop("tokens")


def ratio_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: float = 1.0) -> np.ndarray:
    """Per bucket the log of its share in trusted documents over its share in all, each count raised by ``prior``.

    ``docs`` is (doc_id, text), ``trusted`` (doc_id), each id once. Counts cover all rows; what reaches the driver is a row
    per bucket. Without trusted documents all weights are 0.
    """
    flagged = docs.join(trusted.withColumn("good", F.lit(1)).hint("shuffle_hash"), "doc_id", "left")
    # explode would also filter on the array's size, below the projection that made it, and build it once per element there
    grams = with_grams(flagged, buckets).select("good", F.explode_outer("grams").alias("bucket"))
    counted = grams.groupBy("bucket").agg(F.count("*").alias("n"), F.count("good").alias("good")).collect()
    all_, good = np.full(buckets, prior), np.full(buckets, prior)
    for row in (r for r in counted if r.bucket is not None):
        all_[row.bucket] += row.n
        good[row.bucket] += row.good
    if not any(row.good for row in counted):
        return np.zeros(buckets)
    return np.log(good / good.sum()) - np.log(all_ / all_.sum())


def with_score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` with ``score``, the mean weight of a text's n-grams; 0 without any."""
    # as JSON, which becomes one constant array
    w = F.from_json(F.lit(json.dumps(weights.tolist())), "array<double>")
    total = F.aggregate("grams", F.lit(0.0), lambda a, b: a + F.get(w, b))
    n = F.size("grams")
    return (
        with_grams(docs, len(weights))
        .withColumn("score", F.when(n > 0, total / n).otherwise(F.lit(0.0)))
        .drop("grams")
    )


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its rules, its score and ``kept``.

    Trusted documents are those that ``labels`` (doc_id, quality) gives 1 and never 0. A null text has no words and fails
    the base; a null doc_id is in no trusted set.
    """
    docs = docs.select("doc_id", "text")
    trusted = (
        labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("worst"))
        .filter("worst = 1").select("doc_id")
    )
    weights = ratio_weights(docs, trusted, buckets)
    return with_score(with_rules(docs), weights).withColumn(
        "kept", ~F.col("base_failed") & (F.col("score") >= threshold)
    )


def op10_quality_rules(spark, folder):
    judged = quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )
