"""Benchmark passages in documents, found by winnowing.

A window is ``span`` consecutive words of an item, or the whole of a shorter item. The fingerprints of a text are, for each
run of ``span`` words, the least hash of the word ``gram``-grams in it. Two texts that share a run of ``span`` words share
that run's fingerprint, so every such passage is found by an equality join of fingerprints. Hits are then extended: the runs
around a matched gram are compared with the items' windows as text, so no false hit remains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.store import table, written
from assay.llm.text import lower_ascii

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, a-z and anything beyond ASCII, after lower-casing A-Z; none of null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _starts(n: Column, run: int) -> Column:
    """0 to n - run, or none."""
    return F.when(n >= run, F.sequence(F.lit(0), n - run)).otherwise(F.array().cast("array<int>"))


def _runs(words: Column, run: int) -> Column:
    """All runs of ``run`` words, each as one text; words hold no blanks."""
    return F.transform(_starts(F.size(words), run), lambda i: F.array_join(F.slice(words, i + 1, run), " "))


def _with_grams(texts: DataFrame, gram: int) -> DataFrame:
    w = F.col("w")
    hashed = F.transform(
        _starts(F.size(w), gram), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(gram)])
    )
    return texts.withColumn("grams", hashed)


def _winnowed(grams: Column, window: int) -> Column:
    least = F.transform(_starts(F.size(grams), window), lambda i: F.array_min(F.slice(grams, i + 1, window)))
    return F.array_distinct(least)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    span: int = 10,
    gram: int = 5,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Per distinct (doc_id, text) with a hit: ``id``, ``mark``, ``starts`` (array of struct: first word, length) and ``items``.

    ``mark`` is a hash of the text, which tells rows with one id apart; ``keyed`` gives both for joining back. Nulls and
    texts without words have no windows. Items with a null id count as hits but are not listed. Items shorter than ``span``
    are looked for as a whole among all runs of their length, since winnowing promises nothing for them.
    """
    items = items.select(F.col(item_id).cast("string").alias("item"), words(items[item_text]).alias("w"))
    n = F.size("w")
    whole = items.filter((n > 0) & (n < span)).select("item", n.alias("length"), F.array_join("w", " ").alias("run"))
    long = items.filter(n >= span).select("item", F.lit(span).alias("length"), F.explode(_runs(F.col("w"), span)).alias("run"))
    windows = written(whole.unionByName(long).distinct(), "item-windows")
    prints = written(
        _with_grams(items, gram).select(F.explode(_winnowed(F.col("grams"), span - gram + 1)).alias("print")).distinct(),
        "item-prints",
    )

    keys = keyed(docs, doc_id, text)
    texts = keys.select("id", "mark", words(F.col("text")).alias("w"))
    found = (
        _with_grams(texts, gram)
        .select("id", "mark", F.explode(_winnowed(F.col("grams"), span - gram + 1)).alias("print"))
        .join(prints, "print", "left_semi")
        .distinct().groupBy("id", "mark").agg(F.collect_list("print").alias("prints"))
    )
    chosen = join_marks(keys, found).select("id", "mark", words(F.col("text")).alias("w"), "prints")
    # Of a matched gram at p, the runs that begin at p - (span - gram) to p hold it.
    at = F.filter(
        F.transform("grams", lambda g, p: F.when(F.array_contains(F.col("prints"), g), p)), lambda p: p.isNotNull()
    )
    around = F.array_distinct(
        F.flatten(F.transform(at, lambda p: F.sequence(F.greatest(p - (span - gram), F.lit(0)), p)))
    )
    around = F.filter(around, lambda s: s <= F.size("w") - span)
    run = F.transform(around, lambda s: F.struct(s.alias("s"), F.array_join(F.slice("w", s + 1, span), " ").alias("run")))
    runs = _with_grams(chosen.distinct(), gram).select("id", "mark", F.inline(run)).withColumn("length", F.lit(span))

    # at most span - 1 lengths, those that short items have
    for m in sorted(r.length for r in whole.select("length").distinct().collect()):
        starts = _starts(F.size("w"), m)
        some = F.arrays_zip(starts.alias("s"), _runs(F.col("w"), m).alias("run"))
        of_length = windows.filter(F.col("length") == m).select("run").distinct()
        short = texts.select("id", "mark", F.inline(some).alias("s", "run")).join(of_length, "run", "left_semi").distinct()
        runs = runs.unionByName(short.withColumn("length", F.lit(m)))

    return (
        runs.join(windows, ["length", "run"])
        .groupBy("id", "mark")
        .agg(F.collect_set(F.struct("s", "length")).alias("starts"), F.collect_set("item").alias("items"))
    )


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``mark`` and ``text`` of every row."""
    return docs.select(docs[doc_id].alias("id"), F.xxhash64(docs[text]).alias("mark"), docs[text].alias("text"))


def join_marks(keys: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """``keys`` with the other columns of ``found``, by id and mark; null is a value like others."""
    found = found.withColumnsRenamed({"id": "found_id", "mark": "found_mark"})
    same = F.col("id").eqNullSafe(F.col("found_id")) & F.col("mark").eqNullSafe(F.col("found_mark"))
    return keys.join(found, same, how).drop("found_id", "found_mark")


def n_hit(starts: Column) -> Column:
    """The number of words that runs of (s, length) cover: sorted, each adds what reaches beyond those before it."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc, x):
        end = F.greatest(acc["end"], x["s"] + x["length"])
        return F.struct(end.alias("end"), (acc["n"] + end - F.greatest(acc["end"], x["s"])).alias("n"))

    # A run inside one before it adds nothing: its end doesn't reach beyond, and greatest(end, s) is that end.
    return F.aggregate(F.array_sort(starts), zero, add, lambda acc: acc["n"])


def without_contaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item."""
    hits = contamination(docs, items, **how)
    rows = docs.select(
        docs["doc_id"].alias("id"), F.xxhash64(docs["text"]).alias("mark"), F.struct(*[docs[c] for c in docs.columns]).alias("record")
    )
    return join_marks(rows, hits.select("id", "mark"), "left_anti").select("record.*")


def op5_decontaminate(spark, folder):
    docs = table(spark, folder, "documents")
    hits = contamination(docs, table(spark, folder, "benchmark"))
    ids = F.array_sort("items")
    return join_marks(keyed(docs), hits, "left").select(
        F.col("id").alias("doc_id"),
        F.size(words(F.col("text"))).cast("long").alias("n_words"),
        F.coalesce(n_hit(F.col("starts")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join(ids, ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        F.col("starts").isNotNull().alias("contaminated"),
    )


OP5_SQL = r"""
WITH d AS (
    SELECT doc_id, row_number() OVER () AS k, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
        lambda x: x <> '') AS w
    FROM documents
), i AS (
    SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
        lambda x: x <> '') AS w
    FROM benchmark
), iw AS (
    SELECT DISTINCT item_id, m, array_to_string(list_slice(w, s, s + m - 1), ' ') AS run
    FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s
          FROM i WHERE len(w) > 0)
), dw AS (
    SELECT k, m, s, array_to_string(list_slice(w, s, s + m - 1), ' ') AS run
    FROM (SELECT k, w, m, unnest(range(1, len(w) - m + 2)) AS s
          FROM d CROSS JOIN (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)
), hit AS (
    SELECT k, m, s, item_id FROM dw JOIN iw USING (m, run)
), words AS (
    SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(s, s + m)) AS p FROM hit) GROUP BY k
), ids AS (
    SELECT k, count(DISTINCT item_id) AS n_items,
        array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids
    FROM hit GROUP BY k
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN ids USING (k)
"""
