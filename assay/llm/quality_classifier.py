"""Quality by a regularised quadratic discriminant over document statistics.

Each class has a mean and a covariance of the statistics, the latter shrunk towards the pooled variances. They come from
sums over all labelled rows, made per task and added up. A document's score is the posterior from the difference of the two
log densities, by Mahalanobis distances with Cholesky factors that are computed once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.labelled import label_of, remainder
from assay.llm.store import table, written

SHRINKAGE = 0.1
NAMES = (
    "words", "word_length", "word_length_deviation", "distinct_words", "top_word", "stutter", "repeated_words",
    "repeated_lines", "line_words", "symbols", "lone_marks", "punctuation", "digits", "capitals", "letters", "one_case_words",
)
#: Below this share a statistic counts as this share: logarithms stay finite.
FLOOR = 0.002
_KIND = np.zeros((256, 5))
for _i, _chars in enumerate((b"#*$%&|<>", b".,;:!?'\"()-", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)))):
    _KIND[list(_chars), _i] = 1


def statistics(text: str | None) -> list[float]:
    """The statistics of one text in the order of ``NAMES``; those of a text without words are those of ratios 0."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    log = lambda part, whole: float(np.log(FLOOR + part / whole)) if whole else float(np.log(FLOOR))
    kinds = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _KIND
    lengths = np.fromiter(map(len, words), float, n)
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    often = sum(c for c in counts.values() if c > 5)
    marks = sum(c for w, c in counts.items() if len(w) <= 3 and not w.isalnum() and w.isascii())
    return [
        float(np.log1p(n)),
        float(np.log(lengths.mean())) if n else 0.0,
        float(np.log(0.1 + lengths.std())) if n else 0.0,
        float(np.log(len(counts) / n)) + 0.1 * float(np.log1p(n)) if n else 0.0,
        log(max(counts.values(), default=0), n),
        log(sum(map(eq, words, words[1:])), n),
        log(often, n),
        log(len(lines) - len(set(lines)), len(lines)),
        float(np.log1p(n / len(lines))) if lines else 0.0,
        *(log(k, len(data)) for k in kinds[:1]),
        log(marks, n),
        *(log(k, len(data)) for k in kinds[1:]),
        log(sum(c for w, c in counts.items() if w.isupper()), n),
    ]


class Discriminant:
    """Means, inverse Cholesky factors and log determinants by class, and the log odds of class 1."""

    def __init__(self, means, factors, offset: float):
        self.means, self.factors, self.offset = means, factors, offset

    def scores(self, x: np.ndarray) -> np.ndarray:
        distance = [(((x - m) @ f.T) ** 2).sum(axis=1) for m, f in zip(self.means, self.factors, strict=True)]
        return 1 / (1 + np.exp(-np.clip(0.5 * (distance[0] - distance[1]) + self.offset, -30, 30)))


def discriminant(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE) -> Discriminant:
    """From each class's count, sums and sums of products. A class without two rows leaves the prior alone."""
    width = len(NAMES)
    counts = [sums[c][0] if c in sums else 0.0 for c in (0, 1)]
    odds = float(np.log((counts[1] + 0.5) / (counts[0] + 0.5)))
    if min(counts) < 2:
        zero = np.zeros((width, width))
        return Discriminant([np.zeros(width)] * 2, [zero, zero], odds)
    means = [sums[c][1] / sums[c][0] for c in (0, 1)]
    spread = [sums[c][2] - sums[c][0] * np.outer(m, m) for c, m in zip((0, 1), means, strict=True)]
    pooled = np.diag(np.maximum(np.diag(spread[0] + spread[1]) / max(sum(counts) - 2, 1), 1e-6))
    factors, logs = [], []
    for c in (0, 1):
        shrunk = (1 - shrinkage) * spread[c] / (counts[c] - 1) + shrinkage * pooled
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(lower))
        logs.append(2 * np.log(np.diag(lower)).sum())
    return Discriminant(means, factors, odds + 0.5 * (logs[0] - logs[1]))


def described(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``stats``, the statistics of every row's whole text."""

    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    return docs.select("doc_id", stats("text").alias("stats"))


def learned(stats: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE) -> Discriminant:
    """A discriminant from all of ``labels`` (doc_id, label) that ``stats`` has."""
    width = len(NAMES)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {}
        for rows in batches:
            for label, part in rows.groupby("label"):
                x = np.stack(part["stats"].to_numpy())
                add = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
                total[label] = total.get(label, 0) + add
        for label, values in total.items():
            yield pd.DataFrame({"label": int(label), "at": np.arange(len(values)), "value": values})

    parts = stats.join(labels, "doc_id").select("label", "stats").mapInPandas(sums, "label int, at int, value double")
    found = {}
    for row in parts.groupBy("label", "at").agg(F.sum("value").alias("value")).collect():  # a few hundred rows
        found.setdefault(row.label, np.zeros(1 + width + width * width))[row.at] = row.value
    split = {c: (v[0], v[1 : 1 + width], v[1 + width :].reshape(width, width)) for c, v in found.items()}
    return discriminant(split, shrinkage)


def scored(stats: DataFrame, model: Discriminant) -> DataFrame:
    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(x.to_numpy())) if len(x) else [], dtype="float64")

    return stats.select("doc_id", score("stats").alias("score"))


def op9_quality(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    stats = written(described(docs), "quality-stats")
    usable = label_of(table(spark, folder, "labels"), "quality").filter(remainder(F.col("doc_id"), 3) != 1)
    return scored(stats, learned(stats, usable)).select(
        "doc_id",
        (remainder(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
