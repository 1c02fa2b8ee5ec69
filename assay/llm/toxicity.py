"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct words and their first four and five letters, hashed to ``DIMENSIONS``. The machine adds to the
usual weights a factor vector per term, whose products score pairs of terms that occur together. It learns from a bounded
sample of labelled rows: up to ``SAMPLE`` by a hash of the id. The ``TERMS`` that tell the classes apart best in the sample
get weights; every whole text is scored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.labelled import label_of, remainder
from assay.llm.store import table, written

DIMENSIONS, TERMS, FACTORS = 1 << 20, 2048, 4
SAMPLE = 8000
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class TermIds(dict):
    """The hashed terms of a word, remembered for up to 500,000 words."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= 500_000:
            self.clear()
        bare = word.strip(MARKS).decode()
        terms = [f"w {bare}"] + [f"p {bare[:k]}" for k in (4, 5) if len(bare) >= k] if bare else []
        self[word] = ids = tuple(xxhash.xxh64_intdigest(t) % DIMENSIONS for t in terms)
        return ids


def term_ids(text: str | None, known: TermIds) -> np.ndarray:
    words = set((text or "").encode().lower().split())
    found = {i for w in words for i in known[w]}
    return np.fromiter(found, np.int32, len(found))


class Machine:
    """A trained model: bias, and weights and factors of the terms in ``terms``."""

    def __init__(self, bias: float, terms: np.ndarray, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.terms, self.weights, self.factors = bias, terms, weights, factors

    def lookup(self) -> np.ndarray:
        """Term to row; the terms without weights go to a last row of zeros."""
        rows = np.full(DIMENSIONS, len(self.terms), np.int32)
        rows[self.terms] = np.arange(len(self.terms))
        return rows

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probabilities, of rows of term places below ``len(terms)``."""
        flat, starts, full = _flat(rows)
        out = np.full(len(rows), self.bias)
        if len(flat):
            v = self.factors[flat]
            total = np.add.reduceat(v, starts, axis=0)
            pairs = 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((v**2).sum(axis=1), starts))
            out[full] += np.add.reduceat(self.weights[flat], starts) + pairs
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All places in one array, where each row that has some begins, and which rows those are."""
    sizes = np.array([len(r) for r in rows], int)
    full = np.flatnonzero(sizes)
    flat = np.concatenate([rows[i] for i in full]) if len(full) else np.empty(0, int)
    return flat, np.concatenate([[0], np.cumsum(sizes[full])[:-1]]).astype(int) if len(full) else np.empty(0, int), full


def trained(
    rows: list[np.ndarray], labels: np.ndarray, terms: int = TERMS, factors: int = FACTORS, epochs: int = 60,
    rate: float = 0.05, decay: float = 1e-4, batch: int = 512, seed: int = 7,
) -> Machine:
    """Logistic loss by Adam in mini-batches. With one class or no row the model is its prior."""
    labels = labels.astype(float)
    prior = (labels.sum() + 0.5) / (len(labels) + 1)
    bias = float(np.log(prior / (1 - prior)))
    ones, zeros = labels == 1, labels == 0
    if not ones.any() or not zeros.any():
        return Machine(bias, np.empty(0, np.int32), np.zeros(1), np.zeros((1, factors)))
    count = lambda which: np.bincount(
        np.concatenate([rows[i] for i in np.flatnonzero(which)] or [np.empty(0, int)]), minlength=DIMENSIONS
    )
    a, b = count(ones), count(zeros)
    share = (a + b + 1) / (len(labels) + 2)
    z = (a / ones.sum() - b / zeros.sum()) / np.sqrt(share * (1 - share) * (1 / ones.sum() + 1 / zeros.sum()) + 1e-12)
    z[a + b < 3] = 0
    chosen = np.sort(np.argsort(-np.abs(z), kind="stable")[:terms])
    chosen = chosen[z[chosen] != 0].astype(np.int32)
    rng = np.random.default_rng(seed)
    weights, v = np.zeros(len(chosen) + 1), rng.normal(0, 0.02, (len(chosen) + 1, factors))
    v[-1] = 0
    model = Machine(bias, chosen, weights, v)
    places = model.lookup()
    rows = [(p := places[r])[p < len(chosen)] for r in rows]
    params = [np.array([bias]), weights, v]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = [rows[i] for i in order[at : at + batch]]
            flat, starts, full = _flat(part)
            off = model.scores(part) - labels[order[at : at + batch]]
            sizes = np.diff(np.append(starts, len(flat)))
            each = np.repeat(off[full], sizes)
            total = np.repeat(np.add.reduceat(v[flat], starts, axis=0), sizes, axis=0) if len(flat) else v[:0]
            g_w, g_v = np.bincount(flat, each, len(weights)), np.zeros_like(v)
            for f in range(factors):
                g_v[:, f] = np.bincount(flat, each * (total[:, f] - v[flat, f]), len(weights))
            n, step = len(part), step + 1
            grads = [np.array([off.mean()]), g_w / n + decay * weights, g_v / n + decay * v]
            for p, g, m, s in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            weights[-1], v[-1] = 0, 0
            model.bias = float(params[0][0])
    return model


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine from labelled rows outside the held-out fifth, of which up to ``sample`` by hash of the id.

    Rows that repeat an id and a text are learned from once, and of an id with several texts up to ``sample`` rows in all.
    """
    usable = label_of(labels, "toxic").filter(remainder(F.col("doc_id"), 5) != 0)
    few = written(usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "toxic-sample")

    def ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = TermIds()
        for rows in batches:
            found = [np.sort(term_ids(t, known)).tobytes() for t in rows["text"]]
            yield pd.DataFrame({"label": rows["label"], "place": rows["place"], "ids": found})

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "label"], kind="stable")
        model = trained([np.frombuffer(b, np.int32) for b in rows["ids"]], rows["label"].to_numpy())
        return pd.DataFrame({"model": [pickle.dumps(vars(model))]})

    # the sample is bounded by its argument, so both the broadcast and the one task that fits are, whatever ids repeat
    chosen = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("label", F.xxhash64("doc_id", "text").alias("place"), "text")
    chosen = chosen.groupBy("place", "label").agg(F.first("text").alias("text"))
    features = chosen.mapInPandas(ids, "label int, place long, ids binary").orderBy("place", "label").limit(sample)
    fitted = features.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(fit, "model binary").first()
    if fitted is None:
        return trained([], np.empty(0))
    return Machine(**pickle.loads(fitted.model))


def scored(docs: DataFrame, model: Machine) -> DataFrame:
    """``docs`` with ``toxicity``, the probability of being toxic; null and empty texts have the bias alone.

    All columns are kept in ``record``, which does not pass through Python: only the text does.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, places = TermIds(), model.lookup()
        for texts in batches:
            found = [(p := places[term_ids(t, known)])[p < len(model.terms)] for t in texts]
            yield pd.Series(model.scores(found))

    record = F.struct(*[docs[c] for c in docs.columns]).alias("record")
    return docs.select(record, score(docs["text"]).alias("toxicity"))


def op3_toxicity(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = scored(docs, learned(docs, table(spark, folder, "labels")))
    doc_id = F.col("record.doc_id")
    return out.select(
        doc_id.alias("doc_id"),
        (remainder(doc_id, 5) == 0).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )
