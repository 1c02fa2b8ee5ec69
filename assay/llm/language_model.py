"""A hidden Markov language model and exact log probabilities of texts.

Tokens are words and one end per text. Up to ``HEAD`` words have emission probabilities of their own in every state; the
rarer ones form one class, which states emit as a whole and which shares its mass by counts, unknown words included. So the
model sums to one over all texts, and its arrays are bounded while the counts of all words stay a table that is joined.
Baum-Welch runs over all training texts: tasks add up expected counts, Spark sums them per symbol. Texts are cut into
segments, whose transfer matrices are multiplied along the text, so that long texts cost no more per token than short ones
and likelihoods remain exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.llm.labelled import remainder
from assay.llm.store import table, written
from assay.llm.text import lower_ascii, words

HEAD, STATES, ROUNDS = 60_000, 6, 3
SEGMENT, TOKENS = 128, 400_000
KAPPA = 5.0
SEED = 20240607


class Chain:
    """``start`` (before the first token), ``step`` (state to state) and ``emit`` (symbol by state)."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit = start, step, emit


class Segments:
    """Texts of symbols in rows of at most SEGMENT, long rows first."""

    def __init__(self, texts: list[np.ndarray]):
        sizes = np.array([len(t) for t in texts], int)
        pieces = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(sizes[owner] - nth * SEGMENT, SEGMENT)
        order = np.argsort(-size, kind="stable")
        place = np.empty(len(order), int)
        place[order] = np.arange(len(order))
        self.symbols = np.zeros((len(order), SEGMENT), int)
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        first = np.cumsum(pieces) - pieces
        self.symbols[place[np.repeat(first, sizes) + at // SEGMENT], at % SEGMENT] = np.concatenate(texts)
        self.size = size[order]
        self.active = (self.size[:, None] > np.arange(SEGMENT)).sum(axis=0)  # rows in use at each column
        by_nth = np.argsort(nth, kind="stable")
        cuts = np.searchsorted(nth[by_nth], np.arange(pieces.max(initial=0) + 1))
        #: for each position in a text: the texts that have it, and their rows
        self.levels = [
            (owner[by_nth[a:b]], place[by_nth[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)
        ]
        self.texts = len(texts)

    def transfer(self, chain: Chain) -> tuple[np.ndarray, np.ndarray]:
        """Each row's matrix from the state before to the state at its end, scaled, and the logarithms of the scales."""
        k = len(chain.start)
        m, scale = np.broadcast_to(np.eye(k), (len(self.size), k, k)).copy(), np.zeros(len(self.size))
        for t, n in enumerate(self.active):
            if not n:
                break
            new = (m[:n].reshape(n * k, k) @ chain.step).reshape(n, k, k) * chain.emit[self.symbols[:n, t]][:, None, :]
            top = new.reshape(n, -1).max(axis=1)
            m[:n] = new / top[:, None, None]
            scale[:n] += np.log(top)
        return m, scale

    def forward(self, chain: Chain, m: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods of the texts, and the state distribution before each row."""
        now = np.tile(chain.start, (self.texts, 1))
        total, before = np.zeros(self.texts), np.empty((len(self.size), len(chain.start)))
        for owners, rows in self.levels:
            before[rows] = now[owners]
            new = np.einsum("ij,ijk->ik", now[owners], m[rows])
            norm = new.sum(axis=1)
            now[owners] = new / norm[:, None]
            total[owners] += np.log(norm) + scale[rows]
        return total, before

    def likelihoods(self, chain: Chain) -> np.ndarray:
        return self.forward(chain, *self.transfer(chain))[0]

    def expected(self, chain: Chain) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Log likelihood, and expected counts of start states, of steps and of emissions (symbol by state)."""
        m, scale = self.transfer(chain)
        total, before = self.forward(chain, m, scale)
        k, rows_n = len(chain.start), len(self.size)
        after, now = np.empty((rows_n, k)), np.ones((self.texts, k))
        for owners, rows in reversed(self.levels):
            after[rows] = now[owners]
            new = np.einsum("ijk,ik->ij", m[rows], now[owners])
            now[owners] = new / new.sum(axis=1, keepdims=True)
        heads = self.levels[0][1] if self.levels else np.empty(0, int)
        alpha = np.empty((SEGMENT, rows_n, k))
        a = before
        for t, n in enumerate(self.active):
            new = (a[:n] @ chain.step) * chain.emit[self.symbols[:n, t]]
            a = alpha[t, :n] = new / new.sum(axis=1, keepdims=True)
        steps, emitted, b = np.zeros((k, k)), np.zeros_like(chain.emit), after
        for t in range(SEGMENT - 1, -1, -1):
            n = self.active[t]
            if not n:
                continue
            x = self.symbols[:n, t]
            g = alpha[t, :n] * b[:n]
            g /= g.sum(axis=1, keepdims=True)
            alpha[t, :n] = g
            e = chain.emit[x] * b[:n]
            back = e @ chain.step.T
            p = alpha[t - 1, :n] if t else before[:n]  # forward messages still: columns are replaced from the end
            norm = (p * back).sum(axis=1, keepdims=True)
            steps += (p / norm).T @ e
            b[:n] = back / back.sum(axis=1, keepdims=True)
        first = before[heads] * b[heads]
        start = (first / first.sum(axis=1, keepdims=True)).sum(axis=0)
        used = np.concatenate([self.symbols[:n, t] for t, n in enumerate(self.active) if n] or [np.empty(0, int)])
        for j in range(k):
            weight = np.concatenate([alpha[t, :n, j] for t, n in enumerate(self.active) if n] or [np.empty(0)])
            emitted[:, j] = np.bincount(used, weight, len(chain.emit))
        return float(total.sum()), start, steps * chain.step, emitted


def batches_of(texts: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Lists of texts of about TOKENS symbols."""
    some, held = [], 0
    for t in texts:
        some.append(t)
        held += len(t)
        if held >= TOKENS:
            yield some
            some, held = [], 0
    if some:
        yield some


def next_chain(start: np.ndarray, steps: np.ndarray, emitted: np.ndarray, unigram: np.ndarray) -> Chain:
    """Normalised counts; every emission keeps some of the unigram, so that nothing is impossible."""
    start, steps, emitted = start + 0.1, steps + 0.1, emitted + KAPPA * unigram[:, None]
    return Chain(start / start.sum(), steps / steps.sum(axis=1, keepdims=True), emitted / emitted.sum(axis=0))


def first_chain(unigram: np.ndarray, states: int, seed: int = SEED) -> Chain:
    """States that stay, with emissions moved at random."""
    rng = np.random.default_rng(seed)
    emit = unigram[:, None] * np.exp(rng.normal(0, 0.5, (len(unigram), states)))
    step = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(step, 0.9 if states > 1 else 1.0)
    return Chain(np.full(states, 1 / states), step, emit / emit.sum(axis=0))


def symbols_of(cell: bytes) -> np.ndarray:
    return np.frombuffer(cell, np.uint16)


class Vocabulary:
    """What training counted: ``head`` words with counts, and totals. Symbols: head words, the rare class, the end."""

    def __init__(self, counts: DataFrame, ends: int, head: int = HEAD):
        spread = counts.groupBy("c").agg(F.count("*").alias("words"))
        above = F.sum("words").over(Window.orderBy(F.col("c").desc()))
        # whole counts go to the head, as far as they fit: no tie is cut; words seen once teach what unknown words are like
        least = spread.withColumn("above", above).filter((F.col("above") <= head) & (F.col("c") > 1)).agg(F.min("c")).first()[0]
        self.cut = (1 << 62) if least is None else least
        rows = counts.filter(F.col("c") >= self.cut).orderBy("word").collect()  # at most ``head``
        all_words, tokens = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
        self.words = {r.word.encode(): i for i, r in enumerate(rows)}
        self.counts = np.array([r.c for r in rows], float)
        self.ends, self.tokens, self.types = ends, tokens + ends, all_words + (ends > 0)
        self.rare_tokens = tokens - int(self.counts.sum())
        self.rare_types = all_words - len(rows)
        self.rare, self.end = len(rows), len(rows) + 1

    def unigram(self) -> np.ndarray:
        c = np.concatenate([self.counts, [self.rare_tokens, self.ends]]) + 0.5
        return c / c.sum()

    def base_logs(self) -> np.ndarray:
        """log10 of the base probability by symbol; the rare class has 0, its words come from the join."""
        c = np.concatenate([self.counts, [0, self.ends]])
        logs = np.log10((c + 0.5) / (self.tokens + 0.5 * (self.types + 1)))
        logs[self.rare] = 0
        return logs


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` and ``c`` over the texts of ``docs``; counted per task before the shuffle."""
    return docs.select(F.explode(words(lower_ascii(F.col("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("c"))


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``docs`` with ``ids`` (16-bit symbols) and ``rare`` (the rare words, a blank between) in place of ``text``."""
    known, rare, end = vocabulary.words, vocabulary.rare, vocabulary.end

    @F.pandas_udf("ids binary, rare string")
    def encode(texts: pd.Series) -> pd.DataFrame:
        cells, others = [], []
        for text in texts:
            found = (text or "").encode().lower().split()
            ids = [known.get(w, rare) for w in found]
            others.append(b" ".join(w for w, i in zip(found, ids, strict=True) if i == rare).decode())
            cells.append(np.array([*ids, end], np.uint16).tobytes())
        return pd.DataFrame({"ids": cells, "rare": others})

    return docs.withColumn("code", encode("text")).select(
        *[c for c in docs.columns if c != "text"], "code.ids", "code.rare"
    )


def baum_welch(codes: DataFrame, unigram: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Chain:
    """Trained on all of ``codes`` (ids), from a seeded start; each round counts over all of them, however they are split."""
    chain = first_chain(unigram, states)
    size = len(unigram)
    columns = [f"s{j}" for j in range(states)]
    schema = "symbol int, " + ", ".join(f"{c} double" for c in columns)

    def packed(start, steps, emitted) -> pd.DataFrame:
        """Emissions by symbol; then a row for the start and one per state to step from."""
        extra = np.vstack([start, steps])
        some = np.flatnonzero(emitted.any(axis=1))
        frame = pd.DataFrame(np.vstack([emitted[some], extra]), columns=columns)
        frame.insert(0, "symbol", np.concatenate([some, size + np.arange(len(extra))]).astype(np.int32))
        return frame

    def unpacked(frame: pd.DataFrame) -> Chain:
        all_ = np.zeros((size + 1 + states, states))
        all_[frame["symbol"].to_numpy()] = frame[columns].to_numpy()
        return next_chain(all_[size], all_[size + 1 :], all_[:size], unigram)

    def add(texts: list[np.ndarray], chain: Chain, sums: list) -> None:
        for some in batches_of(texts):
            for total, part in zip(sums, Segments(some).expected(chain)[1:], strict=True):
                total += part

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [np.zeros(states), np.zeros((states, states)), np.zeros((size, states))]
        for rows in batches:
            add([symbols_of(c) for c in rows["ids"]], chain, sums)
        yield packed(*sums)

    for _ in range(rounds):
        summed = codes.mapInPandas(count, schema).groupBy("symbol").agg(*[F.sum(c).alias(c) for c in columns])
        found = summed.toPandas()  # a row per symbol: bounded by HEAD
        if not found.iloc[:, 1:].to_numpy().any():  # nothing to learn from
            return chain
        chain = unpacked(found)
    return chain


def language_model_scores(docs: DataFrame, held: str = "held", head: int = HEAD, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` (text, ``held`` and more) with n_tokens, n_known, train_tokens, base_score and score; learned where not ``held``.

    Both scores are log10 probabilities of the whole text with its end; a null text is the end alone. Repeated rows are
    scored and, in training, counted each for itself. Columns of ``docs`` are kept in ``record``. Without training texts the
    base is that of empty counts, and the model has the end and unknown words only.
    """
    record = F.struct(*[c for c in docs.columns if c not in ("text", held)]).alias("record")
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(held).alias("held"), record, "text")
    training = docs.filter(~F.col(held))
    counts = written(word_counts(training), "lm-counts")
    vocabulary = Vocabulary(counts, training.count(), head)

    # row numbers are fixed here: what follows reads them from this table
    codes = written(encoded(numbered, vocabulary), "lm-codes")
    chain = baum_welch(codes.filter("NOT held").select("ids"), vocabulary.unigram(), states, rounds)
    logs, rare, ends = vocabulary.base_logs(), vocabulary.rare, vocabulary.ends

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = [symbols_of(c) for c in rows["ids"]]
            found = [Segments(some).likelihoods(chain) for some in batches_of(texts)]
            yield pd.DataFrame({
                "row": rows["row"],
                "n_tokens": [len(t) for t in texts],
                "n_known": [int((t != rare).sum()) - (ends == 0) for t in texts],
                "base_score": [float(logs[t].sum()) for t in texts],
                "score": np.concatenate(found) / log(10) if found else [],
            })

    scored = codes.select("row", "ids").mapInPandas(
        score, "row long, n_tokens long, n_known long, base_score double, score double"
    )
    n, v = vocabulary.tokens, vocabulary.types
    rare_mass = vocabulary.rare_tokens + 0.5 * (vocabulary.rare_types + 1)
    c = F.coalesce("c", F.lit(0))
    # no word is hot here: those with many occurrences in training are in the head
    each = codes.filter("rare <> ''").select("row", F.explode(F.split("rare", " ")).alias("word")).groupBy("row", "word").agg(F.count("*").alias("n"))
    rare_sums = each.join(counts.filter(F.col("c") < vocabulary.cut), "word", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(F.lit(0))).alias("rare_known"),
        F.sum(F.col("n") * F.log10((c + 0.5) / (n + 0.5 * (v + 1)))).alias("rare_base"),
        F.sum(F.col("n") * F.log10((c + 0.5) / rare_mass)).alias("rare_score"),
    )
    zero = lambda name: F.coalesce(name, F.lit(0))
    return codes.select("row", "record", "held").join(scored, "row").join(rare_sums, "row", "left").select(
        "record", "held", "n_tokens", (F.col("n_known") + zero("rare_known")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + zero("rare_base")).alias("base_score"),
        (F.col("score") + zero("rare_score")).alias("score"),
    )


def op7_language_model(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held = remainder(F.col("doc_id"), 5) == 1
    out = language_model_scores(docs.withColumn("held", held))
    return out.select(
        "record.doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
