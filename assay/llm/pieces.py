"""SentencePiece encoding and decoding for models of merged pairs (BPE), whole texts of any length.

A text's encoding is unique, and so is that of each prefix. The table keeps the last piece of every prefix's encoding: of the
pieces that an automaton finds to end there, the one that can stand beside the last piece of the prefix before it. Two pieces
can stand side by side if merging their joined text gives the two again; since merges inside one piece don't depend on what
stands beyond its neighbours, pairs decide on whole sequences. The ids are then recovered from the end backwards. The time is
linear in the length of the text, where merging itself needs a queue over the whole text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.store import table

SPACE = "▁"
#: What a worker remembers: chunks of at most so many characters, and twice so many chunks or pairs.
SHORT, REMEMBERED = 48, 200_000


class _Memory(dict):
    """Results by key. A full memory becomes the older one, and what isn't asked for again is forgotten with that."""

    def __init__(self, find):
        super().__init__()
        self.find, self.older = find, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.find(key)
            if len(key) > SHORT:
                return found
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


def _splitter(pieces):
    """A function that cuts texts where no merge can go across, as the two characters stand side by side in no piece.

    That holds before a space where no piece has one inside, and between letters, with all characters that stand beside them
    in some piece and beside those, and other characters.
    """
    pairs = {(a, b) for piece in pieces for a, b in zip(piece, piece[1:], strict=False)}
    if any(b == SPACE != a for a, b in pairs):
        return lambda text: [text] if text else []
    pairs = {pair for pair in pairs if SPACE not in pair}
    letters: set[str] = set()
    more = {c for piece in pieces for c in piece if c.isalpha()}
    while more:
        letters |= more
        more = {c for pair in pairs if letters & {*pair} for c in pair} - letters
    inside = "".join(map(re.escape, sorted(letters)))
    return re.compile(f"{SPACE}*[{inside}]+|{SPACE}*[^{inside}{SPACE}]+|{SPACE}+").findall


class PrefixTables:
    """The pieces of a model, and encodings by tables of prefixes."""

    def __init__(self, model: bytes):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        sp, ids = self.processor, range(self.processor.get_piece_size())
        bytes_ = {sp.id_to_piece(i): i for i in ids if sp.is_byte(i)}
        if len(bytes_) != 256:
            raise ValueError("the model needs pieces for all bytes")
        self.byte_ids = [bytes_[f"<0x{b:02X}>"] for b in range(256)]
        self.ids = {
            sp.id_to_piece(i): i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))
        }
        self.score = {piece: sp.get_score(i) for piece, i in self.ids.items()}
        self.history: dict[str, tuple | None] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if self._merged(piece) is not None:
                self.automaton.add_word(piece, (len(piece), piece))
        self.automaton.make_automaton()
        self.chunks = _splitter(self.ids)
        self.known = _Memory(self._ids)
        self.beside = _Memory(self._beside)

    def _merged(self, piece: str):
        """How merging makes ``piece``: the scores of its steps and the first and the last symbol before, between and after.

        None if merging ends with other symbols, so that the piece never occurs.
        """
        if piece in self.history:
            return self.history[piece]
        symbols, scores, first, last = list(piece), [], [piece[0]], [piece[-1]]
        while len(symbols) > 1:
            steps = [(self.score[a + b], -i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in self.score]
            if not steps:
                break
            score, at = max(steps)
            symbols[-at : 2 - at] = [symbols[-at] + symbols[1 - at]]
            scores.append(score)
            first.append(symbols[0])
            last.append(symbols[-1])
        found = (scores, first, last) if len(symbols) == 1 else None
        if piece in self.ids:
            self.history[piece] = found
        return found

    def _beside(self, pair: tuple[str, str]) -> bool:
        """Whether merging the joined text of two pieces never joins them.

        Both pieces' steps go on by score, the left first where equal; between them the two symbols at the border may merge.
        """
        left, _, ends = self._merged(pair[0])
        right, begins, _ = self._merged(pair[1])
        i = j = 0
        while True:
            across = self.score.get(ends[i] + begins[j])
            a = left[i] if i < len(left) else None
            b = right[j] if j < len(right) else None
            if across is not None and (a is None or across > a) and (b is None or across >= b):
                return False
            if a is None and b is None:
                return True
            if b is None or (a is not None and a >= b):
                i += 1
            else:
                j += 1

    def last_pieces(self, text: str) -> list[str | None]:
        """For every prefix the last piece of its encoding; None where that is a character without a piece."""
        table: list = [None] * (len(text) + 1)
        beside = self.beside
        for at, (length, piece) in self.automaton.iter(text):
            at += 1
            if table[at] is None:
                start = at - length
                if not start or beside[table[start] or text[start - 1], piece]:
                    table[at] = piece
        return table

    def _ids(self, chunk: str) -> bytes:
        table, at, back = self.last_pieces(chunk), len(chunk), []
        while at:
            piece = table[at]
            if piece is None:
                at -= 1
                back += [self.byte_ids[b] for b in reversed(chunk[at].encode())]
            else:
                at -= len(piece)
                back.append(self.ids[piece])
        back.reverse()
        return array("i", back).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers, without special ones."""
        return b"".join(map(self.known.__getitem__, self.chunks(self.processor.normalize(text))))


@lru_cache(1)
def tables(model: bytes) -> PrefixTables:
    return PrefixTables(model)


def read_model(path: str) -> bytes:
    """The model's file, which only the driver needs to reach."""
    with open(path, "rb") as file:
        return file.read()


def encoder(spark: SparkSession, model: bytes, end: bool = True):
    """A function of a text column: array of ids, closed by the model's end id if ``end``. Null counts as empty."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = tables(shared.value)
        closing = np.array([coder.processor.eos_id()] if end else [], np.int32).tobytes()
        for texts in batches:
            rows = [coder.encode(t.as_py() or "") + closing for t in texts]
            offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(rows), np.int32))
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, type=ID_LIST)

    return encode


ID_LIST = pa.list_(pa.field("element", pa.int32(), False))


def decoder(spark: SparkSession, model: bytes):
    """A function of a column of ids: the text as the library decodes it. Null stays null."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.StringType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        processor = tables(shared.value).processor
        for rows in batches:
            offsets, ids = rows.offsets.to_numpy().tolist(), rows.values.to_numpy()
            texts = [processor.decode(ids[a:b].tolist()) for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.array(texts, pa.string(), mask=rows.is_null().to_numpy(zero_copy_only=False))

    return decode


def encoded(docs: DataFrame, model: bytes, text: str = "text", end: bool = True) -> DataFrame:
    """Per row: ``record`` (the row) and ``ids``.

    The ids are those that the library gives for the whole text. A null or empty text has none but the end id; repeated rows
    stay; a table without rows gives none; columns of any name travel in ``record``. A worker holds one Arrow batch, the
    tables of the longest run without spaces, and ``REMEMBERED`` short results.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("record"), docs[text].alias("text"))
    return rows.select("record", encoder(docs.sparkSession, model, end)("text").alias("ids"))


def joined(ids: Column) -> Column:
    """The ids in decimal, with one space between them."""
    return F.array_join(ids.cast("array<string>"), " ")


def op11_pieces(spark, folder, path: str = public_tokenizers.path("piece_bpe_32k.model")):
    """All documents encoded with an end id, and decoded again, as digests."""
    model = read_model(path)
    done = encoded(table(spark, folder, "documents"), model)
    decode = decoder(spark, model)
    return done.select(
        F.col("record.doc_id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined(F.col("ids")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(decode("ids").cast("binary"), 256).alias("decoded_sha256"),
    )
