"""Fill-in-the-middle: texts cut at two units and put in another order, so that a model learns to write what is missing.

Units are runs of ASCII letters and single other code points. The cuts are found without looking at characters one by one:
the UTF-8 bytes of a batch are viewed as 64-bit words, the bytes that end a unit get their top bit by arithmetic on whole
words, ``bitwise_count`` counts them per word, a search in the running counts finds the word of a cut, and a prefix sum inside
that word finds the byte. Everything else is done by Spark's own functions on the byte positions that come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEED = 1
PLAIN_FROM, SPM_BELOW = 90, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of text that are looked at together, unless one text is longer.
BLOCK = 4 << 20

_EACH = 0x0101010101010101
_ONES, _TOPS, _LOWS = np.uint64(_EACH), np.uint64(0x80 * _EACH), np.uint64(0x7F * _EACH)
_CASE, _FROM_A, _AFTER_Z = np.uint64(0x20 * _EACH), np.uint64((0x80 - ord("a")) * _EACH), np.uint64((0x7F - ord("z")) * _EACH)
_ONE, _SEVEN, _EIGHT, _FIFTY_SIX = np.uint64(1), np.uint64(7), np.uint64(8), np.uint64(56)

CUTS = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "first", "second", "prefix_chars", "middle_chars")])
ARROW = pa.struct([(c, pa.int64()) for c in CUTS.names])


class _Marks:
    """Marked bytes (top bits) of 64-bit words, with their running counts."""

    def __init__(self, words: np.ndarray):
        self.words = np.append(words, np.uint64(0))
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many marked bytes stand before byte ``at``."""
        word, inside = at >> 3, (at & 7).astype(np.uint64)
        below = (_ONE << (inside << np.uint64(3))) - _ONE
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte of the ``k``-th mark, from 1."""
        word = np.searchsorted(self.before, k, side="left") - 1
        inside = (k - self.before[word]).astype(np.uint64)
        upto = (self.words[word] >> _SEVEN) * _ONES  # byte j: marks in bytes 0 to j
        reached = ((upto | _TOPS) - inside * _ONES) & _TOPS
        return (word << 3) + 8 - np.bitwise_count(reached)


def _following(marks: np.ndarray) -> np.ndarray:
    """Each byte gets the mark of the byte after it."""
    out = marks >> _EIGHT
    out[:-1] |= marks[1:] << _FIFTY_SIX
    return out


def _marked(data: np.ndarray, ends: np.ndarray) -> tuple[_Marks, _Marks]:
    """Bytes that end a unit and bytes that begin a code point, of texts that end before the bytes ``ends``."""
    padded = np.zeros(-(-len(data) // 8) * 8, np.uint8)
    padded[: len(data)] = data
    words = padded.view("<u8")
    folded = (words & _LOWS) | _CASE
    letter = (folded + _FROM_A) & ~(folded + _AFTER_Z) & ~words & _TOPS
    inner = words & ~(words << _ONE) & _TOPS  # 10xxxxxx: not the first byte of a code point
    end = (letter & ~_following(letter)) | (~letter & ~_following(inner) & _TOPS)
    last = end.view(np.uint8)
    last[ends[ends > 0] - 1] |= 0x80  # whatever the next text begins with
    last[len(data) :] = 0
    start = ~inner & _TOPS
    start.view(np.uint8)[len(data) :] = 0
    return _Marks(end), _Marks(start)


def cuts(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> list[np.ndarray]:
    """Units, both cuts as byte positions in the text, and the code points before and between them, of texts in one buffer.

    The cuts stand after ``h % (units + 1)`` units, the smaller first.
    """
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    starts = offsets[:-1]
    end, point = _marked(data, offsets[1:])
    done = end.rank(starts)
    n = end.rank(offsets[1:]) - done
    places = []
    for k in (np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))):
        at = starts.copy()
        some = k > 0
        at[some] = end.select(done[some] + k[some]) + 1
        places.append(at)
    chars = [point.rank(x) for x in (starts, *places)]
    return [n, places[0] - starts, places[1] - starts, chars[1] - chars[0], chars[2] - chars[1]]


def _blocks(offsets: np.ndarray) -> Iterator[slice]:
    """Consecutive rows of ``BLOCK`` bytes at most, or one row."""
    at = 0
    while at < len(offsets) - 1:
        upto = max(int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1, at + 1)
        yield slice(at, upto)
        at = upto


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False)


@F.arrow_udf(CUTS)
def _cuts(texts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for text, h1, h2 in texts:
        kind = np.int64 if pa.types.is_large_binary(text.type) else np.int32
        _, where, values = text.buffers()
        if not len(text):
            yield pa.array([], ARROW)
            continue
        offsets = np.frombuffer(where, kind, len(text) + 1, text.offset * np.dtype(kind).itemsize).astype(np.int64)
        data = np.frombuffer(values if values is not None else b"", np.uint8)
        a, b = _numbers(h1), _numbers(h2)
        parts = [cuts(data, offsets[s.start : s.stop + 1], a[s], b[s]) for s in _blocks(offsets)]
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=CUTS.names)


def _group(digest: Column, i: int) -> Column:
    """The ``i``-th 8-digit group of a hex digest as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * i - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """Per row: ``record`` (the row), ``n`` units, ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars``, ``output``.

    Cuts and forms depend on ``seed`` and the id alone, so reruns agree and rows of one id are cut by the same draws. A null
    text counts as empty, and an empty text or one that holds a sentinel stays plain; a null id is drawn as an empty one.
    Tables without rows give none, repeated rows stay, and columns of any name travel in ``record``. Texts are cut whole;
    a task holds one Arrow batch and some 20 times ``BLOCK`` bytes, or 20 times its longest text.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[doc_id].cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("record"),
        F.coalesce(docs[text], F.lit("")).alias("text"),
        *[_group(digest, i).alias(f"h{i}") for i in range(1, 5)],
    )
    raw, cut = F.col("text").cast("binary"), F.col("cut")
    held = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | held | (F.col("h3") % 100 >= PLAIN_FROM)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < SPM_BELOW, "spm").otherwise("psm")
    rows = rows.select("record", "text", form.alias("form"), _cuts(raw, F.col("h1"), F.col("h2")).alias("cut"))

    def part(begin: Column, end: Column) -> Column:
        return F.substring(raw, (begin + 1).cast("int"), (end - begin).cast("int")).cast("string")

    size = F.octet_length("text").cast("long")
    prefix, middle, suffix = part(F.lit(0), cut["first"]), part(cut["first"], cut["second"]), part(cut["second"], size)
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col("text"))
    )
    cut_up = F.col("form") != "plain"
    return rows.select(
        "record",
        cut["n"].alias("n"),
        "form",
        F.when(cut_up, cut["prefix_chars"]).alias("prefix_chars"),
        F.when(cut_up, cut["middle_chars"]).alias("middle_chars"),
        output.alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text again. Its parts hold no sentinel, so that each sentinel is found where it was put; null stays null."""

    def between(begin: str, end: str) -> Column:
        rest = F.substring_index(output, begin, -1)
        return F.substring_index(rest, end, 1)

    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_middle(spark, folder):
    """All documents: what they became and what is rebuilt from that, as digests."""
    done = fill_in_middle(spark.read.parquet(f"{folder}/documents.parquet"))
    return done.select(
        F.col("record.doc_id").alias("doc_id"),
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
        regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units
    FROM documents
), c AS (
    SELECT doc_id, text, units, len(units) AS n,
        CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS a,
        CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
            OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
            WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM d
), p AS (
    SELECT doc_id, text, n, form, array_to_string(units[1:least(a, b)], '') AS prefix,
        array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle,
        array_to_string(units[greatest(a, b) + 1:], '') AS suffix
    FROM c
)
SELECT doc_id, n, form,
    CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM p
"""
