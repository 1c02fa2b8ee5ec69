import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from assay.llm import pieces

from .helpers import SCHEMA, documents, odd

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def coder():
    return pieces.PrefixTables(pieces.read_model(PATH))


def ids(coder, text):
    return np.frombuffer(coder.encode(text), np.int32).tolist()


@pytest.mark.parametrize("text", [
    "", " ", "   ", "a", "  a  b ", "▁x ▁", "a\tb\nc\x00", "<s> </s> <0x41> <unk>", "é é 日本語 😀‍",
    "qzx" * 50_000, " " * 3_000, "word " * 20_000,
])
def test_like_the_library(coder, text):
    assert ids(coder, text) == LIBRARY.encode(text)


def test_like_the_library_on_random_texts(coder):
    rng, known = random.Random(7), list(pieces.tables(pieces.read_model(PATH)).ids)
    letters = list("  abcdefghint\n\t0123<>日éß▁😀̀")
    for i in range(4000):
        parts = known if i % 2 else letters
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30))).replace(pieces.SPACE, " ")
        assert ids(coder, text) == LIBRARY.encode(text)


def test_every_prefix_has_the_last_piece_of_its_own_encoding(coder):
    text = "▁internationally"
    table = coder.last_pieces(text)
    for end in range(1, len(text) + 1):
        assert table[end] == LIBRARY.encode(text[1:end], out_type=str)[-1] if end > 1 else table[end] == "▁"


def test_pairs_are_those_that_merging_leaves_apart(coder):
    rng, known = random.Random(11), [p for p in coder.ids if p.startswith(pieces.SPACE) and p.strip(pieces.SPACE)]
    tails = [p for p in coder.ids if pieces.SPACE not in p]
    for _ in range(3000):
        pair = rng.choice(known), rng.choice(tails)
        assert coder.beside[pair] == (LIBRARY.encode("".join(pair)[1:], out_type=str) == list(pair))


def test_a_full_memory_changes_nothing(monkeypatch, coder):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    text = "some words and some more words that come again and again"
    assert ids(pieces.PrefixTables(pieces.read_model(PATH)), text) == LIBRARY.encode(text)


def test_odd_rows_and_clashing_columns(spark):
    model = pieces.read_model(PATH)
    docs = odd(spark, ["▁ <s>", "a\x00b", "日本 " * 9]).selectExpr("*", "1 AS ids", "'x' AS record")
    done = pieces.encoded(docs, model)
    got = done.withColumn("back", pieces.decoder(spark, model)("ids")).collect()
    assert len(got) == docs.count()
    for r in got:
        want = LIBRARY.encode(r.record.text or "") + [2]
        assert (r.ids, r.back) == (want, LIBRARY.decode(want))
    assert pieces.encoded(spark.createDataFrame([], SCHEMA), model).count() == 0
    some = pieces.encoded(documents(spark, ["no end", None]), model, end=False).orderBy("record.doc_id").collect()
    assert [r.ids for r in some] == [LIBRARY.encode("no end"), []]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = pieces.op11_pieces(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        want = LIBRARY.encode(texts[r.doc_id]) + [2]
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, want)), LIBRARY.decode(want))]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want), *digest)


def test_null_ids_stay_null(spark):
    decode = pieces.decoder(spark, pieces.read_model(PATH))
    assert spark.sql("SELECT CAST(NULL AS ARRAY<INT>) AS ids").select(decode(F.col("ids"))).first()[0] is None
