"""op7's ids against those of the tokenizer itself."""

import random

import pytest
import sentencepiece

from geoloom.llm import pieces
from geoloom.llm.tables import read


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def texts():
    rng = random.Random(5)
    odd = ["", " ", "   x", " " * 40 + "y", "a\r\n\tb  c   d", "the <s></s><unk><0x0A> \x00", "日本語のテキスト" * 30, "😀é€ " * 9, "x" * 500, "ab" * 200 + " " * 100, "=" * 77]
    letters = "etaoinshrdlu ETA  .,-01\n\té日"
    return odd + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 400))) for _ in range(200)]


def test_ids_are_the_tokenizers(spark, sp):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: sp.encode(t) for i, t in rows}
    assert {r.doc_id: r.token_ids for r in pieces.tokens(df).collect()} == want
    for chunk in (64, 1000):
        assert {r.doc_id: r.token_ids for r in pieces.encode(df, giant=0, chunk=chunk).collect()} == want


def test_ids_of_documents(spark, sp):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in pieces.op7_sentencepiece(spark, sf).collect()}
    for r in read(spark, sf, "documents").collect():
        assert got[r.doc_id].token_ids == sp.encode(r.text) and got[r.doc_id].n_tokens == len(sp.encode(r.text)) and got[r.doc_id].round_trip
