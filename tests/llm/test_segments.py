"""op4's ids by segments: equal to the tokenizer's own, and each segment is encoded once."""

import random

import numpy as np
import sentencepiece

from geoloom.llm import pieces, training_order


def _reader():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_ids_are_the_tokenizers():
    own, coder = _reader(), training_order.tokenizer()
    rng = random.Random(4)
    texts = ["", " ", "  ", "   a", "a   ", "a  b\n\n c \n", "\n", "▁", "a▁b ▁ c", "\t x", "<s></s><unk>", "<0x0A>", "日本語 é 😀 x", "\x00 a\x00b", "\r\n"]
    texts += ["".join(rng.choice(" ▁\n\ta<s>b1日é😀.\r") for _ in range(rng.randint(0, 60))) for _ in range(1_000)]
    for some in (texts, [*texts[:20], "a\x1eb c"]):
        found = coder.encode(some)
        assert len(found) == len(some)
        for text, ids in zip(some, found, strict=True):
            assert ids.tolist() == own.encode(text), repr(text)


def test_each_segment_is_encoded_once():
    raw = _reader().serialized_model_proto()
    segments = training_order._Segments(raw)
    part, given = segments.part, []

    class Counting:
        def encode(self, texts, **more):
            given.extend(texts)
            return part.encode(texts, **more)

    segments.part = Counting()
    words = [f"word{i}" for i in range(50)]
    texts = [" ".join(random.Random(k).choices(words, k=200)) for k in range(40)]
    found = segments.encode(texts[:20]) + segments.encode(texts[20:])
    assert sorted(given) == sorted(" " + w for w in words)
    assert all((x == np.array(_reader().encode(t))).all() for x, t in zip(found[:2], texts[:2], strict=True))
