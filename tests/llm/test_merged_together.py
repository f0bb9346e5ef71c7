"""Segments merged together against one by one."""

import random

import numpy as np
import pytest

from geoloom.llm import pieces


def test_merged_together(monkeypatch):
    rnd, one, many = random.Random(6), *(pieces.MergeEncoder(v) for v in [pieces.load()] * 2)
    letters = "etaoinshrdlu▁éßжд日本語0123456789.,-_/\ud800☃͸"
    words = list({"▁" + "".join(rnd.choices(letters[: rnd.choice([6, 12, 30, len(letters)])], k=rnd.randrange(1, 47))) for _ in range(4000)} | {"▁" * k for k in range(1, 48)})
    want = [one.segment(w) for w in words]
    slow = many._merged_long, many.merged
    monkeypatch.setattr(many, "merged", lambda text: pytest.fail(text) if (many.char[[ord(c) for c in text]] >= 0).all() else slow[1](text))
    monkeypatch.setattr(pieces, "TOGETHER", 1)
    many.learn(words)
    assert [many.memo[w] for w in words] == want and any(many.v.byte[0xE2] in np.frombuffer(x, "<i4") for x in want)
