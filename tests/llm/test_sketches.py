"""Near-dedup's sketches: no pair at the bound is lost, and texts that share a passage alone leave no pairs behind."""

import random

import numpy as np

from geoloom.llm import likeness


def _pairs(inter: int, apart: int, many: int):
    rng = np.random.default_rng(inter)
    for _ in range(many):
        x = rng.integers(0, 1 << 64, inter + apart, dtype=np.uint64)
        yield np.sort(x[: inter + apart // 2]), np.sort(np.concatenate([x[:inter], x[inter + apart // 2 :]]))


def _stay(inter: int, apart: int, many: int) -> float:
    found = list(_pairs(inter, apart, many))
    a, b = (np.array([np.frombuffer(likeness.sketch(p[k]), np.uint8) for p in found]) for k in (0, 1))
    return likeness.sketched(a, b, np.array([len(x) + len(y) for x, y in found])).mean()


def test_pairs_at_the_bound_stay():
    for inter in (4, 8, 16, 40, 160, 400, 1_200, 4_000):
        assert _stay(inter, inter // 4, 500) == 1
    for inter in (40, 160, 400, 1_200):
        assert _stay(inter, inter * 2 // 3, 500) < 0.01  # a likeness of 0.6
    assert likeness.sketch(np.zeros(0, np.uint64)) == bytes(likeness.BINS)


def test_a_common_passage_leaves_no_pairs(spark, monkeypatch):
    rnd, many = random.Random(3), {}
    passage = " ".join(f"p{i}" for i in range(70))
    texts = [passage + " " + " ".join(f"w{rnd.randrange(10**9)}" for _ in range(20)) for _ in range(60)]
    keep = likeness.cut

    def counted(df, name):
        out = keep(df, name)
        many[name] = out
        return out

    monkeypatch.setattr(likeness, "cut", counted)
    kept = likeness.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert kept.count() == 60
    assert many["alike-pairs"].count() < 60
