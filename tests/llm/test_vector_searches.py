"""op12 and op13 against brute force: odd vectors, repeated rows, ties, huge components, many copies, several blocks."""

import math
import random

import numpy as np
import pytest

from geoloom.llm import negatives, topk, vectors

ROWS = "vec_id long, embedding array<double>, label int, rid string, q long, rank int"


def whole(v, scale):
    """Whole numbers of a vector; None for one that takes no part."""
    if v is None or any(x is None or not math.isfinite(x) or not math.isfinite(scale * x) for x in v):
        return None
    return [math.floor(scale * x) for x in v]


def clipped(x):
    return min(max(x, -(2**63)), 2**63 - 1)


def dot(a, b):
    return clipped(sum(x * y for x, y in zip(a, b, strict=False)))


def last(x):
    return (x is None, x or 0)


def slow_top(rows, every=20, scale=64, k=20):
    fit = [(i, r[0], w) for i, r in enumerate(rows) if (w := whole(r[1], scale)) is not None]
    out = []
    for i, vec_id, q in fit:
        if vec_id is not None and vec_id % every == 0:
            found = sorted((-dot(q, w), last(v)) for j, v, w in fit if j != i)[:k]
            out += [(vec_id, n + 1, None if v[0] else v[1], -s) for n, (s, v) in enumerate(found)]
    return sorted(out, key=str)


def slow_mined(rows, every=100, scale=256, positives=5, wanted=10):
    fit = [(i, r[0], w, r[2]) for i, r in enumerate(rows) if r[2] is not None and (w := whole(r[1], scale)) is not None]
    out = []
    for i, vec_id, q, label in fit:
        if vec_id is None or vec_id % every:
            continue
        scored = sorted((-dot(q, w), last(v), j, own == label) for j, v, w, own in fit if j != i)
        for ps, pv, _, same in [x for x in scored if x[3]][:positives]:
            found = [x for x in scored if not x[3] and 30 * -ps <= 100 * -x[0] <= 90 * -ps][:wanted]
            out += [(vec_id, None if pv[0] else pv[1], n + 1, None if v[0] else v[1], -ps, -s) for n, (s, v, _, _) in enumerate(found)]
    return sorted(out, key=str)


def table(spark, rows):
    """Rows with columns whose names clash with those used inside."""
    return spark.createDataFrame([(*r, "x", 7, 3) for r in rows], ROWS)


def made(n=400, seed=1):
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(0, 0.2) if rnd.random() < 0.7 else 0.0 for _ in range(12)], rnd.randrange(3)) for i in range(n)]
    copy = [0.25, 0.5, 0.0] * 4
    rows += [(n + i, list(copy), i % 2) for i in range(150)]  # one vector, many times over
    rows += [(n + 200 + i, [x + rnd.gauss(0, 0.003) for x in copy], 1) for i in range(150)]  # and many near it
    rows += rows[:7] + [(100, list(copy), 1), (100, list(copy), 1), (None, list(copy), 2), (None, None, 1)]
    rows += [(900, None, 1), (1000, [0.1, None] * 6, 1), (1100, [0.1, float("nan")] * 6, 0), (1200, [float("inf")] * 12, 0), (1300, [], 1), (1400, [0.5, 0.5], 0), (1500, [0.5] * 15, None), (1600, [0.0] * 12, 2)]
    return rows


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [1 << 16, 50])
def test_topk_is_brute_force(spark, block):
    rows = made()
    assert rows_of(topk.search(table(spark, rows), block=block)) == slow_top(rows)


@pytest.mark.parametrize("block", [1 << 16, 50])
def test_mined_is_brute_force(spark, block):
    rows = made()
    found = rows_of(negatives.mine(table(spark, rows), block=block))
    assert found == slow_mined(rows) and len(found) > 50


@pytest.mark.parametrize("search", [topk.search, negatives.mine])
def test_no_rows(spark, search):
    assert search(table(spark, [])).count() == 0
    assert search(table(spark, [(100, None, 1), (None, [1.0], 1)])).count() == 0
    assert search(table(spark, [(100, [1.0], 1)])).count() == 0


def test_scores_beyond_floats_and_longs(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.choice([1e8, -3e8, 5e8, 1e-3]) * rnd.random() for _ in range(4)], i % 2) for i in range(0, 300, 10)]
    rows += [(400, [1e200, 1.0], 1), (500, [-1e200, 3.0], 1), (600, [1e308 * 1.5, 1.0], 1)]
    assert rows_of(topk.search(table(spark, rows))) == slow_top(rows)
    few = [r for r in rows if r[0] < 400]
    assert rows_of(negatives.mine(table(spark, few))) == slow_mined(few)


def test_cells_hold_their_values():
    rnd = np.random.default_rng(3)
    for values in (rnd.normal(size=5000), rnd.integers(-3, 4, 900).astype(float), np.zeros(40), np.array([2.0]), np.array([1.0] * 500 + [2.0])):
        code, low, high = negatives.cells(values)
        assert (low[code] <= values).all() and (values <= high[code]).all() and len(low) == len(high) <= negatives.CELLS


def test_bounds_hold_the_score_and_leave_most_rows_out():
    rnd = np.random.default_rng(4)
    v = np.floor(256 * rnd.normal(0, 0.125, (3000, 64)))
    found = [negatives.cells(c, 64) for c in v.T]
    block = negatives.Approximations([c.tobytes() for c, _, _ in found], [x for _, x, _ in found], [x for _, _, x in found])
    low, high = block.bounds(v[0], slice(0, 3000))
    score = v @ v[0]
    assert (low <= score).all() and (score <= high).all()
    assert np.count_nonzero(high >= negatives.nth_greatest(low, 10)) < 300


def test_postings_lists_are_whole_or_sparse():
    v = np.array([[1.0, 0, 2], [0, 0, 3], [0, 4, 5]])
    lists = [(np.array([0], np.int32), np.array([1.0])), (np.array([2], np.int32), np.array([4.0])), (np.empty(0, np.int32), v[:, 2])]
    assert (topk.accumulated(v, lists, 3) == v @ v.T).all()
    assert topk.best(np.array([5, 9, 5, 5, 9]), 1, 3).tolist() == [4, 0, 2]
    assert vectors.exact_kind(2.0**60) is object
