"""Claims by blocks of time against a plain walk, over chains that go through all blocks."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from geoloom.operators import identity

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "old_id string, old_ord long, old_ts timestamp, id string, ord long, ts timestamp, west double, south double, east double, north double, grid_key string, baseline string, stamp timestamp"


def links(n, rnd, ambiguous):
    """Scenes 10 seconds apart in a mixed order, each with the one or two new ones beside it, and some new ones that many share."""
    order = list(range(n))
    if rnd:
        rnd.shuffle(order)
    for i in range(n):
        for j in sorted({i, i + 1} | ({n // 2} if i % 17 == 3 else set())):
            same = ambiguous and j % 3 == 0
            yield f"K{i}", order[i], START + timedelta(seconds=10 * i), f"N{j}", j, START + timedelta(seconds=10 * i), 0.0, 0.0, 1.0, 1.0, "T", None if same else f"05.{n - j}", START


def walk(rows):
    out, gone = {}, set()
    for old_ord in sorted({r[1] for r in rows}):
        own = [r for r in rows if r[1] == old_ord]
        left = [r for r in own if r[3] not in gone]
        rank = lambda r: -1 if r[11] is None else int(r[11][3:])
        best = [r for r in left if rank(r) == max(map(rank, left))]
        new = left[0][3] if len(left) == 1 else best[0][3] if len(best) == 1 else None
        gone.add(new)
        out[own[0][0]] = ("replaced" if new else "ambiguous" if left else "no match", new)
    return out


@pytest.mark.parametrize("seed, block, rounds", [(1, 50, 8), (2, 20, 30), (3, 20, 1), (None, 100, 2), (None, 100, 30)])
def test_claims_by_blocks(spark, seed, block, rounds):
    rows = list(links(150, seed and random.Random(seed), ambiguous=seed != 1))
    found = spark.createDataFrame(rows, SCHEMA)
    stored = found.selectExpr("old_id AS id").distinct()
    got = {r.old_id: (r.outcome, r.new_id) for r in identity.claimed(stored, found, block=block, rounds=rounds).collect()}
    assert got == walk(rows)


def test_a_long_chain_is_many_tasks(spark, monkeypatch):
    """A chain through the whole table is decided block by block, without its component."""
    monkeypatch.setattr(identity, "components", lambda links: pytest.fail("a chain was one component"))
    rows = list(links(400, random.Random(5), ambiguous=True))
    found = spark.createDataFrame(rows, SCHEMA)
    got = {r.old_id: (r.outcome, r.new_id) for r in identity.claimed(found.selectExpr("old_id AS id").distinct(), found, block=200).collect()}
    assert got == walk(rows)
