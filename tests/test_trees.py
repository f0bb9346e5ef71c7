"""Trees of catalogs against a plain walk; cycles, depth, unknown extents, both in one call."""

import datetime as dt
import random

import pytest

from geoloom.request import BBox, PullRequest
from geoloom.sources import trees
from geoloom.sources.families import Source

NODE = "id string, parent string, leaf boolean, west double, south double, east double, north double, first date, last date"
ASKED = PullRequest(dt.date(2024, 3, 1), dt.date(2024, 3, 31), BBox(170.0, -20.0, -170.0, 20.0))


def meets(n):
    _, _, _, w, s, e, nn, first, last = n
    placed = True if w is None else nn >= -20 and s <= 20 and any(a <= d and c <= b for a, b in ([(w, e)] if w <= e else [(w, 180), (-180, e)]) for c, d in ((170, 180), (-180, -170)))
    return placed and (first is None or first <= ASKED.end) and (last is None or last >= ASKED.start)


def slow(nodes):
    def below(parent, level):
        for n in nodes:
            if n[1] == parent and meets(n):
                if n[2]:
                    yield n[0], level
                else:
                    yield from below(n[0], level + 1)

    return sorted(below(None, 1))


def made(seed):
    rnd, nodes = random.Random(seed), []

    def grow(name, parent, depth):
        leaf = depth == 0 or (depth < 5 and rnd.random() < 0.15)
        w, s = rnd.choice([rnd.uniform(-180, 180), rnd.uniform(160, 180)]), rnd.uniform(-40, 10)
        size = 3 if leaf else rnd.choice([60, 150, 340])
        e = w + size if w + size <= 180 else w + size - 360
        first = dt.date(2024, 1, 1) + dt.timedelta(days=rnd.randrange(120))
        known = leaf or rnd.random() < 0.3
        nodes.append((name, parent, leaf, *((w, s, e, s + size / 3) if known else (None,) * 4), first if known else None, (first if leaf else first + dt.timedelta(days=60)) if known else None))
        if not leaf:
            for k in range(rnd.randrange(2, 5)):
                grow(f"{name}.{k}", name, depth - 1)

    for k in range(3):
        grow(f"n{k}", None, 6)
    return nodes


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_depth(spark, seed):
    nodes = made(seed)
    got = sorted((r.id, r.level) for r in trees.walked(spark.createDataFrame(nodes, NODE), ASKED).collect())
    assert got == slow(nodes) and max(x[1] for x in slow(nodes)) >= 5


def test_cycles_and_depth_are_refused(spark):
    own = (None,) * 6
    ring = [("a", None, False, *own), ("b", "a", False, *own), ("c", "b", False, *own), ("b", "c", False, *own), ("x", "c", True, *own)]
    with pytest.raises(ValueError, match="two levels"):
        trees.walked(spark.createDataFrame(ring, NODE), ASKED)
    line = [(f"n{i}", f"n{i - 1}" if i else None, i == 9, *own) for i in range(10)]
    assert trees.walked(spark.createDataFrame(line, NODE), ASKED).first().level == 10
    with pytest.raises(ValueError, match="more than 5"):
        trees.walked(spark.createDataFrame(line, NODE), ASKED, 5)
    assert trees.walked(spark.createDataFrame([], NODE), ASKED).count() == 0


def test_one_call(spark):
    own = (171.0, 0.0, 172.0, 1.0, dt.date(2024, 3, 5), dt.date(2024, 3, 5))
    nodes = [("top", None, False, *(None,) * 6), ("in", "top", True, *own), ("out", "top", True, 0.0, 0.0, 1.0, 1.0, *own[4:])]
    source = Source.of(_tree_source())
    got = source.search(spark.createDataFrame(nodes, NODE), ASKED).collect()
    assert [(r.id, r.source) for r in got] == [("in", source.name)]


def _tree_source():
    from geoloom.sources import registry

    return next(name for name, family, *_ in registry.rows() if family == "tree")
