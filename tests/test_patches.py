"""Patches and hulls in squares against a flood fill and a hull of all pixels."""

import random

import pytest

from geoloom.operators import pixels


def flood(mask):
    left, found = set(mask), []
    while left:
        todo, own = [left.pop()], []
        while todo:
            i, r, c = todo.pop()
            own.append((i, r, c))
            for near in ((i, r + 1, c), (i, r - 1, c), (i, r, c + 1), (i, r, c - 1)):
                if near in left:
                    left.remove(near)
                    todo.append(near)
        found.append(own)
    return found


@pytest.mark.parametrize("side", [4, 8, 256])
def test_patches_over_squares(spark, monkeypatch, side):
    rnd = random.Random(side)
    mask = [(i, r, c) for i in (1, 2, 3) for r in range(-20, 21) for c in range(-13, 30) if rnd.random() < 0.2 + 0.2 * i]
    df = spark.createDataFrame(mask + mask[::3] + [(1, None, 2), (1, 2, None)], "image long, row long, col long")
    monkeypatch.setattr(pixels._patches, "__defaults__", (None, side))
    want = [(p[0][0], len(p), *[f(x[k] for x in p) for f in (min, max) for k in (1, 2)]) for p in flood(mask)]
    got = [tuple(r) for r in pixels.blobs(df, 3).select("image", "area", "row0", "col0", "row1", "col1").collect()]
    assert sorted(got) == sorted(w for w in want if w[1] >= 3)
    corners = [(p[0][0], len(p), pixels._corners((c, r) for _, r, c in p)) for p in flood(mask) if len(p) >= 3]
    found = pixels.hulls(df, 3, band=3, fan=2).collect()
    assert sorted((r.image, r.area, r.points) for r in found) == sorted(c for c in corners if len(c[2]) >= 6)


def test_a_snake_over_many_squares(spark, monkeypatch):
    snake = [(1, r, c) for r in range(39) for c in range(40) if r % 2 == 0 or c == (39 if r % 4 == 1 else 0)]
    df = spark.createDataFrame(snake, "image long, row long, col long")
    monkeypatch.setattr(pixels._patches, "__defaults__", (None, 4))
    assert [(r.area, r.row1, r.col1) for r in pixels.blobs(df).collect()] == [(len(snake), 38, 39)]
    assert [r.points for r in pixels.hulls(df, band=5, fan=2).collect()] == [[0, 0, 39, 0, 39, 38, 0, 38]]


def test_images_in_one_square_need_no_links(spark, monkeypatch):
    """Links and rounds are for edges of squares alone, and a hull is no group of its own that Spark calls Python for."""
    links = []
    whole = pixels.components
    monkeypatch.setattr(pixels, "components", lambda df: links.append(df.count()) or whole(df))
    df = spark.range(2000).selectExpr("id % 5 AS image", "(id DIV 5) DIV 20 AS row", "(id DIV 5) % 20 AS col").filter("col % 4 < 3")
    assert pixels.blobs(df).count() == 25
    hulls = pixels.hulls(df, band=4, fan=2)
    assert hulls.count() == 25 and links == [0, 0]
    assert "FlatMapGroupsInPandas" not in hulls._jdf.queryExecution().executedPlan().toString()


def test_no_pixels(spark):
    df = spark.createDataFrame([], "image long, row long, col long")
    assert pixels.blobs(df).count() == 0 and pixels.hulls(df).count() == 0
