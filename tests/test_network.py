"""The network in squares against the image as a whole, and layer by layer by plain loops."""

import numpy as np
import pytest

from geoloom.operators import network as N


def net(rng, bands=2):
    k = lambda o, i: (rng.integers(-8, 9, (o, i, 3, 3)) / 8, rng.integers(-8, 9, o) / 8)
    return N.Network(k(3, bands), k(4, 3), k(3, 7), k(4, 3), np.full(bands, 2.0), np.full(bands, 4.0), 0.5)


def slow(grid, n):
    """Pixel by pixel."""
    clamp = lambda v, most: min(max(v, 0), most - 1)

    def conv(g, kernel, bias):
        c, h, w = g.shape
        return np.array([[[bias[o] + sum(kernel[o][i][a][b] * g[i][clamp(y + a - 1, h)][clamp(x + b - 1, w)] for i in range(c) for a in range(3) for b in range(3)) for x in range(w)] for y in range(h)] for o in range(len(bias))])

    h, w = grid.shape[1:]
    g = np.array([[[grid[i][clamp(y, h)][clamp(x, w)] for x in range(w + w % 2)] for y in range(h + h % 2)] for i in range(len(grid))])
    x = np.array([(b * n.scale - m) / s for b, m, s in zip(g, n.mean, n.std, strict=True)])
    e = np.maximum(conv(x, *n.first), 0)
    p = np.array([[[max(c[2 * i][2 * j], c[2 * i + 1][2 * j], c[2 * i][2 * j + 1], c[2 * i + 1][2 * j + 1]) for j in range(e.shape[2] // 2)] for i in range(e.shape[1] // 2)] for c in e])
    m = np.maximum(conv(p, *n.middle), 0)
    u = np.array([[[c[i // 2][j // 2] for j in range(e.shape[2])] for i in range(e.shape[1])] for c in m])
    d = np.maximum(conv(np.concatenate([u, e]), *n.joined), 0)
    return conv(d, *n.head).argmax(axis=0)[:h, :w]


def test_whole_pass_is_layer_by_layer():
    rng = np.random.default_rng(1)
    for h, w in ((1, 1), (2, 5), (7, 6), (9, 9)):
        n, grid = net(rng), rng.integers(0, 50, (2, h, w)).astype(float)
        assert (N.labels_of(grid, n) == slow(grid, n)).all()


@pytest.mark.parametrize("side", [16, 64])
def test_squares_are_the_whole_image(spark, side):
    rng = np.random.default_rng(2)
    n, images = net(rng), {"a": rng.integers(0, 50, (2, 75, 49)), "b": rng.integers(0, 50, (2, 16, 33)), "c": rng.integers(0, 50, (2, 1, 1))}
    rows = [(k, y, x, float(g[0, y, x]), int(g[1, y, x])) for k, g in images.items() for y in range(g.shape[1]) for x in range(g.shape[2])]
    df = spark.createDataFrame(rows, "image string, row int, col int, u double, v int").repartition(5)
    got = {(r.image, r.row, r.col): r.label for r in N.segmented(df, ["u", "v"], n, side).collect()}
    assert len(got) == len(rows)
    for k, g in images.items():
        want = N.labels_of(g.astype(float), n)
        assert all(got[k, y, x] == want[y, x] for y in range(g.shape[1]) for x in range(g.shape[2]))


def test_one_exchange_of_pixels(spark):
    n = net(np.random.default_rng(3))
    df = spark.createDataFrame([("a", 0, 0, 1.0, 2)], "image string, row int, col int, u double, v int")
    out = N.segmented(df, ["u", "v"], n)
    assert out.count() == 1 and N.segmented(df.limit(0), ["u", "v"], n).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("FlatMapGroupsInPandas") == 1 and plan.count("Exchange hashpartitioning(image#") <= 2
    with pytest.raises(ValueError):
        N.Network(n.first, n.first, n.joined, n.head, n.mean, n.std)
