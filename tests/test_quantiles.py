"""Quantiles by refined histograms against sorting."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.operators import pixels as P
from geoloom.operators.quantiles import quantiles

AT = [0.0, 0.02, 0.25, 0.5, 0.981, 1.0]


def test_any_numbers(spark):
    rnd = random.Random(7)
    groups = {
        "even": [rnd.random() for _ in range(3000)], "wide": [rnd.choice([-1, 1]) * 10 ** rnd.uniform(-300, 300) for _ in range(2000)],
        "tight": [1e9 + rnd.random() * 1e-6 for _ in range(2000)], "same": [0.1] * 500, "one": [-3.5], "two": [-0.0, 5e-324],
        "skew": [0.0] * 900 + [rnd.gauss(0, 1e-12) for _ in range(300)], None: [float(i % 7) for i in range(100)], "whole": [float(rnd.randrange(-50, 50)) for _ in range(999)],
    }
    rows = [(k, x) for k, xs in groups.items() for x in xs] + [("even", None), ("even", math.nan), ("none", None)]
    rnd.shuffle(rows)
    got = {(r.k, r.p): r.value for r in quantiles(spark.createDataFrame(rows, "k string, x double").repartition(7), ["k"], AT).collect()}
    assert len(got) == len(groups) * len(AT)
    for k, xs in groups.items():
        for p in AT:
            want = float(np.quantile(np.array(xs), p))
            assert got[k, p] == pytest.approx(want, rel=1e-12, abs=1e-300), (k, p)


def test_no_group_is_gathered(spark):
    plan = P.stretch_bounds(spark.createDataFrame([(1, 0.5, 1)], "image int, a double, b int"), ["a", "b"], ["image"])
    assert plan.collect()[0].asDict() == {"image": 1, "a_low": 0.5, "a_high": 0.5, "b_low": 1.0, "b_high": 1.0, "a_zeros": 0.0, "b_zeros": 0.0}
    text = plan.select("a_low")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_paired_and_subsampled(spark):
    rows = [(0, r, c, float(r + c)) for r in range(100) for c in range(30)]
    p = spark.createDataFrame(rows, "image int, row int, col int, a double")
    b = P.paired_bounds(p.filter("row < 50"), p.filter("row >= 50"), ["a"]).first().a
    assert b == pytest.approx(list(np.quantile([x[3] for x in rows], [0.02, 0.98])))
    small = P.subsampled(p, ["image"], 40)
    assert small.agg(F.count("*"), F.max("row"), F.max("col")).first() == (34 * 10, 99, 27)
