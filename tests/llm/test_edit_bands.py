"""op8's near copies against all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from geoloom.llm import edits
from geoloom.llm.tables import read
from geoloom.operators.graph import components

SF = "/root/testdata/sf0.001"


def slow_classes(prints, least):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids, pairs = sorted(prints), []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if edits.likeness(prints[a], prints[b]) >= least:
                pairs.append((a, b))
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, pairs


def near_texts():
    rng = random.Random(3)
    rows = [None, "", "a", "ab", "ab", "short text of a few words"]
    for n in (40, 70, 120, 130, 250, 260, 900, 5000):
        base = "".join(rng.choice("abcdefgh ijklmnop") for _ in range(n))
        for k in (0, 1, 2, 4):
            own = list(base)
            for _ in range(k):
                own[rng.randrange(len(own))] = rng.choice(["", "X", "yz"])
            rows.append("".join(own))
    return rows


def test_classes_are_those_of_all_pairs(spark):
    docs = read(spark, SF, "documents").select("doc_id", "text")
    made = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(near_texts())], docs.schema)
    for df in (docs, made):
        prints = {r.doc_id: edits.fingerprint(r.text or "") for r in df.collect()}
        want, pairs = slow_classes(prints, edits.LIKE)
        got = {r.doc_id: r.class_id for r in edits.near_copies(df).collect()}
        found = sum(got[a] == got[b] for a, b in pairs)
        assert pairs and found / len(pairs) >= 0.97
        # No class is wider than that of all pairs.
        assert all(want[i] == want[c] for i, c in got.items())


def test_a_band_that_many_share(spark):
    """Tiles of four: a large group of near copies and texts that share only their front."""
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefghij klmnop") for _ in range(600))
    rows = [(i, base[:i] + "X" + base[i:]) for i in range(0, 600, 20)]
    rows += [(1000 + i, base[:300] + "".join(rng.choice("qrstuvwxyz") for _ in range(300))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = edits.fingerprints(df).groupBy("fingerprint").agg(F.min("doc_id").alias("least")).withColumn("k", F.xxhash64("fingerprint"))
    by = {r.k: r.least for r in prints.collect()}
    for tile in (4, 512):
        roots = {by[r.node]: by[r.root] for r in components(edits.links(prints.select("k", "fingerprint"), tile=tile)).collect()}
        groups: dict = {}
        for i in by.values():
            groups.setdefault(roots.get(i, i), set()).add(i)
        want, _ = slow_classes({i: edits.fingerprint(t) for i, t in rows}, edits.LIKE)
        assert sorted(map(sorted, groups.values())) == sorted(sorted(i for i in by.values() if want[i] == c) for c in set(want.values()))


def test_rows_of_one_id_and_of_none(spark):
    rows = [(None, "x" * 90), (None, "x" * 90), (4, "x" * 90), (7, "y z" * 40), (7, "y z" * 40), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("part", "tie", "closing", "k", "fingerprint", "own"):
        df = df.withColumn(name, F.lit(name))
    got = sorted((str(r.doc_id), r.class_id) for r in edits.near_copies(df).collect())
    assert got == [("4", 4), ("7", 7), ("7", 7), ("8", 8), ("None", 4), ("None", 4)]
    assert edits.near_next(df.limit(0)).count() == 0 and edits.near_copies(df.limit(0)).count() == 0


def slow_print(text):
    """The embedding step by step: a pointer that rests or moves on, then the steps of the text's level."""
    mix = lambda x: int(edits._mix(np.array([x], np.uint64))[0])
    shown, at, rested, step = [], 0, 0, 0
    while at < len(text):
        shown.append(ord(text[at]))
        rested += 1
        if edits._move[mix(ord(text[at])) >> 58][step % edits.PERIOD] or rested == edits.REST:
            at, rested = at + 1, 0
        step += 1
    level = 0
    while len(shown) > edits.SAMPLES << level:
        level += 1
    kept = [(s, c) for s, c in enumerate(shown) if mix((s + 0x9E3779B97F4A7C15) % 2**64) % (1 << level) == 0]
    return f"{level:02d}:" + "".join("0123456789abcdef"[mix(((c << 32) + s) % 2**64) >> 60] for s, c in kept)


def test_the_walk_step_by_step():
    rng = random.Random(9)
    texts = [None, "", "a", "zz", "日本語 и ещё", "x" * 700, *("".join(rng.choice("abc defg\né") for _ in range(n)) for n in (7, 64, 300, 1100, 2600))]
    for t in texts:
        assert edits.fingerprint(t or "") == slow_print(t or "")


def test_the_query_has_classes(spark):
    docs = read(spark, SF, "documents")
    got = {r.doc_id: r for r in edits.with_classes(docs).collect()}
    want = {r.doc_id: r.class_id for r in edits.near_copies(docs).collect()}
    assert {i: r.class_id for i, r in got.items()} == want and len(set(want.values())) < len(want)
    plain = {r.doc_id: r for r in edits.near_next(docs).collect()}
    assert all(got[i][n] == r[n] for i, r in plain.items() for n in edits._NAMES)


def test_narrow_fingerprints(spark):
    prints = ["00:", "00:a", "03:0f9", "12:abcdef01"]
    df = spark.createDataFrame([(x,) for x in prints], "x string")
    assert [edits._widened(bytes(r[0])) for r in df.select(edits._narrow(F.col("x"))).collect()] == prints
