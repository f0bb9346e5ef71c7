"""The pipeline's near-dedup against brute-force likeness of five-word shingles."""

import random
import re

import corpus_pipeline
import numpy as np
from geoloom.llm import likeness
from geoloom.llm.tables import read
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def slow_set(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def slow_keeps(rows):
    """The least doc_id of each component of all pairs with a likeness of 0.8 or more."""
    sets = {r.doc_id: slow_set(r.text) for r in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by: dict = {}
    for i, own in sets.items():
        for s in own or [None]:
            by.setdefault(s, []).append(i)
    met = {(a, b) for own in by.values() for k, a in enumerate(own) for b in own[k + 1 :]}
    for a, b in met:
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {find(i) for i in sets}


def test_stage_reaches_the_likeness(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    texts = [None, "", " \n", "one", "One", "two words"]
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.randrange(5, 300))]
        for edits in (0, 1, 2, 4, 6):
            own = list(base)
            for at in rng.sample(range(len(own)), min(edits, len(own))):
                own[at] = rng.choice(words)
            texts.append(" ".join(own))
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
    kept = corpus_pipeline.near_dedup(spark, df, "")
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(slow_keeps(df.collect()))
    assert corpus_pipeline.near_dedup(spark, df.limit(0), "").count() == 0


def test_stage_on_documents(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    got = [r.doc_id for r in likeness.keep_one(docs).collect()]
    assert sorted(got) == sorted(slow_keeps(docs.select("doc_id", "text").collect()))


def test_rows_repeated_null_ids_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near = text + " more"
    rows = [(None, text), (None, text), (5, text), (5, text), (7, near), (9, "other words"), (None, "lonely text"), (None, "lonely text"), (11, None), (12, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("key", "h", "doc", "token", "root", "own_id", "f0", "none"):
        df = df.withColumn(name, F.lit(name))
    kept = likeness.keep_one(df)
    assert kept.columns == df.columns and sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("11", None), ("5", text), ("9", "other words"), ("None", "lonely text")]


def test_tiles_of_a_large_group_lose_no_link(spark, monkeypatch):
    """Many texts that share one long passage, in pairs of near copies: tiles by population count."""
    monkeypatch.setattr(likeness, "TILE", 8)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(9000)]
    common = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(60):
        own = common + [rng.choice(words) for _ in range(60)]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(own[:-3] + ["x"] * (i % 3 + 1)))]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    assert sorted(r.doc_id for r in likeness.keep_one(df).collect()) == sorted(slow_keeps(df.collect()))


def test_fingerprints_of_links_lie_within_the_radius():
    """Sets at the bound, of all sizes: the largest distance seen stays below the radius, and blocks are shared."""
    rng = np.random.default_rng(7)
    most = {False: 0, True: 0}
    for n in [4, 5, 9, 10, 20, 40, 90, 300] * 300:
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[: -(-8 * n // 9)], rng.integers(0, 1 << 63, n // 9, dtype=np.uint64)]) if n > 5 else np.append(a, np.uint64(n))
        a, b = np.unique(a), np.unique(b)
        if len(np.intersect1d(a, b)) * 5 >= 4 * len(np.union1d(a, b)):
            apart = sum(((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(likeness.fingerprint(a), likeness.fingerprint(b), strict=True))
            few = min(len(a), len(b)) < likeness.FEW
            most[few] = max(most[few], apart)
            assert np.intersect1d(likeness.blocks(a), likeness.blocks(b)).size
    assert 40 < most[False] <= likeness.RADIUS and 40 < most[True] <= likeness.RADIUS_FEW
    far = [rng.integers(0, 1 << 63, 100, dtype=np.uint64) for _ in range(200)]
    assert not any(np.intersect1d(likeness.blocks(x), likeness.blocks(y)).size for x, y in zip(far, far[1:], strict=False))
