"""op5's battery: p-values by plain Python and by simulation, calls by a plain form of the rule, false calls among words."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from geoloom.llm import secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
B62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
B64 = B62 + "+/"
SYLLABLES = "ka lo mi ter son ver ing pre ble tion sta men cor dis per lan gu age fol low er".split()


def slow_battery(t, a):
    k, n = len(a), len(t)
    x = k / n * sum(t.count(c) ** 2 for c in a) - n
    var = 2 * (k - 1) * (n - 1) / n
    skew = 4 * (k - 1) * (n - 1) * (k + 2 * n - 6) / n**2 / var**1.5
    shape = 4 / skew**2
    off = (x - k / n - (k - 1)) / math.sqrt(var)
    z = (max(1 + off / math.sqrt(shape), 1e-12) ** (1 / 3) - 1 + 1 / (9 * shape)) * 3 * math.sqrt(shape)
    tail = lambda z: math.erfc(z / math.sqrt(2)) / 2
    places = [a.index(c) - (k - 1) / 2 for c in t]
    turns = sum((p > 0) != (q > 0) for p, q in zip(places, places[1:], strict=False))
    runs = max(abs(turns - (n - 1) / 2) - 0.5, 0) / (math.sqrt(n - 1) / 2)
    serial = abs(sum(p * q for p, q in zip(places, places[1:], strict=False))) / (math.sqrt(n - 1) * (k * k - 1) / 12)
    fourth, z4 = (0.24 * (n - 1) + 4.8 * (n - 2)) / (n - 1) ** 2, min(serial, 4)
    serial -= fourth / 24 * (z4**3 - 3 * z4)
    return tail(z), min(2 * tail(runs), 1), min(2 * tail(serial), 1)


def words(rng, n):
    out = ""
    while len(out) < n:
        out += rng.choice(SYLLABLES) + rng.choice(["", "", "_", "-"])
    return out[:n]


def tokens(rng, count):
    own = [words(rng, rng.randrange(20, 90)) for _ in range(count)] + [words(rng, 30).title().replace("_", "").replace("-", "") + "x" * 3 for _ in range(count // 4)]
    keys = ["".join(rng.choice(B64) for _ in range(rng.choice((20, 24, 32, 40, 64, 100)))) for _ in range(count // 2)]
    return [x for x in own if len(x) >= 20], keys


def test_p_values(spark):
    rng = random.Random(3)
    some = ["".join(rng.choice(a) for _ in range(n)) for a in (B62, B64, B62[26:], B62[:26] + "234567") for n in (16, 20, 33, 64, 200) for _ in range(4)]
    some += ["abcdefghijklmnopqrstuvwxyz0123456789", "A" * 30, "ab" * 20]
    df = spark.createDataFrame([(x,) for x in some], "t string").coalesce(1)
    rows = df.select(secrets.alphabet_of(F.col("t")).alias("a"), secrets.battery(F.col("t"), secrets.alphabet_of(F.col("t"))).alias("p")).collect()
    for x, r in zip(some, rows, strict=True):
        assert np.allclose([*r.p], slow_battery(x, r.a), atol=1e-6)


def test_p_values_hold_for_random_strings():
    """Share of random strings below a level: at most a little above it, at short lengths too."""
    rng = random.Random(5)
    for a in (B64, B62[26:], "0123456789abcdef"):
        for n in (16, 20, 48):
            found = np.array([slow_battery([rng.choice(a) for _ in range(n)], a) for _ in range(4000)])
            for level in (0.05, 0.01, 0.003):
                assert ((found <= level).mean(axis=0) <= 1.35 * level + 0.0015).all()
            assert (3 * found.min(axis=1) < secrets.LEVEL).mean() < 2.2 * secrets.LEVEL


def slow_called(candidates):
    """Of candidates those called: the rule over whole powers of two within strata of length."""
    rows = []
    for t in candidates:
        bare = t.rstrip("=").translate(str.maketrans("-_", "+/"))
        a = next(own for pattern, own in secrets.ENCODINGS if re.search(pattern, bare))
        e = -len(bare) * math.log2(len(a)) - sum(sum(bare.count(c) for c in cs) * math.log2(share / len(cs)) for cs, share in secrets.WORDS)
        fails = 3 * min(slow_battery(bare, a)) < secrets.LEVEL or not re.search("[A-Za-z]", bare) or len(bare) < secrets.MIN_TOKEN - 2 or e < 0
        rows.append((t, sum(len(t) >= low for low in secrets.STRATA), -1 if fails else min(int(e), secrets.BINS)))
    called = set()
    for stratum in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == stratum]
        for b in range(secrets.BINS, -1, -1):
            top = [t for t, _, e in own if e >= b]
            if top and 2.0**b >= len(own) / (secrets.ALPHA * len(top)):
                called |= set(top)
    return called


def test_calls_and_false_calls(spark):
    rng = random.Random(8)
    plain, keys = tokens(rng, 800)
    every = [*plain, *keys]
    df = spark.createDataFrame([(i, f"see {t} here", "en", "s", 1) for i, t in enumerate(every)], DOCS)
    got = {r.doc_id: r for r in secrets.secrets(df).collect()}
    base = {i for i, r in got.items() if r.n_assign or r.n_access or r.n_hex}
    want = slow_called([t for i, t in enumerate(every) if i not in base])
    assert {every[i] for i, r in got.items() if r.n_random and i not in base} == want
    false = sum(t in want for t in plain)
    assert len(want) > 300 and false / len(want) <= 2 * secrets.ALPHA
    assert sum(t in want for t in keys if len(t) >= 24) / sum(len(t) >= 24 for t in keys) > 0.95


def test_rows_repeated_null_ids_and_clashing_columns(spark):
    rng = random.Random(6)
    key = "".join(rng.choice(B64) for _ in range(64))
    rows = [(None, key), (None, key), (1, None), (1, ""), (2, "password: " + "q" * 14)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("_secrets", "_s_text", "_s_text0", "s", "w", "n_chars"):
        df = df.withColumn(name, F.lit(1))
    got = sorted(((r.doc_id, r.n_random, r.n_assign) for r in secrets.secrets(df).collect()), key=str)
    assert got == sorted([(None, 1, 0), (None, 1, 0), (1, 0, 0), (1, 0, 0), (2, 0, 1)], key=str)
    out = secrets.redact(df)
    assert out.columns == df.columns and sorted((str(r.text) for r in out.collect())) == sorted(["[secret]", "[secret]", "None", "", "[secret]"])
    assert secrets.redact(df.limit(0)).count() == 0 and secrets.redact(df.limit(0)).columns == df.columns


def test_keys_beside_assignments(spark):
    """What a run has left of a span by form is tested like any other run; the query's spans are what redact masks."""
    rng = random.Random(11)
    key = lambda n: "".join(rng.choice(B64) for _ in range(n))
    alone, beside, short = key(44), key(44), [key(16) for _ in range(5)]
    texts = [f"first {alone} end", f"then {beside}/token=abcdefghijklmnop end", "only token=abcdefghijklmnop", "abc/token=abcdefghijklmnop/x"]
    texts += [f"a short one {k} here" for k in short] + [f"words {words(rng, 30)} and {words(rng, 17)}" for _ in range(60)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in secrets.secrets(df).collect()}
    out = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert (got[0].n_random, got[0].n_assign) == (1, 0) and alone not in out[0]
    at = texts[1].index(beside)
    assert got[1].spans == f"random:{at}:{at + 45},assign:{at + 45}:{at + 67}" and out[1] == "then [secret][secret] end"
    assert (got[2].n_random, got[3].n_random) == (0, 0)
    assert sum(got[4 + i].n_random for i in range(5)) >= 4
    for i, t in enumerate(texts):
        kept, rest = [tuple(map(int, x.split(":")[1:])) for x in got[i].spans.split(",") if x], t
        for a, b in reversed(kept):
            rest = rest[:a] + "[secret]" + rest[b:]
        assert out[i] == rest
    assert sum(got[i].n_random for i in range(9, 69)) == 0


def test_parts_of_runs(spark):
    df = spark.createDataFrame([([(0, 100, "x" * 100)], [(10, 12), (11, 40), (50, 60), (76, 100)])], "r array<struct<start:long,end:long,token:string>>, b array<struct<start:long,end:long>>")
    got = df.select(secrets._free(F.col("r")[0], F.col("b")).alias("p")).first().p
    assert [(p.start, p.end, len(p.token)) for p in got] == [(60, 76, 16)]
