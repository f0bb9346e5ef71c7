"""op1, op3, op6 and op10 against plain forms of their methods, and their odd inputs."""

import hashlib
import math
from collections import Counter

import numpy as np
import regex
from pyspark.sql import functions as F

from geoloom.llm import fixity, quality, toxicity, urls
from geoloom.llm.tables import read

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def distance(p, q):
    total = 0.0
    for a, b in zip(p, q, strict=True):
        m = (a + b) / 2
        total += (a * math.log2(a / m) if a else 0) + (b * math.log2(b / m) if b else 0)
    return math.sqrt(max(0.0, round(total / 2, 9)))


def slow_quality(rows, rules):
    """doc_id -> (class distance, word distance, kept), by counting words and characters one after another."""
    measured, every = [], sorted({x for own in quality.COMMON_WORDS.values() for x in own})
    for r in rows:
        words = regex.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
        dense, classes = "".join(words), []
        for _, pattern in quality.CLASSES:
            left = regex.sub(pattern, "", dense)
            classes.append(len(dense) - len(left))
            dense = left
        ref = r.lang if r.lang in quality.COMMON_WORDS else "*"
        listed, count = quality.COMMON_WORDS.get(r.lang, every), Counter(words)
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        measured.append((r.doc_id, ref, [*classes, len(dense)], [count[x] for x in listed], len(words), failed))

    def references(kept):
        found = {}
        for ref in {m[1] for m in kept}:
            own = [m for m in kept if m[1] == ref]
            n = sum(m[4] for m in own)
            if n >= rules.reference_words:
                cs = np.sum([m[2] for m in own], axis=0)
                ws = np.sum([m[3] for m in own], axis=0)
                found[ref] = [c / cs.sum() for c in cs], [w / n for w in ws] + [(n - ws.sum()) / n]
        return found

    def judged(known):
        out = {}
        for i, ref, cs, ws, n, failed in measured:
            near = distance([c / sum(cs) for c in cs], known[ref][0]) if ref in known and sum(cs) >= rules.guard_chars else None
            near_words = distance([w / n for w in ws] + [(n - sum(ws)) / n], known[ref][1]) if ref in known and n >= rules.guard_words else None
            apart = (near is not None and near > rules.max_class_distance + rules.class_slack / math.sqrt(sum(cs))) or (
                near_words is not None and near_words > rules.max_word_distance + rules.word_slack / math.sqrt(n)
            )
            out[i] = near, near_words, not failed and not apart
        return out

    passing = [m for m in measured if not m[5]]
    first = judged(references(passing))
    return judged(references([m for m in passing if first[m[0]][2]]))


def test_distances_and_verdicts(spark):
    docs = read(spark, SF, "documents")
    want = slow_quality(docs.collect(), quality.Rules())
    got = quality.quality(docs).collect()
    for r in got:
        a, b, kept = want[r.doc_id]
        assert r.kept == kept
        for x, y in ((r.class_distance, a), (r.word_distance, b)):
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-5)
    assert {r.kept for r in got} == {True, False}


def test_references_that_are_handed_in(spark):
    docs = read(spark, SF, "documents")
    counts = quality.measure(docs.select("doc_id", "text", "lang"))
    known = quality.fit(counts.select(F.col(counts.columns[-1]).alias("counts")), quality.Rules())
    few = docs.limit(7)
    want = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    assert all(r.kept == want[r.doc_id] for r in quality.quality(few, known=known).collect())


def slow_features(text):
    """Buckets of a text's 3-, 4- and 5-grams, by whole numbers."""
    s = " " * 4 + (text or "").lower() + " " * 4
    points, found = [ord(c) for c in s], set()
    for i in range(len(points) - 4):
        h = points[i]
        for k in range(1, 5):
            h = (h * 0x01000193 + points[i + k]) & 0xFFFFFFFF
            if k + 1 in (3, 4, 5):
                found.add(((h ^ (h >> 15)) * (0x85EBCA6B + 2 * k) & 0xFFFFFFFF) >> (32 - toxicity.BITS))
    return found


def toxic_rows():
    good, bad = "a calm day by the sea with friends", "you vile wretched fool go away"
    return [(i, f"{(bad if i % 3 == 0 else good)[: 20 + i % 14]} {'xyz'[i % 3] * (i % 5)}", i % 3 == 0) for i in range(90)]


def test_ratios_and_fit(spark):
    rows = [r for r in toxic_rows()]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(x)) for i, _, x in rows], "doc_id long, toxic int")
    import zlib

    train = [(slow_features(t), int(x)) for i, t, x in rows if zlib.crc32(str(i).encode()) % 5 != 0]
    n1 = sum(y for _, y in train)
    n0 = len(train) - n1
    counts = [Counter(b for own, y in train if y == k for b in own) for k in (0, 1)]
    settings, want = toxicity.Settings(), {}
    for b in counts[0].keys() | counts[1].keys():
        p, q, pool = (counts[1][b] + 1) / (n1 + 2), (counts[0][b] + 1) / (n0 + 2), (counts[0][b] + counts[1][b] + 2) / (n0 + n1 + 4)
        if abs(p - q) / math.sqrt(pool * (1 - pool) * (1 / n0 + 1 / n1) + 1e-12) >= settings.min_z:
            want[b] = math.log(p / q)
    summed = toxicity.training_rows(docs, labels).mapInArrow(toxicity._counts, "bucket int, n0 bigint, n1 bigint").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    got = {r.bucket: r.r for r in toxicity.ratios(summed, n0, n1, settings).collect()}
    assert want and got.keys() == want.keys() and all(abs(got[b] - want[b]) < 1e-12 for b in want)

    model = toxicity.fit(docs, labels)
    order = sorted(want)
    assert model.buckets.tolist() == order
    r = np.array([want[b] for b in order])
    x = np.array([[b in own for b in order] for own, _ in train]) * r
    y = np.array([k for _, k in train])

    def loss(w, c):
        s = x @ w + c
        return np.logaddexp(0, np.where(y == 1, -s, s)).mean() + settings.l2 / 2 * w @ w

    w, c = np.zeros(len(r)), math.log(n1 / n0)
    for _ in range(20_000):
        off = (1 / (1 + np.exp(-(x @ w + c))) - y) / len(y)
        w, c = w - 0.02 * (x.T @ off + settings.l2 * w), c - 0.02 * off.sum()
    assert loss(model.weights / r, model.bias) < loss(w, c) + 0.01
    scores = {q.doc_id: q.score for q in toxicity.score(docs, model).collect()}
    for i, t, _ in rows:
        own = slow_features(t)
        s = model.bias + sum(v for b, v in zip(order, model.weights, strict=True) if b in own)
        assert abs(scores[i] - 1 / (1 + math.exp(-s))) < 1e-5


def test_toxicity_with_columns_that_clash(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t, _ in rows] + [(None, None, 1, 2, "x")] * 2, "doc_id long, text string, toxic int, bucket int, score string")
    labels = spark.createDataFrame([(i, int(x), "t") for i, _, x in rows] + [(None, 1, "t"), (rows[0][0], 1, "t")], "doc_id long, toxic int, text string")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(rows) + 2 and all(r.held_out for r in got if r.doc_id is None)


def test_fixity_digests_hold_the_offsets(spark):
    """The digest of a node by hand, from its children's ranges of bytes."""
    pages = spark.createDataFrame([(i, f"http://x/{i}", "h" * i) for i in range(130)], "page_id long, url string, html string")
    records = fixity.records_of(pages)
    levels = fixity.tree(records, (0, 129), 2, "t")
    leaves = {r.node: r for r in levels[0].collect()}
    for r in levels[1].collect():
        at, said = 0, ""
        for node in sorted(n for n in leaves if n >> 6 == r.node):
            to = at + leaves[node].bytes
            said += f"{node}:{at}:{to}:{leaves[node].digest},"
            at = to
        assert r.digest == hashlib.sha256(said.encode()).hexdigest() and r.bytes == at
    assert levels[2].count() == 1


def test_fixity_reads_no_folder_beside_the_path(spark):
    pages = spark.createDataFrame([(i, "u", "h") for i in range(40_000)], "page_id long, url string, html string")
    replica = pages.withColumn("html", F.when(F.col("page_id") == 20_001, "x" * 9).otherwise(F.col("html")))
    ids, levels = fixity.extent(fixity.records_of(pages), fixity.records_of(replica))
    leaves = fixity.tree(fixity.records_of(pages), ids, levels, "t")[0]
    assert 5 < leaves.select("chunk").distinct().count() <= 1 << fixity.CHUNKS
    found = fixity.audit(fixity.records_of(pages), fixity.records_of(replica))
    assert [(r.id, r.status) for r in found.collect()] == [(20_001, "changed")]
    scans = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "fixity-a-0" in x or "fixity-b-0" in x]
    assert scans and all("chunk#" in x.partition("PartitionFilters: [")[2].partition("PushedFilters")[0] for x in scans)


def test_fixity_of_long_and_repeated_records(spark):
    rows = [(1, "u", "h" * 3_000_000), (2, None, None), (2, None, None), (None, "n", ""), (None, "n", ""), (-5, "neg", "x"), (1 << 40, "far", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    worse = pages.filter("page_id IS NULL OR page_id <> 2").union(spark.createDataFrame([(2, None, None), (-6, "new", "z")], pages.schema))
    got = {r.id: (r.status, r.n_primary, r.n_replica) for r in fixity.audit(fixity.records_of(pages), fixity.records_of(worse)).collect()}
    assert got == {2: ("changed", 2, 1), -6: ("extra", 0, 1)}


def test_urls_with_many_rules_and_long_paths(spark):
    rules = [(f"h{i % 50}.com", "/" + "p" * (i % 40) + "/", "block" if i % 3 else "allow") for i in range(400)]
    rules += [("com", "", "allow"), ("", "/", "block"), (None, "/", "block"), ("h1.com", None, "block"), ("H2.com", "/q", "allow"), ("h2.com", "/q", "block")]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    pages = [f"http://a.h{i % 60}.com/{'p' * (i % 45)}/x" for i in range(300)] + ["http://h2.com/qq", "http://h3.com/" + "p" * 200_000, "http://x.org/"]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(pages)], "page_id long, url string, host int")

    def slow(url):
        rest = url.split("://", 1)[1]
        host, _, path = rest.partition("/")
        path = "/" + path
        fits = [(len(h), len(p), v == "block", h.lower() + p) for h, p, v in rules if h and p is not None and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
        best = max(fits, default=(0, 0, False, None))
        return best[3], "block" if best[2] else "allow"

    got = {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(df, table).collect()}
    assert got == {i: slow(u) for i, u in enumerate(pages)}
    assert urls.filter_urls(df, table.limit(0)).filter("rule IS NOT NULL").count() == 0
