"""A gap that takes all that is left of a source is filled."""

import random

from geoloom.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_that_all_fit_are_taken(spark):
    sizes = [("k0", 0, 100_000)] + [("k0", i, 100) for i in range(1, 301)]
    rows = spark.createDataFrame([(k, i, n) for k, i, n in sizes], "key string, hash long, size long")
    pool = rows.filter("hash > 0")
    budgets = spark.createDataFrame([("k0", 50_000)], "key string, budget long")
    found = mixing._threshold(pool, budgets, "test").collect()
    assert len(found) == 1 and found[0].threshold > (1 << mixing.HASH_BITS) - 1 and found[0].gap == 20_000


def test_a_long_document_does_not_empty_its_source(spark):
    # The long document has the lowest hash of its source, found by trying names for it.
    short = [(i, " ".join(["w"] * 100), "en", "z", 0) for i in range(1, 301)]
    df = spark.createDataFrame(short, DOCS)
    least = df.select(mixing.row_hash(df.doc_id, df.text).alias("h")).agg({"h": "min"}).first()[0]
    text = " ".join(["w"] * 100_000)
    tries = spark.range(1000, 9000).selectExpr("id AS doc_id").withColumn("text", mixing.F.lit(text))
    first = tries.filter(mixing.row_hash(tries.doc_id, tries.text) < least).first().doc_id
    other = [(20_000 + i, " ".join(["v"] * 1000), "en", s, 0) for i in range(20) for s in ("b", "c")]
    docs = spark.createDataFrame([*short, (first, text, "en", "z", 0), *other], DOCS)
    own = [r for r in mixing.mix(docs).join(docs.filter("source = 'z'").select("doc_id"), "doc_id").collect()]
    target, epochs = own[0].target, int(own[0].target // own[0].source_size)
    gap = int(target - epochs * own[0].source_size)
    extra = sum(r.taken for r in own) - epochs * own[0].source_size
    assert 0 < gap < 100_000 and extra == min(30_000, gap // 100 * 100)


def slow_taken(rows, room):
    """Rows (hash, size) in order: each that still fits is taken."""
    taken = []
    for h, n in sorted(rows):
        if 0 < n <= room:
            taken.append((h, n))
            room -= n
    return taken


def test_rounds_take_what_fits_in_order(spark):
    rng = random.Random(9)
    rows = [("a", rng.randrange(1 << 60), rng.choice([0, 1, 3, 50, 900])) for _ in range(400)]
    rows += [("b", rng.randrange(1 << 60), 100) for _ in range(30)] + [("b", 5, 7)] * 40 + [(None, 77, 10)] * 500
    df = spark.createDataFrame(rows, "source string, hash long, size long")
    sources = mixing.plan(df)
    decided = mixing._decided(df.withColumn("key", mixing._key(df.source)), sources).collect()
    plans = {r.source: r for r in sources.collect()}
    for source in ("a", "b", None):
        own, p = [(h, n) for s, h, n in rows if s == source], plans[source]
        want = slow_taken(own, int(p.target - p.epochs * p.source_size))
        got = sorted((r.hash, r["size"]) for r in decided if r.key == ("n" if source is None else "s" + source) for _ in range(r.copies - (p.epochs if r["size"] else 0)))
        assert got == sorted(want)
        assert p.target - (p.epochs * p.source_size + sum(n for _, n in got)) < max(n for _, n in own)


def test_a_source_of_repeats_comes_near_its_target(spark):
    """All rows of a source alike in doc_id and text: as many as fit are taken, and columns that clash stay."""
    rows = [(1, "w " * 10, "en", "z", 0)] * 50 + [(100 + i, "v " * 20, "en", s, 0) for i in range(30) for s in ("a", "b")]
    docs = spark.createDataFrame(rows, DOCS)
    for name in ("key", "hash", "size", "steps", "copies", "epochs", "doc"):
        docs = docs.withColumn(name, mixing.F.lit(name))
    own = mixing.mix(docs).filter("doc_id = 1").collect()
    assert len(own) == 50 and 0 <= own[0].target - sum(r.taken for r in own) < 10
    taken = mixing.take(docs)
    assert taken.columns == docs.columns and taken.filter("doc_id = 1").count() == sum(r.taken for r in own) // 10
