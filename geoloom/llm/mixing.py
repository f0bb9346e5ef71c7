"""Mixing sources to target weights by hash-threshold histograms.

Every row has a 60-bit hash of its doc_id and text. For each source, words are summed by hash bucket; the bucket
in which the running sum passes the budget is the only one that is looked into further, by the next bits, until it
holds one hash. What lies below the threshold is taken: nothing is sorted, and no source's rows meet in one task. A row
that would overshoot the budget is passed over; the gap it leaves is offered, in further nested rounds, to the rows above
the threshold that fit in it, until none does. So a source takes, in order of its hashes, each row that still fits.

A level's running sum is over the counts of one source's buckets: 2 ** 12 or 2 ** 16 of them at most, whatever its rows.

Defined results: a null text has no words; null sources are one source, the last in order; sources without words
have a target of 0; an empty table gives an empty result. Rows alike in doc_id and text have one hash; of those at the
threshold as many are taken as fit, which ones does not show. Targets and budgets depend on the corpus alone, so reruns
agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.llm.tables import cut, join_small, once, read

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its words.
MOST = 3
#: Bits of the hash by which each level of the histograms tells rows apart; their sum is HASH_BITS.
LEVELS = (12, 16, 16, 16)
HASH_BITS = 60
#: Above every hash: the threshold of a source all of whose rows fit.
ALL = 1 << HASH_BITS


def n_words(text: Column) -> Column:
    """Words as single-spaced text has them: one more than its spaces."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    spaces = F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit("")))
    return F.when(F.length(plain) == 0, F.lit(0)).otherwise(spaces + 1).cast("bigint")


def row_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of doc_id, a line feed and the text; nulls count as empty."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target of (source, source_size): shares by weight of all words, capped at MOST
    times the source's size, the excess reshared by weight until no target is above.

    In order of cap over weight, a source is capped exactly if its cap is at most the share it would have once
    all before it are capped; the others share the rest by weight. One row a source is sorted here, no more."""
    order = W.orderBy(F.col("source").isNull(), "source")
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    s = sizes.withColumn("weight", F.element_at(weights, (F.row_number().over(order) - 1) % len(WEIGHTS) + 1))
    s = s.withColumn("cap", (MOST * F.col("source_size")).cast("double"))
    by = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(
        W.unboundedPreceding, -1
    )
    everything = W.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    s = s.withColumn("weights", F.sum("weight").over(everything))
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(by), F.lit(0.0)))
    s = s.withColumn("gone", F.coalesce(F.sum("weight").over(by), F.lit(0.0)))
    share = (F.col("total") - F.col("capped")) / (F.col("weights") - F.col("gone"))
    s = s.withColumn("rate", share).withColumn("over", F.col("cap") <= F.col("weight") * F.col("rate"))
    rate = F.min(F.when(~F.col("over"), F.struct("capped", "rate"))).over(everything)["rate"]
    return s.withColumn("free", rate).select(
        "source",
        "source_size",
        F.when(F.col("over"), F.col("cap")).otherwise(F.col("weight") * F.col("free")).alias("target"),
    )


def _threshold(pool: DataFrame, budgets: DataFrame, step: str) -> DataFrame:
    """key, threshold, split and gap of (key, hash, size) under (key, budget): all rows whose hash is below the
    threshold are taken, and split of those that have it; the gap is what is left. A key whose rows all fit has a
    threshold above every hash."""
    shift, rows, left = HASH_BITS, pool, budgets.select("key", "budget")
    totals = pool.groupBy("key").agg(F.sum("size").alias("n")).join(budgets, "key").filter(F.col("n") <= F.col("budget"))
    done = totals.select("key", F.lit(ALL).alias("threshold"), F.lit(0).cast("bigint").alias("split"), (F.col("budget") - F.col("n")).alias("gap"))
    for level, bits in enumerate(LEVELS):
        shift -= bits
        sums = rows.groupBy("key", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high"), F.max("size").alias("one")
        )
        running = F.sum("n").over(W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
        # The first bucket in which the budget is passed, and what stands before it.
        edge = (
            sums.withColumn("to", running)
            .join(left.select("key", "budget"), "key")
            .filter(F.col("to") > F.col("budget"))
            .groupBy("key", "budget")
            .agg(F.min(F.struct("bucket", (F.col("to") - F.col("n")).alias("before"), "low", "high", "one")).alias("e"))
            .select("key", (F.col("budget") - F.col("e.before")).alias("budget"), "e.bucket", "e.low", "e.high", "e.one")
        )
        edge = cut(edge, f"mix-{step}-edge{level}")
        # A bucket of one hash is as far as it goes: rows alike, of one size.
        split = F.floor(F.col("budget") / F.col("one"))
        found = edge.filter("low = high").select("key", F.col("low").alias("threshold"), split.alias("split"), (F.col("budget") - split * F.col("one")).alias("gap"))
        done = done.union(found)
        left = edge.filter("low < high")
        if left.isEmpty():
            break
        inner = join_small(rows, left.select("key", "bucket"), ["key"], "inner")
        rows = cut(inner.filter(F.shiftright("hash", shift) == F.col("bucket")).select("key", "hash", "size"), f"mix-{step}-rows{level}")
    return done


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def plan(rows: DataFrame) -> DataFrame:
    """One row a source (key, source, source_size, target, epochs, steps): what decides each row.

    rows: source, hash, size. A source gives epochs whole copies, then one more of the rows that the rounds take. steps:
    each round's gap (room before it), threshold and split. A round takes those not yet taken that fit in its gap
    and have a hash below its threshold, and split of those that have it."""
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    size = F.col("source_size").cast("double")
    sources = sources.withColumn("key", _key(F.col("source"))).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.least(F.lit(float(MOST)), F.floor(F.col("target") / size))).otherwise(0).cast("bigint")
    )
    none = F.array().cast("array<struct<gap:bigint,threshold:bigint,split:bigint>>")
    sources = sources.withColumn("room", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("bigint")).withColumn("steps", none)
    sources, pool, turn = cut(sources, "mix-sources"), rows.withColumn("key", _key(F.col("source"))).filter("size > 0").select("key", "hash", "size"), 0
    while not pool.isEmpty():
        found = _threshold(pool, sources.select("key", F.col("room").alias("budget")).filter("budget > 0"), str(turn))
        step = F.struct(F.col("room").alias("gap"), "threshold", "split")
        sources = sources.join(found, "key", "left").select(
            "key", "source", "source_size", "target", "epochs",
            F.when(F.col("threshold").isNotNull(), F.concat("steps", F.array(step))).otherwise(F.col("steps")).alias("steps"),
            F.coalesce("gap", F.lit(0)).alias("room"), F.coalesce("threshold", F.lit(ALL)).alias("threshold"),
        )
        sources = cut(sources, f"mix-plan{turn}")
        near = join_small(pool, sources.select("key", "room", "threshold"), ["key"], "inner")
        pool = cut(near.filter((F.col("hash") > F.col("threshold")) & (F.col("size") <= F.col("room"))).select("key", "hash", "size"), f"mix-pool{turn}")
        sources, turn = sources.drop("threshold"), turn + 1
    return sources


def _decided(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows (key, size, hash, and others) with their source's plan and copies, how often each is taken.

    Of rows that have a threshold itself, the first split are taken: only these rows, all alike, are numbered."""
    held = join_small(rows, sources.drop("source"), ["key"])
    size, row = F.col("size"), F.col("hash")
    below = F.exists("steps", lambda s: (row < s["threshold"]) & (size <= s["gap"]))
    at = F.aggregate(
        "steps", F.lit(0).cast("bigint"),
        lambda n, s: n + F.when((row == s["threshold"]) & (size <= s["gap"]), s["split"]).otherwise(F.lit(0)),
    )
    # A row below an earlier threshold that did not fit then does not fit later: gaps only shrink.
    held = held.withColumn("some", F.when(size > 0, at).otherwise(F.lit(0))).withColumn("below", (size > 0) & below)
    held = held.withColumn("epochs", F.when(size > 0, F.col("epochs")).otherwise(F.lit(0)))
    clear = held.filter("some = 0").withColumn("copies", F.col("epochs") + F.col("below").cast("bigint"))
    nth = F.row_number().over(W.partitionBy("key", "hash").orderBy(F.lit(0)))
    edge = held.filter("some > 0").withColumn("copies", F.col("epochs") + (nth <= F.col("some")).cast("bigint"))
    return clear.unionByName(edge)


def _measured(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("hash"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of docs."""
    rows = cut(_measured(docs), "mix-rows")
    out = _decided(rows.withColumn("key", _key(F.col("source"))), plan(rows))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def take(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them, with the columns of docs. Rows without words go."""
    sources = plan(cut(_measured(docs).select("source", "hash", "size"), "mix-rows"))
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        _key(F.col("source")).alias("key"),
        n_words(F.col("text")).alias("size"),
        row_hash(F.col("doc_id"), F.col("text")).alias("hash"),
    )
    out = _decided(once(own, "doc", "key", "size", "hash"), sources)
    return out.filter("copies > 0").select("doc", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("one")).select("doc.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


OP2_SQL = """
WITH RECURSIVE base AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')), 1, 15) AS BIGINT) AS hash
  FROM documents
), sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight,
         (3 * source_size)::DOUBLE AS cap FROM sizes
), shared AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE AS total, sum(weight) OVER () AS weights,
         coalesce(sum(cap) OVER o, 0) AS capped, coalesce(sum(weight) OVER o, 0) AS gone
  FROM weighed
  WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), rated AS (
  SELECT *, (total - capped) / (weights - gone) AS rate, cap <= weight * ((total - capped) / (weights - gone)) AS above FROM shared
), aimed AS (
  SELECT source, source_size, CASE WHEN above THEN cap ELSE weight *
    (SELECT r.rate FROM rated r WHERE NOT r.above ORDER BY r.capped LIMIT 1) END AS target FROM rated
), planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(least(3, floor(target / source_size)) AS BIGINT) ELSE 0 END AS epochs FROM aimed
), nth AS (
  SELECT b.*, p.source_size, p.target, p.epochs, CAST(floor(p.target - p.epochs * p.source_size) AS BIGINT) AS room,
         row_number() OVER (PARTITION BY b.source ORDER BY b.hash) AS i
  FROM base b JOIN planned p ON b.source IS NOT DISTINCT FROM p.source
), walk(source, i, rest, more) AS (
  SELECT source, 0::BIGINT, any_value(room), 0::BIGINT FROM nth GROUP BY source
  UNION ALL SELECT n.source, n.i, w.rest - CASE WHEN n.size <= w.rest THEN n.size ELSE 0 END, CASE WHEN n.size > 0 AND n.size <= w.rest THEN 1::BIGINT ELSE 0::BIGINT END
  FROM walk w JOIN nth n ON n.source IS NOT DISTINCT FROM w.source AND n.i = w.i + 1
)
SELECT n.doc_id, n.size, n.source_size, n.target, CAST(n.size * (n.epochs + w.more) AS BIGINT) AS taken
FROM nth n JOIN walk w ON n.source IS NOT DISTINCT FROM w.source AND n.i = w.i
"""
