"""Source divergence audit: how far the term shares of a language's sources lie from one another.

Terms are counted per (lang, source) while texts are read: a task's counts are summed in bounded dictionaries before
they are shuffled. A term that stands in enough documents of its language is kept, with its count in each of the
sources that have it. Terms alike in language and all counts are one signature with a multiplicity. Signatures give
each pair of sources its joint histogram: how many terms have the counts (c, d). Cells with a zero follow from the
margins: the terms of count c in one source, less those that the other has too, and of (0, 0) what is left of all V.
The share p(c) = 1 + SCALE * (c + 1) div (N + V) depends on the count alone, so f is evaluated once a combination and
multiplied. Every number is a whole one; products that may pass 64 bits are decimals.

Size: a signature holds one entry a source of its language; the result has a row for each ordered pair of sources.

Defined results: null text, lang and source are ''; a text without terms adds none, but its group occurs; a language
without kept terms has pairs of value 0 and p of 1; rows repeated count as often as they stand, as documents of their own
(doc_id isn't read, so null or equal ones don't matter); no rows give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geoloom.llm.tables import NARROW_ROWS, cut, join_small, read

SCALE, LEAST_DOCS, TOP = 1_000_000_000, 3, 200
#: Entries of a task's dictionaries at which they are handed on, and bytes of a text counted at once.
HELD, PIECE = 1_000_000, 1 << 20
#: A term's occurrences and documents held as one number: a document counts as this many occurrences.
_DOC = 1 << 40
#: ASCII letters in lower case and all bytes beyond ASCII stay; anything else parts terms.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def term_counts(text: str) -> Counter:
    """Counts of a text's terms, as UTF-8. A long text is counted by pieces that end between terms."""
    plain = text.encode("utf-8", "replace").translate(_BYTES)
    if len(plain) <= PIECE:
        return Counter(plain.split())
    found, at = Counter(), 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        found.update(plain[at:end].split())
        at = end
    return found


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, its occurrences and documents; once a task and group a row with a null term."""
    held: dict[tuple[str, str], dict[bytes, int]] = {}
    groups: set[tuple[str, str]] = set()

    def handed() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in held.items():
            terms, both = list(own), np.fromiter(own.values(), np.int64, len(own))
            for i in range(0, len(terms), 50_000):
                names, part = pa.array(terms[i : i + 50_000], pa.binary()).cast(pa.string()), both[i : i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang, len(part)), pa.repeat(source, len(part)), names, pa.array(part % _DOC), pa.array(part // _DOC)], schema=_COUNTS
                )

    for batch in batches:
        for text, lang, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            key = (lang or "", source or "")
            groups.add(key)
            own = held.setdefault(key, {})
            get = own.get
            for term, n in term_counts(text or "").items():
                own[term] = get(term, 0) + n + _DOC
        if sum(map(len, held.values())) > HELD:
            yield from handed()
            held.clear()
    yield from handed()
    if groups:
        lang, source = zip(*sorted(groups), strict=True)
        none = [0] * len(groups)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(source), pa.nulls(len(groups), pa.string()), pa.array(none), pa.array(none)], schema=_COUNTS)


def share(count: Column, whole: Column) -> Column:
    """1 + SCALE * (count + 1) div whole, exactly: by longs where the product is one, else by decimals."""
    long = F.call_function("div", (count + 1) * F.lit(SCALE).cast("bigint"), whole)
    wide = F.call_function("div", (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(18,0)"), whole.cast("decimal(20,0)"))
    return F.lit(1) + F.when(count < (1 << 63) // SCALE - 1, long).otherwise(wide)


def gap(p: Column, q: Column) -> Column:
    """f: (p - q) squared, over q, rounded down."""
    return F.call_function("div", (p - q) * (p - q), q)


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """Kept terms (lang, term, cells: their count in each source that has them, n: in all) and the (lang, source) groups."""
    text = docs.select("text", "lang", "source")
    counts = cut(
        text.mapInArrow(_counts, "lang string, source string, term string, n bigint, docs bigint")
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")),
        "divergence-counts",
    )
    terms = counts.filter(F.col("term").isNotNull()).groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("source", F.col("n").alias("c")))).alias("cells")
    )
    kept = cut(terms.filter(F.col("docs") >= least_docs).select("lang", "term", "cells", "n"), "divergence-kept")
    return kept, counts.filter(F.col("term").isNull()).select("lang", "source")


def joint_histograms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, c, d, terms: of each two sources a < b of a language, how many kept terms have count c in a and d
    in b, cells with zeros included."""
    signatures = cut(kept.groupBy("lang", "cells").agg(F.count("*").alias("m")), "divergence-signatures")
    one = signatures.select("lang", "cells", "m", F.posexplode("cells").alias("i", "x"))
    # Cells stand in order of their sources: those behind a cell are its pairs.
    two = one.select("lang", "m", "x", F.explode(F.slice("cells", F.col("i") + 2, F.size("cells"))).alias("y"))
    both = two.groupBy("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.col("x.c").alias("c"), F.col("y.c").alias("d"))
    both = cut(both.agg(F.sum("m").alias("terms")), "divergence-both")
    margin = one.groupBy("lang", F.col("x.source").alias("source"), F.col("x.c").alias("c")).agg(F.sum("m").alias("terms"))
    margin = cut(margin, "divergence-margins")
    v = kept.groupBy("lang").agg(F.count("*").alias("v"))
    left, right = groups.select("lang", F.col("source").alias("a")), groups.select("lang", F.col("source").alias("b"))
    pairs = left.join(right, "lang").filter("a < b")
    in_a = join_small(pairs, margin.withColumnRenamed("source", "a"), ["lang", "a"], "inner", NARROW_ROWS).select("lang", "a", "b", "c", "terms")
    in_b = join_small(pairs, margin.select("lang", F.col("source").alias("b"), F.col("c").alias("d"), "terms"), ["lang", "b"], "inner", NARROW_ROWS)
    in_b, zero, less = in_b.select("lang", "a", "b", "d", "terms"), F.lit(0).cast("bigint"), -F.col("terms")
    whole = join_small(pairs, v, ["lang"], "inner").select("lang", "a", "b", zero.alias("c"), zero.alias("d"), F.col("v").alias("terms"))
    row = lambda df, c, d, n: df.select("lang", "a", "b", c.alias("c"), d.alias("d"), n.alias("terms"))
    c, d, n = F.col("c"), F.col("d"), F.col("terms")
    # A term of a stands in (c, 0) unless b has it, and so is not in (0, 0); what both have was taken off there twice.
    parts = [
        both, row(in_a, c, zero, n), row(in_a, zero, zero, less), row(in_b, zero, d, n), row(in_b, zero, zero, less),
        row(both, c, zero, less), row(both, zero, d, less), row(both, zero, zero, n), whole,
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("lang", "a", "b", "c", "d").agg(F.sum("terms").alias("terms")).filter("terms <> 0")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, p, q, value, rank. Part `pair`: each other source of the language, value f(p, q) summed
    over all kept terms (p and q null). Part `term`: the top kept terms by f whose share in the source is above that in
    the language."""
    kept, groups = kept_terms(docs, least_docs)
    groups = cut(groups, "divergence-groups")
    wholes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_n"))
    own = kept.select("lang", F.explode("cells").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.c").alias("n"))
    sizes = groups.join(own, ["lang", "source"], "left").join(wholes, "lang", "left")
    v, n = F.coalesce("v", F.lit(0)), F.coalesce("n", F.lit(0))
    sizes = cut(sizes.select("lang", "source", (n + v).alias("w"), (F.coalesce("lang_n", F.lit(0)) + v).alias("lang_w")), "divergence-sizes")

    cells = joint_histograms(kept, groups)
    of = lambda at, name: sizes.select("lang", F.col("source").alias(at), F.col("w").alias(name))
    cells = join_small(join_small(cells, of("a", "wa"), ["lang", "a"], "inner"), of("b", "wb"), ["lang", "b"], "inner")
    cells = cells.select("lang", "a", "b", "terms", share(F.col("c"), F.col("wa")).alias("p"), share(F.col("d"), F.col("wb")).alias("q"))
    cells = cells.withColumns({"ab": gap(F.col("p"), F.col("q")) * F.col("terms"), "ba": gap(F.col("q"), F.col("p")) * F.col("terms")})
    sums = cells.groupBy("lang", "a", "b").agg(F.sum("ab").alias("ab"), F.sum("ba").alias("ba"))
    other = groups.select("lang", F.col("source").alias("b"))
    pairs = groups.select("lang", F.col("source").alias("a")).join(other, "lang").filter("a < b").join(sums, ["lang", "a", "b"], "left")
    way = lambda a, b, s: F.struct(F.col(a).alias("source"), F.col(b).alias("item"), F.coalesce(s, F.lit(0)).alias("value"))
    pairs = pairs.select("lang", F.inline(F.array(way("a", "b", "ab"), way("b", "a", "ba")))).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    terms = kept.select("lang", "term", F.col("n").alias("lang_n"), F.inline("cells"))
    terms = join_small(terms, sizes, ["lang", "source"], "inner").select(
        "lang", "source", "term", share(F.col("c"), F.col("w")).alias("p"), share(F.col("lang_n"), F.col("lang_w")).alias("q")
    )
    terms = terms.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).filter(F.col("rank") <= top))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
tokens AS (SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS lang_n FROM tokens GROUP BY ALL HAVING count(DISTINCT i) >= 3),
grouped AS (SELECT DISTINCT lang, source FROM docs),
counted AS (SELECT lang, source, term, count(*) AS n FROM tokens JOIN kept USING (lang, term) GROUP BY ALL),
full_counts AS (SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) AS n
    FROM grouped g JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
wholes AS (SELECT lang, source, sum(n)::HUGEINT + count(*) AS w, sum(lang_n)::HUGEINT + count(*) AS lang_w FROM full_counts GROUP BY ALL),
shares AS (SELECT f.lang, f.source, f.term, f.n, 1 + (1000000000::HUGEINT * (f.n + 1)) // w.w AS p, 1 + (1000000000::HUGEINT * (f.lang_n + 1)) // w.lang_w AS q
    FROM full_counts f JOIN wholes w USING (lang, source)),
pair_sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
    FROM grouped a JOIN grouped b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
