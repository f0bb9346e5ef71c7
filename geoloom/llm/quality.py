"""Quality rules: Jensen-Shannon distance of a document's character classes and common words to its language.

All steps are DataFrame functions. One scan counts what the rules need and writes the counts (no text) to the
shared folder; a second, over those counts, sums the references of each language and judges every document.

Defined results: a null text is an empty one; a null or unlisted language is held against the sum of all
languages; a document too short for a stable histogram, or a reference of too few words, gets no distance and
is kept unless a base rule fails it. Repeated rows are judged alike, row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm.tables import cut, fresh, once, read

#: Frequent function words of the languages that have a reference of their own.
COMMON_WORDS = {
    "en": "the of and to in a is was that for it with as on by at from are this be an or not".split(),
    "de": "der die und das in den von zu mit ist auf für im sich eine ein dem nicht als des an es auch".split(),
    "fr": "de la le et les des en un une du que pour dans est par sur pas au avec il ne plus qui".split(),
    "es": "de la que el en y los del se las un por con una su para es al lo como más o no".split(),
}
#: Character classes, each counted on what the ones before it left.
CLASSES = [
    ("lower", r"\p{Ll}+"),
    ("upper", r"\p{Lu}+"),
    ("digit", r"\p{Nd}+"),
    ("stop", r"[.,;:]+"),
    ("quote", r"[!?'\"()-]+"),
    ("symbol", r"[#*$%&|<>=+_/\\^~@\[\]{}`]+"),
]


@dataclass(frozen=True)
class Rules:
    """min_words and max_repeat_percent are the base rules; the rest belongs to the distances."""

    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    guard_chars: int = 100
    guard_words: int = 20
    reference_words: int = 1_000
    max_class_distance: float = 0.22
    max_word_distance: float = 0.20
    class_slack: float = 1.8
    word_slack: float = 1.05


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.transform(F.array(value), body)[0]


def _covered(hashes: Column, window: int) -> Column:
    """Words that lie in windows whose hash occurs twice or more: the union of [p, p + window)."""
    none = F.array(F.lit(None).cast("bigint"))
    zero = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))

    def repeated(pairs: Column) -> Column:
        keys, n = F.transform(pairs, lambda x: x["h"]), F.size(pairs)
        marked = F.zip_with(
            pairs,
            F.zip_with(
                F.concat(none, F.slice(keys, 1, n - 1)),
                F.concat(F.slice(keys, 2, n - 1), none),
                lambda x, y: F.struct(x.alias("b"), y.alias("a")),
            ),
            lambda x, y: F.when(x["h"].eqNullSafe(y["b"]) | x["h"].eqNullSafe(y["a"]), x["p"].cast("bigint")),
        )
        return F.array_sort(F.filter(marked, lambda p: p.isNotNull()))

    starts = _let(
        F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))), repeated
    )
    return F.aggregate(
        starts,
        zero,
        lambda acc, p: F.struct(
            (p + window).alias("end"), (acc["n"] + p + window - F.greatest(p, acc["end"])).alias("n")
        ),
        lambda acc: acc["n"],
    )


def _window_hashes(docs: DataFrame, words: str, stem: str, window: int) -> tuple[DataFrame, str]:
    """docs with an array of one hash for each run of window words (a power of two), by doubling: two hashes of
    k words make one of 2k, so each word is hashed once. 64 bits: two unlike windows of a text of a million
    words meet with odds of 1 in 10^7."""
    at, span = f"{stem}1", 1
    docs = docs.withColumn(at, F.transform(words, lambda x: F.xxhash64(x)))
    while span < window:
        shifted = F.slice(at, span + 1, F.greatest(F.size(at), F.lit(1)))
        span *= 2
        docs = docs.withColumn(f"{stem}{span}", F.zip_with(at, shifted, lambda x, y: F.xxhash64(x, y)))
        at = f"{stem}{span}"
    return docs.withColumn(stem, F.slice(at, 1, F.greatest(F.size(at) - (span - 1), F.lit(0)))), stem


def measure(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """docs with a struct column of counts: words, symbols, repeats and both histograms."""
    assert rules.window & (rules.window - 1) == 0, "windows are a power of two words long"
    name, stem = fresh(docs.columns, "_counts"), fresh([c[:2] for c in docs.columns], "_q")
    t, plain, w, lines, bare = (f"{stem}_{x}" for x in ("text", "plain", "words", "lines", "bare"))
    out = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn(plain, F.trim(F.regexp_replace(t, r"[\x20\x09-\x0D]+", " ")))
    out = out.withColumn(w, F.when(F.col(plain) == "", F.array().cast("array<string>")).otherwise(F.split(plain, " ", -1)))
    out, h = _window_hashes(out, w, f"{stem}_h", rules.window)
    out = out.withColumn(f"{stem}_dense", F.replace(plain, F.lit(" "), F.lit("")))
    at = [f"{stem}_dense"]
    for i, (_, pattern) in enumerate(CLASSES):
        out = out.withColumn(f"{stem}_left{i}", F.regexp_replace(at[-1], pattern, ""))
        at.append(f"{stem}_left{i}")
    classes = [F.length(at[i]) - F.length(at[i + 1]) for i in range(len(CLASSES))]
    out = out.withColumn(lines, F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    common = sorted({x for words in COMMON_WORDS.values() for x in words})
    out = out.withColumn(bare, F.filter(w, lambda x: x.isin(common)))
    lists = F.array(*map(F.lit, common))
    for code, words in COMMON_WORDS.items():
        lists = F.when(F.col(lang) == code, F.array(*map(F.lit, words))).otherwise(lists)
    counts = F.struct(
        F.size(w).cast("bigint").alias("n_words"),
        F.length(at[0]).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0))
        .otherwise(_covered(F.col(h), rules.window))
        .cast("bigint")
        .alias("n_repeat_words"),
        F.array(*[c.cast("bigint") for c in (*classes, F.length(at[-1]))]).alias("classes"),
        F.transform(
            lists, lambda x: (F.size(bare) - F.size(F.array_remove(F.col(bare), x))).cast("bigint")
        ).alias("hits"),
        F.when(F.col(lang).isin(*COMMON_WORDS), F.col(lang)).otherwise(F.lit("*")).alias("reference"),
    )
    return out.withColumn(name, counts).select(*[F.col(f"`{c}`") for c in docs.columns], F.col(name))


def base_failed(c: Column, rules: Rules) -> Column:
    return (c["n_words"] < rules.min_words) | (100 * c["n_repeat_words"] > rules.max_repeat_percent * c["n_words"])


def references(counts: DataFrame, rules: Rules) -> dict[str, tuple[list[int], list[int], int]]:
    """Summed histograms of the documents that pass the base rules: one row a listed language and one for the
    rest, so what reaches the driver is bounded by the list. A language of too few words has none."""
    c = F.col("counts")
    widths = {code: len(words) for code, words in COMMON_WORDS.items()}
    widths["*"] = len({x for words in COMMON_WORDS.values() for x in words})
    sums = (
        counts.filter(~base_failed(c, rules))
        .groupBy(c["reference"].alias("reference"))
        .agg(
            F.sum(c["n_words"]).alias("n"),
            *[F.sum(c["classes"][i]).alias(f"c{i}") for i in range(len(CLASSES) + 1)],
            *[F.sum(F.get(c["hits"], F.lit(i))).alias(f"w{i}") for i in range(max(widths.values()))],
        )
    )
    found = {}
    for r in sums.collect():
        if r["n"] >= rules.reference_words:
            found[r["reference"]] = (
                [r[f"c{i}"] for i in range(len(CLASSES) + 1)],
                [r[f"w{i}"] for i in range(widths[r["reference"]])],
                r["n"],
            )
    return found


def fit(counts: DataFrame, rules: Rules) -> dict:
    """References of all documents that pass the base rules, then of those alone that these references keep,
    so that a share of junk doesn't stay in what it is measured against."""
    return references(judge(counts, references(counts, rules), rules).filter("kept").select("counts"), rules)


def _distance(own: Column, total: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance, base 2, of own / total to a literal distribution."""
    ref = F.array(*[F.lit(float(x)) for x in reference])

    def part(p: Column, m: Column) -> Column:
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    terms = F.zip_with(
        own, ref, lambda a, q: part(a / total, (a / total + q) / 2) + part(q, (a / total + q) / 2)
    )
    # Rounded before the root, so that the order of summation never shows.
    return F.sqrt(F.greatest(F.lit(0.0), F.round(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, 9)))


def judge(counts: DataFrame, known: dict, rules: Rules) -> DataFrame:
    """counts (a struct column named counts) with class_distance, word_distance, base_failed and kept."""
    c = F.col("counts")
    n_chars = F.aggregate(c["classes"], F.lit(0).cast("bigint"), lambda s, x: s + x)
    near = near_words = F.lit(None).cast("double")
    for code, (classes, hits, n) in known.items():
        total = max(1, sum(classes))
        here = c["reference"] == code
        near = F.when(here, _distance(c["classes"], n_chars, [x / total for x in classes])).otherwise(near)
        others = c["n_words"] - F.aggregate(c["hits"], F.lit(0).cast("bigint"), lambda s, x: s + x)
        own = F.concat(c["hits"], F.array(others))
        near_words = F.when(
            here, _distance(own, c["n_words"], [x / n for x in hits] + [(n - sum(hits)) / n])
        ).otherwise(near_words)
    failed = base_failed(c, rules)
    out = counts.withColumn("class_distance", F.when(n_chars >= rules.guard_chars, near)).withColumn(
        "word_distance", F.when(c["n_words"] >= rules.guard_words, near_words)
    )
    # Short histograms stray by chance: the bound widens with one over the root of the length.
    wide_class = rules.max_class_distance + rules.class_slack / F.sqrt(n_chars)
    wide_word = rules.max_word_distance + rules.word_slack / F.sqrt(c["n_words"])
    apart = (F.col("class_distance") > wide_class) | (F.col("word_distance") > wide_word)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.coalesce(apart, F.lit(False)))


def quality(docs: DataFrame, rules: Rules = Rules(), known: dict | None = None) -> DataFrame:
    """One row per row of docs: doc_id, the counts, both distances, base_failed and kept. known: references that have been
    fitted before (fit), so that verdicts don't depend on what else is in docs; else they are fitted on docs."""
    measured = measure(docs.select("doc_id", "text", "lang"), rules)
    counts = cut(measured.select("doc_id", F.col(measured.columns[-1]).alias("counts")), "quality-counts")
    return judge(counts, fit(counts, rules) if known is None else known, rules)


def filter_kept(docs: DataFrame, rules: Rules = Rules(), known: dict | None = None) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs; rows are judged where they stand. known: as in
    quality()."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    measured = measure(docs.select(row, "text", "lang"), rules)
    counts = F.col(measured.columns[-1]).alias("counts")
    known = fit(cut(measured.select(counts), "quality-counts"), rules) if known is None else known
    return judge(once(measured, "doc", counts), known, rules).filter("kept").select("doc.*")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    c = F.col("counts")
    return quality(read(spark, sf_dir, "documents")).select(
        "doc_id",
        *[c[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed",
        "kept",
        F.round("class_distance", 6).alias("class_distance"),
        F.round("word_distance", 6).alias("word_distance"),
    )
