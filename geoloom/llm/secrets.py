"""Secret scans: spans by form, and strings that a battery of randomness tests tells from words.

By form: an assignment to a secret's name, an access key, a hexadecimal run. By the method: every other run of
MIN_TOKEN or more key characters is a candidate, as is what such a run has left on either side of a span by form (below that, a random string is not told from a word at ALPHA: this is
the operator's own lower bound, like those of the three forms). Its encoding (hex, base32, base36, base62, base64) is
inferred from its characters. Under the hypothesis that it is a random string of that alphabet it gets three p-values: of
a chi-squared test of uniformity, by the exact first three moments of the statistic at its length, which hold where
counts are far below those of the usual approximation; of a runs test about the alphabet's middle, where runs are
binomial; and of a serial-correlation test. Combined (three times the least), they must not fall below LEVEL.

A candidate's e-value is how much likelier it is as a random string than as a word, which grows with length, and is 0
for one that fails the battery or has no letter: so what is counted as a discovery is what is called. Within strata of
length, candidates are called at a false-discovery rate of ALPHA over all documents (the e-value form of Benjamini and
Hochberg's rule, which holds whatever the candidates' dependence, as far as words are no more even than WORDS says). Two
passes: the first leaves spans and candidates, no text; the counts of e-values by stratum and whole power of two, a
table of fixed size, give the bounds.

Defined results: a null text is an empty one, without spans; the digest of no spans is that of the empty string.
Positions are code points, ends exclusive. Rows repeated are scanned alike and counted each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.tables import cut, fresh, read

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs below these lengths are no spans; for these two a longer repeat finds the same ones.
ACCESS, HEX, ASSIGN_CHARS = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}", 12
MIN_TOKEN = 16
TOKEN = rf"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}"
KINDS = ("assign", "access", "hex", "random")
ALPHA = 0.01
#: Lower bounds of the strata of length.
STRATA = (16, 20, 24, 32, 48, 96)
#: Powers of two that e-values are counted by; larger ones count as the last.
BINS = 120
#: The least combined p-value of the three tests: so many random strings are passed over.
LEVEL = 0.003
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: The encodings in order of trial: pattern, alphabet.
ENCODINGS = (
    (r"^[0-9a-f]+$", DIGITS + "abcdef"),
    (r"^[0-9A-F]+$", DIGITS + "ABCDEF"),
    (r"^[A-Z2-7]+$", UPPER + "234567"),
    (r"^[a-z0-9]+$", LOWER + DIGITS),
    (r"^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    (r"^.+$", UPPER + LOWER + DIGITS + "+/"),
)
#: Shares of the characters of words: classes, and how many characters share each.
WORDS = (("aeiou", 0.36), ("bcdfghjklmnpqrstvwxyz", 0.56), (UPPER, 0.04), (DIGITS, 0.02), ("+/", 0.02))
#: Lengths summed at once by _starts.
STEP = 256


def _let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.transform(F.array(value), body)[0]


def _sums(lengths: Column) -> Column:
    """For an array: a struct of the sums before each element and the whole sum."""
    zero = F.struct(F.array().cast("array<bigint>").alias("before"), F.lit(0).cast("bigint").alias("all"))
    return F.aggregate(
        lengths,
        zero,
        lambda acc, x: F.struct(F.concat(acc["before"], F.array(acc["all"])).alias("before"), (acc["all"] + x).alias("all")),
    )


def _starts(lengths: Column) -> Column:
    """The sums before each element, in blocks of STEP: near linear for a text with any number of matches."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / STEP).cast("int")),
        lambda k: _sums(F.slice(lengths, k * STEP + 1, STEP)),
    )
    return _let(
        blocks,
        lambda bs: F.flatten(
            F.zip_with(
                bs, _sums(F.transform(bs, lambda b: b["all"]))["before"], lambda b, t: F.transform(b["before"], lambda o: o + t)
            )
        ),
    )


def _found(text: str, pattern: str, matches: str, keep) -> Column:
    """(start, end, token) of the matches of a pattern in a column, for those that keep(i, match) holds for."""
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("bigint"))
    sizes = F.transform(F.col(matches), lambda m: F.length(m).cast("bigint"))
    starts = _let(
        F.zip_with(F.slice(pieces, 1, F.size(matches)), sizes, lambda p, m: F.struct(p.alias("p"), m.alias("m"))),
        lambda z: F.zip_with(_starts(F.transform(z, lambda x: x["p"] + x["m"])), z, lambda s, x: s + x["p"]),
    )
    spans = F.zip_with(starts, F.col(matches), lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("token")))
    kept = F.filter(spans, keep)
    none = F.array().cast("array<struct<start:bigint,end:bigint,token:string>>")
    return F.when(F.size(matches) > 0, kept).otherwise(none)


def _values(text: str) -> Column:
    return F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))


def _count(token: Column, characters: str) -> Column:
    return F.length(token) - F.length(F.translate(token, characters, ""))


def tail(z: Column) -> Column:
    """The chance that a standard normal value exceeds z, to about 10^-7."""
    #: Hastings' coefficients of the error function.
    coefficients = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

    def upper(x: Column, t: Column) -> Column:
        poly = F.lit(0.0)
        for c in reversed(coefficients):
            poly = (poly + c) * t
        return poly * F.exp(-x * x) / 2

    half = lambda x: _let(1 / (1 + 0.3275911 * x), lambda t: upper(x, t))
    return _let(z, lambda v: _let(_let(F.abs(v) / 2**0.5, half), lambda u: F.when(v >= 0, u).otherwise(1 - u)))


def alphabet_of(bare: Column) -> Column:
    """The characters of the first encoding that a candidate may be in, in order."""
    found = F.lit(ENCODINGS[-1][1])
    for pattern, own in reversed(ENCODINGS[:-1]):
        found = F.when(bare.rlike(pattern), F.lit(own)).otherwise(found)
    return found


def battery(t: Column, a: Column) -> Column:
    """p_chi, p_runs and p_serial of a string as a random one of an alphabet (an even number of characters)."""
    middle = (F.length(a).cast("double") + 1) / 2
    squares = F.aggregate(
        F.split(a, ""),
        F.lit(0.0),
        lambda s, c: s + F.when(c == "", 0.0).otherwise(F.pow(F.length(t) - F.length(F.replace(t, c, F.lit(""))), F.lit(2.0))),
    )
    places = F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c: F.instr(a, c).cast("double") - middle)
    zero = F.struct(F.lit(0.0).alias("product"), F.lit(0.0).alias("turns"), F.lit(None).cast("double").alias("last"))

    def step(acc: Column, v: Column) -> Column:
        turns = F.coalesce(((acc["last"] > 0) != (v > 0)).cast("double"), F.lit(0.0))
        return F.struct((acc["product"] + F.coalesce(acc["last"] * v, F.lit(0.0))).alias("product"), (acc["turns"] + turns).alias("turns"), v.alias("last"))

    # What the formulas use more than once is worked out once: k characters, n of them in the string, sums over it.
    sums = F.struct(
        F.length(a).cast("double").alias("k"), F.length(t).cast("double").alias("n"), squares.alias("squares"), F.aggregate(places, zero, step).alias("s")
    )

    def told(m: Column) -> Column:
        k, n, s = m["k"], m["n"], m["s"]
        # A shifted gamma of the statistic's mean, variance and third moment, made normal by its cube root; half a step
        # off for the statistic's lattice.
        spread, shape = 2 * (k - 1) * (n - 1) / n, 2 * n * (k - 1) * (n - 1) / F.pow(k + 2 * n - 6, F.lit(2.0))
        off = (k / n * m["squares"] - n - k / n - (k - 1)) / F.sqrt(spread)
        z_chi = _let(shape, lambda g: (F.pow(F.greatest(1 + off / F.sqrt(g), F.lit(1e-12)), F.lit(1 / 3)) - 1 + 1 / (9 * g)) * 3 * F.sqrt(g))
        z_runs = F.greatest(F.abs(s["turns"] - (n - 1) / 2) - 0.5, F.lit(0.0)) / (F.sqrt(n - 1) / 2)
        # The sum's fourth cumulant makes its tails heavier than a normal one's, at short lengths by half.
        fourth = (0.24 * (n - 1) + 4.8 * (n - 2)) / ((n - 1) * (n - 1))
        bent = lambda z: _let(F.least(z, F.lit(4.0)), lambda y: z - fourth / 24 * (y * y * y - 3 * y))
        z_serial = _let(F.abs(s["product"]) / (F.sqrt(n - 1) * (k * k - 1) / 12), bent)
        one = F.lit(1.0)
        return F.struct(tail(z_chi).alias("p_chi"), F.least(2 * tail(z_runs), one).alias("p_runs"), F.least(2 * tail(z_serial), one).alias("p_serial"))

    return _let(sums, told)


def weigh(token: Column) -> Column:
    """Of a candidate: log2e (its e-value's logarithm) and passes (the battery, and some letter in it)."""
    bare = F.translate(F.rtrim(token, F.lit("=")), "-_", "+/")

    def judged(t: Column) -> Column:
        return _let(alphabet_of(t), lambda a: tested(t, a))

    def tested(t: Column, a: Column) -> Column:
        k, n = F.length(a).cast("double"), F.length(t).cast("double")
        words = F.lit(0.0)
        for characters, share in WORDS:
            words = words + _count(t, characters) * F.log2(F.lit(share / len(characters)))
        log2e = -n * F.log2(k) - words
        some = t.rlike("[A-Za-z]") & (n >= MIN_TOKEN - 2)
        passes = some & _let(battery(t, a), lambda x: 3 * F.least(x["p_chi"], x["p_runs"], x["p_serial"]) >= LEVEL)
        return F.struct(log2e.alias("log2e"), F.coalesce(passes, F.lit(False)).alias("passes"))

    return _let(bare, judged)


def stratum(length: Column) -> Column:
    place = F.lit(0)
    for i, low in enumerate(STRATA):
        place = F.when(length >= low, F.lit(i)).otherwise(place)
    return place


def _labelled(rank: int):
    """A span with its kind, in the order in which spans are written."""
    return lambda x: F.struct(
        x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(KINDS[rank]).alias("kind")
    )


def _free(run: Column, base: Column) -> Column:
    """What base spans leave of a run (start, end, token): the run itself, or its parts of MIN_TOKEN characters or more."""
    part = lambda start, end: F.struct(start.alias("start"), end.alias("end"), F.substr(run["token"], (start - run["start"] + 1).cast("int"), (end - start).cast("int")).alias("token"))

    def parts(own: Column) -> Column:
        # Spans stand in order of their starts; each part reaches from the furthest end so far to the next start.
        zero = F.struct(F.array().cast("array<struct<start:bigint,end:bigint>>").alias("gaps"), run["start"].alias("at"))
        gap = lambda acc, end: F.when(end - acc["at"] >= MIN_TOKEN, F.concat(acc["gaps"], F.array(F.struct(acc["at"].alias("start"), end.alias("end"))))).otherwise(acc["gaps"])
        gaps = F.aggregate(own, zero, lambda acc, b: F.struct(gap(acc, b["start"]).alias("gaps"), F.greatest(acc["at"], b["end"]).alias("at")), lambda acc: gap(acc, run["end"]))
        return F.when(F.size(own) == 0, F.array(run)).otherwise(F.transform(gaps, lambda g: part(g["start"], g["end"])))

    return _let(F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"])), parts)


def scan(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """docs with a struct column: base (kind, start, end by start, then kind) and candidates (start, end, w: log2e,
    passes), which are cut at base spans."""
    name, stem = fresh(docs.columns, "_secrets"), fresh([c[:2] for c in docs.columns], "_s")
    t = f"{stem}_text"
    out = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    for kind, pattern in zip(KINDS, (ASSIGN, ACCESS, HEX, TOKEN), strict=True):
        out = out.withColumn(f"{stem}_{kind}", F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
    values = F.when(F.size(f"{stem}_assign") > 0, _values(t)).otherwise(F.array().cast("array<string>"))
    out = out.withColumn(f"{stem}_values", values)
    for kind, pattern in zip(KINDS, (ASSIGN, ACCESS, HEX, TOKEN), strict=True):
        keep = (lambda x, i: F.length(F.get(F.col(f"{stem}_values"), i)) >= ASSIGN_CHARS) if kind == "assign" else (lambda x: F.lit(True))
        out = out.withColumn(f"{stem}_{kind}_at", _found(t, pattern, f"{stem}_{kind}", keep))
    base = F.array_sort(
        F.flatten(
            F.array(
                *[
                    F.transform(f"{stem}_{kind}_at", _labelled(i)) for i, kind in enumerate(KINDS[:3])
                ]
            )
        )
    )
    out = out.withColumn(f"{stem}_base", base)
    free = F.flatten(F.transform(f"{stem}_random_at", lambda x: _free(x, F.col(f"{stem}_base"))))
    weighed = F.transform(
        free, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), weigh(x["token"]).alias("w"))
    )
    out = out.withColumn(name, F.struct(F.col(f"{stem}_base").alias("base"), weighed.alias("candidates")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], name), name


def bounds(candidates: DataFrame) -> list[int]:
    """For each stratum of length the least whole log2e at which a candidate is called. candidates: one row each,
    (length, log2e, passes). What reaches the driver is bounded by strata times bins."""
    # All candidates are tests; those that fail have an e-value of 0 and are called at no bound.
    whole = F.when(F.col("passes") & (F.col("log2e") >= 0), F.least(F.floor("log2e"), F.lit(BINS))).otherwise(-1)
    counts = candidates.groupBy(stratum(F.col("length")).alias("stratum"), whole.cast("int").alias("bin")).agg(F.count("*").alias("n")).collect()
    found = []
    for i in range(len(STRATA)):
        own = {r["bin"]: r["n"] for r in counts if r["stratum"] == i}
        tests, called, bound = sum(own.values()), 0, BINS + 1
        for b in range(BINS, -1, -1):
            called += own.get(b, 0)
            if called and 2.0**b >= tests / (ALPHA * called):
                bound = b
        found.append(bound)
    return found


def _called(length: Column, w: Column, least: list[int]) -> Column:
    bound = F.element_at(F.array(*[F.lit(float(b)) for b in least]), stratum(length) + 1)
    return w["passes"] & (w["log2e"] >= bound)


def _candidates(table: DataFrame, name: str) -> DataFrame:
    return table.select(F.explode(F.col(name)["candidates"]).alias("c")).select(
        (F.col("c.end") - F.col("c.start")).alias("length"), F.col("c.w.log2e").alias("log2e"), F.col("c.w.passes").alias("passes")
    )


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans of every row of docs."""
    scanned, name = scan(docs.select("doc_id", "text"))
    table = cut(scanned.select("doc_id", F.col(name).alias("s")), "secret-spans")
    least = bounds(_candidates(table, "s"))
    added = F.transform(
        F.filter(F.col("s.candidates"), lambda c: _called(c["end"] - c["start"], c["w"], least)),
        _labelled(3),
    )
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(F.col("s.base"), lambda x: x["kind"] == kind)).cast("bigint")
    out = table.withColumn("added", added)
    return out.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.size("added").cast("bigint").alias("n_random"),
        F.sha2(written(F.col("s.base")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat(F.col("s.base"), F.col("added")))).alias("spans"),
    )


MARK = "[secret]"


def _rebuilt(text: str, pattern: str, matches: str, keep) -> Column:
    """The text with MARK in place of the matches for which keep(i, match) doesn't hold, pieced together once."""
    shown = F.zip_with(
        F.split(text, pattern, -1),
        F.concat(F.transform(F.col(matches), keep), F.array(F.lit(""))),
        lambda p, m: F.concat(p, m),
    )
    return F.when(F.size(matches) > 0, F.array_join(shown, "")).otherwise(F.col(text))


def redact(docs: DataFrame) -> DataFrame:
    """The rows of docs with every secret found replaced by MARK, with the columns of docs; n_chars, if there is such
    a column and the text is not null, is the length of the new text."""
    scanned, name = scan(docs.select("text"))
    least = bounds(_candidates(cut(scanned.select(F.col(name).alias("s")), "secret-spans"), "s"))
    stem = fresh([c[:2] for c in docs.columns], "_s")
    t = f"{stem}_text0"
    out = docs.withColumn(t, F.coalesce("text", F.lit("")))
    steps = zip(KINDS, (ASSIGN, ACCESS, HEX, TOKEN), strict=True)
    for k, (kind, pattern) in enumerate(steps):
        m, values = f"{stem}_{kind}", f"{stem}_values"
        out = out.withColumn(m, F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
        if kind == "assign":
            out = out.withColumn(values, F.when(F.size(m) > 0, _values(t)).otherwise(F.array().cast("array<string>")))
            keep = lambda x, i: F.when(F.length(F.get(F.col(values), i)) >= ASSIGN_CHARS, MARK).otherwise(x)
        elif kind == "random":
            keep = lambda x: F.when(_called(F.length(x).cast("bigint"), weigh(x), least), MARK).otherwise(x)
        else:
            keep = lambda x: F.lit(MARK)
        out = out.withColumn(f"{stem}_text{k + 1}", _rebuilt(t, pattern, m, keep))
        t = f"{stem}_text{k + 1}"
    new = {"text": F.when(F.col("text").isNotNull(), F.col(t)).alias("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("text").isNotNull(), F.length(t)).otherwise(F.col("n_chars")).cast(kind).alias("n_chars")
    return out.select(*[new.get(c, F.col(f"`{c}`")) for c in docs.columns])


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(read(spark, sf_dir, "documents"))
