"""URL filters: host-suffix and path-prefix expressions, joined to rules on short hash prefixes.

A URL's host is what stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; its path goes
on from there up to `?`, `#` or the end. A rule fits its host and all subdomains if the path starts with the
rule's path. Among the rules that fit, the longest host wins, then the longest path, then block over allow.

Defined results: a null URL, or one without `://`, has an empty host and path, which no rule fits; a URL that no
rule fits gets the default verdict. Rows are judged alike however often they occur. Rules with a null or empty
host, or a null path, fit nothing; rules repeated with unlike verdicts block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.tables import join_small, read

#: The rules of the query: (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Hex digits of the digest that are joined on; the full digest decides.
SHORT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules given as literals."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path), both empty for a null URL or one without a scheme."""
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    some = F.instr(url, "://") > 0
    return (
        F.when(some, F.translate(host, UPPER, LOWER)).otherwise(F.lit("")),
        F.when(some, path).otherwise(F.lit("")),
    )


def _suffixes(host: Column) -> Column:
    """The host and every suffix of it that begins at a label."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *parts), 256)


def _met(left: DataFrame, right: DataFrame) -> DataFrame:
    """left (l_digest) joined to right (r_digest) on the digests' first digits, then confirmed by all of them."""
    short = lambda d: F.substring(d, 1, SHORT).alias("short")
    both = join_small(left.withColumn("short", short("l_digest")), right.withColumn("short", short("r_digest")), ["short"], "inner")
    return both.filter(F.col("l_digest") == F.col("r_digest")).drop("short", "l_digest", "r_digest")


def judge(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """hosts (distinct host, path) with rule and verdict, where a rule fits.

    Host suffixes meet the rules' hosts first; only those that some rule has are expanded by path prefixes, and only to
    the lengths that this host's rules have. So no row multiplies with the number of rules or with what other hosts'
    paths look like. The best rule is kept by an aggregation that combines before the shuffle."""
    known = (
        rules.filter((F.col("host") != "") & F.col("path").isNotNull())
        .select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), "verdict")
        .groupBy("r_host", "r_path")
        .agg(F.max(F.col("verdict") == "block").alias("r_block"))
    )
    # As many lengths a host as its rules' paths have: no more than a path has characters.
    lengths = known.groupBy("r_host").agg(F.collect_set(F.length("r_path")).alias("lengths")).select("lengths", _digest(F.col("r_host")).alias("r_digest"))
    suffixes = hosts.select("host", "path", F.explode(_suffixes(F.col("host"))).alias("suffix")).withColumn("l_digest", _digest(F.col("suffix")))
    fits = F.filter("lengths", lambda n: n <= F.length("path"))
    prefixes = _met(suffixes, lengths).select("host", "path", "suffix", F.explode(fits).alias("n"))
    prefixes = prefixes.select("host", "path", _digest(F.col("suffix"), F.substring(F.col("path"), F.lit(1), F.col("n"))).alias("l_digest"))
    met = _met(prefixes, known.withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path"))))
    rank = F.struct(
        F.length("r_host").alias("n_host"), F.length("r_path").alias("n_path"), "r_block", F.concat("r_host", "r_path").alias("rule")
    )
    best = met.groupBy("host", "path").agg(F.max(rank).alias("best"))
    return best.select("host", "path", F.col("best.rule").alias("rule"), F.when(F.col("best.r_block"), "block").otherwise("allow").alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages.

    Each distinct (host, path) is judged once, so a hot host costs no more than any other, and the verdicts
    go back to the rows by a join that AQE may split where one URL holds many rows."""
    host, path = split_url(F.col(url))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    verdicts = judge(rows.select("host", "path").filter("host != ''").distinct(), rules)
    return rows.join(verdicts, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), rule_table(spark))


OP10_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut
), rules(r_host, r_path, r_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fits AS (
  SELECT page_id, host, path, r_host || r_path AS rule, r_verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(r_host) DESC, length(r_path) DESC) AS nth
  FROM parts JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.r_verdict, 'allow') AS verdict
FROM parts p LEFT JOIN (SELECT * FROM fits WHERE nth = 1) f ON p.page_id = f.page_id
"""
