"""WARC fixity audit by Merkle trees: hash records and ordered offset ranges, compare roots, descend where they differ.

Records stand in order of their id. A leaf is the digest of one id's record; the ranges above it are the FANOUT
children of each node, each with its range of bytes from the node's first byte on and its digest, digested in order, up
to one root. Node n of level k covers the ids from n * FANOUT ** k on, and ranges count from their own node's start, so a
record that is lost, added or of another length changes the digests on its own path alone. Two replicas are compared
from the root down: equal digests end the descent, and only the children of nodes that differ are looked at.

Both trees are written level by level to the shared folder, each level in folders by runs of nodes (CHUNKS at most), so
the descent reads the folders below what differs and skips the others on disk; nothing below equal roots is read. A
level is grouped by parent: a group has at most FANOUT rows.

Defined results: a null field counts as empty; records of a null id stand before all others. Several records of one
id are one leaf, of their number and the sums of their digests' parts, so copies add up before the shuffle and none
are gathered. Two empty replicas agree; one empty replica lacks every record of the other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.llm.tables import NARROW_ROWS, cut, join_small, read, shared_dir

FANOUT = 64
BITS = FANOUT.bit_length() - 1
#: Folders of a level at most, and nodes of a folder at least, as powers of two.
CHUNKS, LEAST = 10, 12
#: Below every id: where records of a null id stand.
NO_ID = -(1 << 62)


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a WARC response record of a page."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def leaves(records: DataFrame) -> DataFrame:
    """node, digest, bytes, n of (id, bytes, digest): one row an id, however many records it has."""
    part = [
        F.sum(F.conv(F.substring("digest", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)").cast("decimal(38,0)"))
        for i in range(4)
    ]
    summed = F.sha2(F.concat_ws(":", F.count("*").cast("string"), *[p.cast("string") for p in part]), 256)
    return (
        records.groupBy(F.coalesce("id", F.lit(NO_ID)).alias("node"))
        .agg(
            F.when(F.count("*") == 1, F.max("digest")).otherwise(summed).alias("digest"),
            F.sum("bytes").alias("bytes"),
            F.count("*").alias("n"),
        )
    )


def tree(records: DataFrame, ids: tuple[int, int], levels: int, name: str) -> list[DataFrame]:
    """The levels of a tree, leaves first: node, digest, bytes, n, chunk."""
    own = [_laid(leaves(records), ids, 0, f"{name}-0")]
    for k in range(1, levels + 1):
        child = F.array_sort(F.collect_list(F.struct("node", "digest", "bytes")))
        zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("said"))

        def step(acc: Column, x: Column) -> Column:
            to = acc["at"] + x["bytes"]
            return F.struct(to.alias("at"), F.concat(acc["said"], F.concat_ws(":", x["node"], acc["at"], to, x["digest"]), F.lit(",")).alias("said"))

        above = own[-1].groupBy(_parent("node").alias("node")).agg(
            F.sha2(F.aggregate(child, zero, step)["said"], 256).alias("digest"), F.sum("bytes").alias("bytes"), F.sum("n").alias("n")
        )
        own.append(_laid(above, ids, k, f"{name}-{k}"))
    return own


def _shift(ids: tuple[int, int], level: int) -> int:
    """How many low bits of a level's nodes make no difference to the folder that they lie in."""
    span = (ids[1] >> BITS * level) - (ids[0] >> BITS * level) + 1
    return max(LEAST, span.bit_length() - CHUNKS)


def _laid(nodes: DataFrame, ids: tuple[int, int], level: int, name: str) -> DataFrame:
    """A level in the shared folder, in order of its nodes within folders by runs of them."""
    path = f"{shared_dir(nodes.sparkSession)}/{name}-{uuid.uuid4().hex}"
    placed = nodes.withColumn("chunk", F.shiftright("node", _shift(ids, level)))
    placed.repartition("chunk").sortWithinPartitions("chunk", "node").write.partitionBy("chunk").parquet(path)
    return nodes.sparkSession.read.schema(placed.schema).parquet(path)


def _parent(node: str) -> Column:
    """floor(node / FANOUT) in whole numbers."""
    return F.shiftright(node, BITS)


def extent(*replicas: DataFrame) -> tuple[tuple[int, int], int]:
    """The least and the largest id (0 among them), and the levels over which all ids meet in one node: two numbers of
    each replica."""
    low, high = 0, 0
    for r in replicas:
        least, most = r.agg(F.min("id"), F.max("id")).first()
        low, high = min(low, least or 0), max(high, most or 0)
    k = 0
    while (low >> (BITS * k)) != (high >> (BITS * k)) and k < 11:
        k += 1
    # Nodes of negative and of other ids meet above the last level; the root is compared as a set of nodes there.
    return (low, high), max(1, k)


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """id, status, byte_start, byte_end, n_primary, n_replica of every id at which the replicas differ.

    primary, replica: id, bytes, digest, one row a record. byte_start and byte_end are the range of the id's records
    among the primary's in order of id; for records that only the replica has, the place where they would stand.
    status: changed, missing (from the replica) or extra."""
    ids, levels = extent(primary, replica)
    ours, theirs = tree(primary, ids, levels, "fixity-a"), tree(replica, ids, levels, "fixity-b")
    # Where each node's bytes begin is summed on the way down, among the children of the nodes that differ alone.
    found = _differ(ours[levels], theirs[levels], None, 0)
    for k in range(levels - 1, -1, -1):
        path = cut(found.filter("differs"), f"fixity-path{k}")
        if path.isEmpty():
            found = path
            break
        found = _differ(ours[k], theirs[k], path, _shift(ids, k))
    return found.filter("differs").select(
        F.when(F.col("node") != NO_ID, F.col("node")).alias("id"),
        F.when(F.col("n_b") == 0, "missing").when(F.col("n_a") == 0, "extra").otherwise("changed").alias("status"),
        F.col("start").alias("byte_start"),
        (F.col("start") + F.col("bytes")).alias("byte_end"),
        F.col("n_a").alias("n_primary"),
        F.col("n_b").alias("n_replica"),
    )


def _differ(a: DataFrame, b: DataFrame, parents: DataFrame | None, shift: int) -> DataFrame:
    """node, bytes, start, n_a, n_b and differs of one level's nodes under the parents that differ (all, of the top)."""
    if parents is not None:
        # The folders below them: no more than a level has. Named here, so that the scans leave out the others.
        below = parents.select(F.shiftright("node", shift - BITS).alias("chunk")).distinct().collect()
        chunks = [r["chunk"] for r in below]
        a, b = (
            join_small(
                x.filter(F.col("chunk").isin(chunks)).withColumn("parent", _parent("node")),
                parents.select(F.col("node").alias("parent")), ["parent"], "left_semi", NARROW_ROWS,
            ).drop("parent")
            for x in (a, b)
        )
    both = a.select("node", F.col("digest").alias("x"), "bytes", F.col("n").alias("n_a")).join(
        b.select("node", F.col("digest").alias("y"), F.col("n").alias("n_b")), "node", "full"
    )
    both = both.select(
        "node",
        F.coalesce("bytes", F.lit(0)).alias("bytes"),
        F.coalesce("n_a", F.lit(0)).alias("n_a"),
        F.coalesce("n_b", F.lit(0)).alias("n_b"),
        (~F.col("x").eqNullSafe(F.col("y"))).alias("differs"),
    )
    if parents is None:
        # A few nodes.
        return both.withColumn("start", F.coalesce(F.sum("bytes").over(W.orderBy("node").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    within = W.partitionBy("parent").orderBy("node").rowsBetween(W.unboundedPreceding, -1)
    placed = both.withColumn("parent", _parent("node")).withColumn("ahead", F.coalesce(F.sum("bytes").over(within), F.lit(0)))
    return join_small(
        placed, parents.select(F.col("node").alias("parent"), F.col("start").alias("base")), ["parent"], "inner", NARROW_ROWS
    ).select("node", "bytes", (F.col("base") + F.col("ahead")).alias("start"), "n_a", "n_b", "differs")


def records_of(pages: DataFrame) -> DataFrame:
    """id, bytes, digest of every page as a WARC record."""
    own = record(F.col("page_id"), F.col("url"), F.col("html"))
    return pages.select(F.col("page_id").alias("id"), F.octet_length(own).cast("bigint").alias("bytes"), F.sha2(own, 256).alias("digest"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica for the audit to find fault with: of the pages with a number (page_id * 7919 mod 100,003) divisible by 97
    the html has lost its last character, by 89 the record is lost, by 83 its URL is upper-cased, by 79 it is there once
    more under the id that is 1,000,003 higher (beside a record that has that id already)."""
    number = F.pmod(F.col("page_id") * 7919, F.lit(100_003))
    kept = pages.filter(F.coalesce(number % 89 != 0, F.lit(True)))
    own = kept.select(
        "page_id",
        F.when(number % 83 == 0, F.upper("url")).otherwise(F.col("url")).alias("url"),
        F.when(number % 97 == 0, F.substring("html", F.lit(1), F.length("html") - 1)).otherwise(F.col("html")).alias("html"),
    )
    added = pages.filter(number % 79 == 0).select((F.col("page_id") + 1_000_003).alias("page_id"), "url", "html")
    return own.unionByName(added)


def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fault of the damaged replica of pages."""
    pages = read(spark, sf_dir, "pages")
    found = audit(records_of(pages), records_of(damaged(pages)))
    return found.withColumnRenamed("id", "page_id")


#: Records of both replicas side by side, without trees: what differs, and where the primary's bytes lie.
OP1_SQL = """
WITH numbered AS (SELECT page_id, url, html, page_id * 7919 % 100003 AS number FROM pages),
replica AS (
  SELECT page_id, CASE WHEN number % 83 = 0 THEN upper(url) ELSE url END AS url, CASE WHEN number % 97 = 0 THEN substr(html, 1, length(html) - 1) ELSE html END AS html
  FROM numbered WHERE number % 89 <> 0
  UNION ALL SELECT page_id + 1000003, url, html FROM numbered WHERE number % 79 = 0
), records AS (
  SELECT *, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: '
    || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM (SELECT page_id, url, html, true AS ours FROM pages UNION ALL SELECT page_id, url, html, false FROM replica)
), ids AS (
  SELECT page_id, count(*) FILTER (ours) AS n_primary, count(*) FILTER (NOT ours) AS n_replica, coalesce(sum(strlen(record)) FILTER (ours), 0) AS bytes,
         list_sort(list(record) FILTER (ours)) AS a, list_sort(list(record) FILTER (NOT ours)) AS b
  FROM records GROUP BY page_id
), placed AS (SELECT *, sum(bytes) OVER (ORDER BY page_id) - bytes AS start FROM ids)
SELECT page_id, CASE WHEN n_replica = 0 THEN 'missing' WHEN n_primary = 0 THEN 'extra' ELSE 'changed' END AS status,
       CAST(start AS BIGINT) AS byte_start, CAST(start + bytes AS BIGINT) AS byte_end, n_primary, n_replica
FROM placed WHERE a IS DISTINCT FROM b
"""
