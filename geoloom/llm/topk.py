"""Exact top-k by inner product: exhaustive term-at-a-time accumulation over blocks of rows.

A block of rows is inverted: each component (term) has a posting list of the rows that are not zero there, with their
weights; a list that most rows stand in is kept whole, zeros included, and added without scattering. A block's queries
are sparse rows of (term, weight). Term by term, their weights times the postings' weights are scattered into dense
arrays of scores, one a query and row. Of each array the k best are partitioned out; a query's bests of all blocks are
ranked at the end, of which Spark keeps k before the shuffle and k after.

Arithmetic is exact: scores are summed in floats while a bound on them is below their whole numbers' range, and in
Python's whole numbers beyond it.

Defined results: a vector that is null or holds a null or non-finite component takes no part; a shorter vector is zero
beyond its end, an empty one scores 0 with all; rows repeated are rows of their own (a query leaves out itself alone,
not its copies); a null vec_id is no query, and stands last among ties; equal ties (same score and vec_id) stand in the
order of the table; scores beyond a long stand at its ends; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geoloom.llm import vectors
from geoloom.llm.tables import cut, read

SCALE, EVERY, K = 64, 20, 20
#: Scores held at once by a task.
SCORES = 1 << 20
#: Share of a block's rows from which on a posting list is kept whole.
DENSE = 0.5
_POSTINGS = pa.struct([("rows", pa.list_(pa.int32())), ("weights", pa.list_(pa.float64()))])
_BLOCK = pa.schema([("block", pa.int64()), ("rids", pa.list_(pa.int64())), ("vec_ids", pa.list_(pa.int64())), ("postings", pa.list_(_POSTINGS))])
BLOCK = "block bigint, rids array<bigint>, vec_ids array<bigint>, postings array<struct<rows: array<int>, weights: array<double>>>"
FOUND = "query_rid bigint, query_id bigint, rid bigint, vec_id bigint, score bigint"
_FOUND = pa.schema([(c.split()[0], pa.int64()) for c in FOUND.split(", ")])


def _inverted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A block: its rows in order of vec_id, null last, and each term's posting list."""
    table = pa.Table.from_batches([batch]).sort_by([("vec_id", "ascending"), ("rid", "ascending")]).combine_chunks()
    rids, ids = table.column("rid").chunk(0), table.column("vec_id").chunk(0)
    v = vectors.matrix(table.column("q").chunk(0))
    postings = []
    for weights in v.T:
        rows = np.flatnonzero(weights)
        whole = len(rows) > DENSE * len(weights)
        postings.append({"rows": np.empty(0, np.int32) if whole else rows.astype(np.int32), "weights": weights if whole else weights[rows]})
    yield pa.RecordBatch.from_arrays(
        [pa.array([rids[0].as_py()]), vectors.one_list(rids), vectors.one_list(ids), pa.array([postings], pa.list_(_POSTINGS))],
        schema=_BLOCK,
    )


def accumulated(asked: np.ndarray, postings: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Scores of each query (a row of asked) and each of n rows. postings: of each term the rows (none: all) and weights."""
    terms = min(asked.shape[1], len(postings))
    most = sum(np.abs(asked[:, t]).max(initial=0) * np.abs(postings[t][1]).max(initial=0) for t in range(terms))
    kind = vectors.exact_kind(most)
    weights = vectors.typed(asked, kind)
    scores = np.zeros((len(asked), n), kind)
    for t in range(terms):
        rows, w = postings[t]
        having = np.flatnonzero(asked[:, t])
        if not len(having) or not len(w):
            continue
        w = vectors.typed(w, kind)
        if len(rows):
            scores[np.ix_(having, rows)] += np.multiply.outer(weights[having, t], w)
        elif len(having) == len(asked):
            scores += np.multiply.outer(weights[:, t], w)
        else:
            scores[having] += np.multiply.outer(weights[having, t], w)
    return scores


def best(scores: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k highest scores but own's (-1: none), the first places among ties."""
    places = np.arange(len(scores)) if own < 0 else np.delete(np.arange(len(scores)), own)
    s = scores[places]
    if len(s) > k:
        least = np.partition(s, len(s) - k)[len(s) - k]
        above = np.flatnonzero(s > least)
        s_at = np.concatenate([above, np.flatnonzero(s == least)[: k - len(above)]])
        places = places[s_at]
    return places


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rids, ids = batch.column("rids")[i].values, batch.column("vec_ids")[i].values
                postings, n = batch.column("postings")[i].values, len(rids)
                lists = [(p["rows"].values.to_numpy(), p["weights"].values.to_numpy()) for p in postings]
                asked = batch.column("asked")[i].values
                asked_rids, asked_ids, v = asked.field("rid").to_numpy(), asked.field("vec_id"), vectors.matrix(asked.field("q"))
                order = np.argsort(rids.to_numpy())
                at = np.searchsorted(rids.to_numpy(), asked_rids, sorter=order)
                at = order[np.minimum(at, n - 1)]
                own = np.where(rids.to_numpy()[at] == asked_rids, at, -1)
                step = max(1, SCORES // n)
                for low in range(0, len(v), step):
                    scores = accumulated(v[low : low + step], lists, n)
                    places = [best(s, o, k) for s, o in zip(scores, own[low : low + step], strict=True)]
                    which = np.repeat(np.arange(low, low + len(places)), [len(p) for p in places])
                    rows = np.concatenate(places) if places else np.empty(0, int)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(asked_rids[which]), asked_ids.take(pa.array(which)), rids.take(pa.array(rows)), ids.take(pa.array(rows)), vectors.longs(scores[which - low, rows])],
                        schema=_FOUND,
                    )

    return run


def top(rows: DataFrame, queries: DataFrame, k: int = K, block: int = vectors.BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: of each query (rid, vec_id, q) the k best rows (rid, vec_id, q) but itself."""
    blocks = cut(vectors.packed(rows.select("rid", "vec_id", "q"), _inverted, BLOCK, block), "topk-blocks")
    found = vectors.met(blocks, queries, ["rid", "vec_id", "q"], _searched(k), FOUND)
    order = W.partitionBy("query_rid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def search(table: DataFrame, every: int = EVERY, scale: int = SCALE, k: int = K, block: int = vectors.BLOCK) -> DataFrame:
    """Top k of all rows of table (vec_id, embedding) for each row whose vec_id is divisible by every."""
    whole = table.select("vec_id", vectors.whole(F.col("embedding"), scale).alias("q")).filter("q IS NOT NULL")
    rows = vectors.numbered(whole, "topk-rows")
    return top(rows, rows.filter(F.col("vec_id") % every == 0), k, block)


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH rows AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
scored AS (SELECT a.rid AS a, a.vec_id AS query_id, b.rid AS b, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM rows a JOIN rows b ON a.vec_id % 20 = 0 AND a.rid <> b.rid),
ranked AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id ASC NULLS LAST, b) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
