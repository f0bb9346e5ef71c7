"""op4: slots by a plain Feistel network, an order of the data alone, and shards that byte_offset points into."""

import hashlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from geoloom.llm import pieces, training_order
from geoloom.llm.tables import read

SF = "/root/testdata/sf0.001"
M64 = (1 << 64) - 1


def slow_slot(x, n, key):
    """One number's slot, by whole numbers of Python."""
    half = 1
    while 1 << 2 * half < n:
        half += 1
    keys = [int.from_bytes(hashlib.blake2b(f"{key}:{i}".encode(), digest_size=8).digest(), "little") for i in range(6)]
    while True:
        left, right = x >> half, x & ((1 << half) - 1)
        for k in keys:
            f = (right * 0x9E3779B97F4A7C15 + k) & M64
            f ^= f >> 32
            f = f * 0xD6E8FEB86659FD93 & M64
            f ^= f >> 29
            left, right = right, left ^ (f & ((1 << half) - 1))
        x = left << half | right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_slots(n):
    got = training_order.slots(np.arange(n), n).tolist()
    assert got == [slow_slot(i, n, training_order.KEY) for i in range(n)] and sorted(got) == list(range(n))
    assert n < 64 or got != training_order.slots(np.arange(n), n, "other").tolist()


def slow_order(df, length, key, a_bucket=4096):
    """(doc_ids, ids) by slot, of byte ids."""
    n_rows = df.count()
    rows = df.filter("text IS NOT NULL").select(F.xxhash64("doc_id", "text").alias("h"), "doc_id", "text").collect()
    bits = ((max(1, n_rows) - 1) // a_bucket).bit_length()
    every, last, tail = [], None, []

    def close():
        for k in range(0, len(tail), length):
            part = tail[k : k + length]
            owners = [d for i, (d, _) in enumerate(part) if k + i == 0 or i == 0 or tail[k + i - 1][1] == 257]
            ids = [x for _, x in part]
            every.append((owners, tuple(ids + [256] * (length - len(ids)))))

    for r in sorted(rows, key=lambda r: (r.h & M64, r.doc_id is not None, r.doc_id or 0)):
        bucket = (r.h & M64) >> (64 - bits) if bits else 0
        if bucket != last:
            close()
            last, tail = bucket, []
        tail += [(r.doc_id, x) for x in [*r.text.encode(), 257]]
    close()
    return {slow_slot(i, len(every), key): x for i, x in enumerate(every)}


def test_order_is_of_the_data_alone(spark, monkeypatch):
    docs = read(spark, SF, "documents").select("doc_id", "text")
    odd = spark.createDataFrame([(None, "null id"), (None, ""), (3, None), (4, "twice"), (4, "twice"), (5, "x" * 3000), (5, "é😀" * 700)], docs.schema)
    df = docs.limit(40).union(odd)
    monkeypatch.setattr(training_order, "DOCS_A_BUCKET", 8)
    want = slow_order(df, 256, "k", 8)
    for own in (df, df.repartition(7), df.coalesce(1).orderBy("text")):
        rows = training_order.order(own.withColumn("h", F.lit(1)).withColumn("own", F.lit(2)), length=256, per_shard=8, key="k").collect()
        assert {r.slot: (r.doc_ids, tuple(np.frombuffer(r.tokens, "<u2").tolist())) for r in rows} == want
        assert all(r.shard == r.slot // 8 and r.byte_offset == r.slot % 8 * 512 for r in rows)
        assert all(r.n_tokens == sum(x != 256 for x in want[r.slot][1]) for r in rows)
    assert training_order.order(df.limit(0)).count() == 0
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        found = []
        for size in ("128m", "64k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found.append(sorted((r.slot, r.doc_ids) for r in training_order.order(read(spark, SF, "documents")).collect()))
        assert found[0] == found[1]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_partitions_hold_whole_shards_in_order(spark):
    docs = read(spark, SF, "documents")
    parts = training_order.order(docs, length=128, per_shard=32).select(F.spark_partition_id().alias("p"), "slot", "shard").collect()
    by: dict = {}
    for r in parts:
        by.setdefault(r.p, []).append(r)
    assert len(by) > 1
    assert all([r.slot for r in own] == list(range(own[0].slot, own[0].slot + len(own))) for own in by.values())
    assert len({(r.p, r.shard) for r in parts}) == len({r.shard for r in parts})


def test_wide_ids(spark):
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    wide = training_order.Coder(lambda texts: [np.array([70_000, 0, 1]) for _ in texts], 70_001)
    (row,) = training_order.order(df, length=4, coder=wide).collect()
    assert np.frombuffer(row.tokens, "<u4").tolist() == [70_000, 0, 1, wide.end] and wide.pad == 70_001
    narrow = training_order.Coder(wide.encode, 500)
    with pytest.raises(Exception, match="outside"):
        training_order.order(df, length=4, coder=narrow).collect()


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_byte_offsets_point_into_the_files(spark, tmp_path, scheme):
    docs = read(spark, SF, "documents")
    path = tmp_path / "shards"
    rows = training_order.materialise(docs, f"{scheme}{path}", length=256, per_shard=64).collect()
    n = len(rows)
    assert sorted(r.slot for r in rows) == list(range(n)) and n > 200
    files = sorted(path.iterdir())
    assert [f.name for f in files] == [training_order.shard_file(k) for k in range(-(-n // 64))]
    assert [f.stat().st_size for f in files] == [64 * 512] * (n // 64) + ([n % 64 * 512] if n % 64 else [])
    for r in rows:
        assert r.shard == r.slot // 64 and files[r.shard].read_bytes()[r.byte_offset : r.byte_offset + 512] == bytes(r.tokens)
    by = {r.slot: bytes(r.tokens) for r in rows}
    for slot in (0, 63, 64, 100, n - 1, n):
        assert list(training_order.records(f"{scheme}{path}", slot, 512, 64)) == [by[s] for s in range(slot, n)]
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    pad, end = sp.get_piece_size(), sp.get_piece_size() + 1
    texts = {r.doc_id: r.text for r in docs.collect()}
    first: dict = {}
    for r in rows:
        for i in r.doc_ids:
            first.setdefault(i, []).append(r)
    assert first.keys() == texts.keys()
    for i, text in texts.items():
        ids = [*sp.encode(text), end]
        held = [np.frombuffer(r.tokens, "<u2").tolist() for r in first[i]]
        if len(held) == 1:
            assert any(held[0][k : k + len(ids)] == ids for k in range(len(held[0])))
    assert sum(r.n_tokens for r in rows) == sum(len(sp.encode(t)) + 1 for t in texts.values())
    assert all((np.frombuffer(r.tokens, "<u2")[r.n_tokens :] == pad).all() for r in rows)


def test_a_missing_shard_is_an_error(tmp_path):
    for k in (0, 2):
        (tmp_path / training_order.shard_file(k)).write_bytes(bytes([k]) * 64)
    (tmp_path / ".shard-00000009.bin.part").write_bytes(b"")
    assert len(list(training_order.records(str(tmp_path), 9, 16, 4))) == 3
    with pytest.raises(FileNotFoundError):
        list(training_order.records(str(tmp_path), 0, 16, 4))


def test_folders_are_those_that_spark_takes_them_for(spark, tmp_path):
    assert training_order.resolved(spark, str(tmp_path)) == f"file:{tmp_path}"
    assert training_order.resolved(spark, f"file://{tmp_path}").startswith("file:/")
