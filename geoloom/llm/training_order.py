"""Training-order materialisation: a keyed permutation gives every sequence a global slot; shards of fixed stride.

Token ids are a tokenizer's; PAD and END are the two numbers above its ids, and ids take two bytes, or four where two
do not hold them. A document ends with END. The top bits of a hash of doc_id and text deal documents to buckets, of
DOCS_A_BUCKET on average; a bucket's documents, in order of that hash, are packed one behind the other into sequences of
`length` ids, of which only a bucket's last is filled up with PAD.

Sequences are numbered by bucket and by place in it, so numbers depend on the rows alone, never on files, partitions or
cores: sequences are counted by bucket, and a bucket's task numbers its own on from the sum of those before. A balanced
Feistel network over the least even number of bits that hold all numbers, walked on until it lands among them, permutes
the numbers: that is a sequence's slot. Slot s is the (s mod per_shard)-th record of shard s div per_shard, so its place
in the shard is a product, and each task gets a range of whole shards, worked out from the number of sequences. A shard
is one binary file of records of one stride and nothing else, written under another name and renamed when it is whole;
records() reads on from any slot. Texts are encoded once, and ids move compressed.

Defined results: a null text gives nothing, an empty one END; repeated rows are packed each; a null doc_id is packed like
any other and null in doc_ids; an empty table gives no sequence. The slots of n sequences are exactly 0 to n - 1.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from array import array
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.llm import pieces
from geoloom.llm.tables import NARROW_ROWS, cut, join_small, read, resolved, shared_dir

LENGTH, PER_SHARD, ROUNDS = 2_048, 4_096, 6
KEY = "order-1"
#: Documents of a bucket, on average, at most.
DOCS_A_BUCKET = 4_096
#: Sequences of a batch that a task holds at once.
HELD = 1_024
#: How hard ids are compressed where documents move, and where sequences lie and move.
FIRST, LEVEL = 1, 5
SCHEMA = "slot bigint, shard bigint, byte_offset bigint, doc_ids array<bigint>, n_tokens int, tokens binary"
#: How a row's hash, whether it has a doc_id, and that are packed.
HEAD = ">QBQ"


class Coder(NamedTuple):
    """encode: the ids of each of some texts, all below size."""

    encode: Callable[[list[str]], list[np.ndarray]]
    size: int

    @property
    def pad(self) -> int:
        return self.size

    @property
    def end(self) -> int:
        return self.size + 1

    @property
    def kind(self) -> str:
        return "<u2" if self.end < 1 << 16 else "<u4"

    def stride(self, length: int) -> int:
        return length * np.dtype(self.kind).itemsize


#: The ids of a text's UTF-8 bytes.
BYTES = Coder(lambda texts: [np.frombuffer(t.encode(), np.uint8) for t in texts], 256)

_readers: dict[str, object] = {}

#: What marks the borders of segments; it stands in no piece.
BORDER = "\x1e"
#: Segments whose ids a worker remembers, and the longest of them.
MEMO, MEMO_CHARS = 400_000, 48


class _Segments:
    """A worker's encoder: no piece of the model crosses the border in front of a run of spaces, nor one at a line's end, so
    each segment has ids of its own, which are worked out once."""

    def __init__(self, raw: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.raw, self.whole = raw, None
        model = sentencepiece_model_pb2.ModelProto.FromString(raw)
        several = [p.piece for p in model.pieces if len(p.piece) > 1 and p.type in (p.NORMAL, p.USER_DEFINED)]
        spec = model.normalizer_spec
        self.apart = (
            model.trainer_spec.model_type == model.trainer_spec.BPE
            and not (spec.precompiled_charsmap or spec.remove_extra_whitespaces) and spec.add_dummy_prefix and spec.escape_whitespaces
            and not any(p.type == p.USER_DEFINED for p in model.pieces)
            and not any(BORDER in p or pieces.SPACE in p.lstrip(pieces.SPACE) for p in several)
        )
        self.lines = not any("\n" in p for p in several)
        spec.add_dummy_prefix = False
        self.part = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.memo: dict[str, bytes] = {}

    def marked(self, text: str) -> str:
        """A text with the space that the model puts in front of it, and BORDER between its segments."""
        if not text:
            return ""
        text = (" " + text.replace(pieces.SPACE, " ")).replace(" ", BORDER + " ")
        while f" {BORDER} " in text:
            text = text.replace(f" {BORDER} ", "  ")
        return text[1:].replace("\n", f"{BORDER}\n{BORDER}") if self.lines else text[1:]

    def plain(self, text: str) -> np.ndarray:
        if self.whole is None:
            import sentencepiece

            self.whole = sentencepiece.SentencePieceProcessor(model_proto=self.raw)
        return np.array(self.whole.encode(text), np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.apart or any(BORDER in t for t in texts):
            return [self.plain(t) for t in texts]
        cut = pc.split_pattern(pa.array([self.marked(t) for t in texts], pa.large_string()), BORDER)
        found = cut.values.dictionary_encode()
        distinct, which = found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()
        own = list(map(self.memo.get, distinct))
        new = [i for i, x in enumerate(own) if x is None]
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
        for at in range(0, len(new), HELD):
            part = new[at : at + HELD]
            for i, ids in zip(part, self.part.encode([distinct[i] for i in part], num_threads=1), strict=True):
                own[i] = array("i", ids).tobytes()
                if len(distinct[i]) <= MEMO_CHARS:
                    self.memo[distinct[i]] = own[i]
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        starts, every = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(own), np.int32)
        many = sizes[which]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(many)])
        at = np.repeat(starts[which] - ends[:-1], many) + np.arange(ends[-1])
        return np.split(every[at], ends[cut.offsets.to_numpy()][1:-1])


def tokenizer(model: str = pieces.MODEL) -> Coder:
    """The coder of a SentencePiece model file: the file's bytes go to the workers, which need no path."""
    import sentencepiece

    raw = sentencepiece.SentencePieceProcessor(model_file=model).serialized_model_proto()
    name, size = hashlib.sha256(raw).hexdigest(), sentencepiece.SentencePieceProcessor(model_proto=raw).get_piece_size()

    def encode(texts: list[str]) -> list[np.ndarray]:
        if name not in _readers:
            _readers.clear()
            _readers[name] = _Segments(raw)
        return _readers[name].encode(texts) if texts else []

    return Coder(encode, size)


def _round_keys(key: str) -> list[np.uint64]:
    return [
        np.uint64(int.from_bytes(hashlib.blake2b(f"{key}:{i}".encode(), digest_size=8).digest(), "little"))
        for i in range(ROUNDS)
    ]


def _once(x: np.ndarray, half: int, keys: list[np.uint64]) -> np.ndarray:
    """One pass of the network over numbers of 2 * half bits."""
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    with np.errstate(over="ignore"):
        for k in keys:
            f = right * np.uint64(0x9E3779B97F4A7C15) + k
            f ^= f >> np.uint64(32)
            f *= np.uint64(0xD6E8FEB86659FD93)
            f ^= f >> np.uint64(29)
            left, right = right, left ^ (f & mask)
    return (left << shift) | right


def slots(numbers: np.ndarray, n: int, key: str = KEY) -> np.ndarray:
    """The slots of numbers below n: a permutation of them, by key. The domain is less than four times n, so a walk
    takes four passes at most on average."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    keys, out = _round_keys(key), numbers.astype(np.uint64)
    out = _once(out, half, keys)
    while (far := out >= n).any():
        out[far] = _once(out[far], half, keys)
    return out.astype(np.int64)


def _encoded(docs: DataFrame, coder: Coder) -> DataFrame:
    """bucket and own (its hash, its doc_id and its ids, packed) of every row with a text. own orders
    rows by hash, then doc_id, then ids."""
    bits = max(0, (max(1, docs.count()) - 1) // DOCS_A_BUCKET).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=FIRST).compress
        for batch in pieces.slices(batches, 2):
            hashes, ids = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_pylist()
            found = coder.encode(batch.column(2).to_pylist())
            own = []
            for h, i, x in zip(hashes.tolist(), ids, found, strict=True):
                if len(x) and (int(x.min()) < 0 or int(x.max()) >= coder.size):
                    raise ValueError(f"an id outside 0 to {coder.size - 1}")
                own.append(struct.pack(HEAD, h, i is not None, (i or 0) + (1 << 63)) + pack(x.astype(coder.kind).tobytes()))
            bucket = hashes >> np.uint64(64 - bits) if bits else np.zeros(len(hashes), np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket.astype(np.int64)), pa.array(own, pa.binary())], names=["bucket", "own"]
            )

    own = docs.filter(F.col("text").isNotNull()).select(F.xxhash64("doc_id", "text").alias("h"), "doc_id", "text")
    return own.mapInArrow(run, "bucket bigint, own binary").repartition("bucket")


def _packed(docs: DataFrame, length: int, coder: Coder) -> DataFrame:
    """bucket, k, doc_ids, n_tokens and tokens (compressed) of every sequence, in the shared folder."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_, unzip = zstandard.ZstdCompressor(level=LEVEL).compress, zstandard.ZstdDecompressor().decompress
        bucket, at, tail, owners = None, 0, np.empty(0, coder.kind), []
        rows: list[tuple] = []

        def out():
            columns = [*zip(*rows, strict=True)]
            rows.clear()
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["bucket", "k", "doc_ids", "n_tokens", "tokens"]
            )

        def close():
            if len(tail):
                full = np.concatenate([tail, np.full(length - len(tail), coder.pad, coder.kind)])
                rows.append((bucket, at, owners, len(tail), zip_(full.tobytes())))

        for batch in batches:
            for here, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if here != bucket:
                    close()
                    bucket, at, tail, owners = here, 0, np.empty(0, coder.kind), []
                _, some, doc_id = struct.unpack_from(HEAD, own)
                ids = np.frombuffer(unzip(own[struct.calcsize(HEAD) :]), coder.kind)
                tail = np.concatenate([tail, ids, np.array([coder.end], coder.kind)])
                owners = [*owners, doc_id - (1 << 63) if some else None]
                whole = len(tail) // length
                for i in range(whole):
                    rows.append((bucket, at, owners if i == 0 else owners[-1:], length, zip_(tail[i * length : (i + 1) * length].tobytes())))
                    at += 1
                    if len(rows) >= HELD:
                        yield out()
                if whole:
                    tail = tail[whole * length :]
                    owners = owners[-1:] if len(tail) else []
        close()
        if rows:
            yield out()

    ranged = _encoded(docs, coder).sortWithinPartitions("bucket", "own")
    return cut(ranged.mapInArrow(pack, "bucket bigint, k bigint, doc_ids array<bigint>, n_tokens int, tokens binary"), "order-packed")


def _dealt(docs: DataFrame, length: int, per_shard: int, key: str, coder: Coder) -> DataFrame:
    """SCHEMA of every sequence, tokens compressed: each partition holds the slots of a range of whole shards, in order."""
    packed = _packed(docs, length, coder)
    counts = packed.groupBy("bucket").agg(F.count("*").alias("many"))
    ahead = F.sum("many").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = cut(counts.select("bucket", F.coalesce(ahead, F.lit(0)).alias("start"), "many"), "order-starts")
    n = starts.agg(F.sum("many")).first()[0] or 0
    tasks, stride, shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), coder.stride(length), -(-n // per_shard)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = slots(batch.column(0).to_numpy(), n, key)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((where // per_shard * tasks // shards).astype(np.int32)), pa.array(where),
                    pa.array(where // per_shard), pa.array(where % per_shard * stride), *batch.columns[1:],
                ],
                names=["place", "slot", "shard", "byte_offset", *batch.schema.names[1:]],
            )

    numbered = join_small(packed, starts.drop("many"), ["bucket"], "inner", NARROW_ROWS)
    numbered = numbered.select((F.col("start") + F.col("k")).alias("number"), "doc_ids", "n_tokens", "tokens")
    found = numbered.mapInArrow(deal, f"place int, {SCHEMA}")
    return found.repartitionById(tasks, F.col("place")).sortWithinPartitions("slot").drop("place")


def _unpacked(batch: pa.RecordBatch) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [unpack(x) for x in batch.column("tokens").to_pylist()]


def order(docs: DataFrame, length: int = LENGTH, per_shard: int = PER_SHARD, key: str = KEY, coder: Coder = BYTES) -> DataFrame:
    """SCHEMA of every sequence: each partition holds the slots of a range of whole shards, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(_unpacked(batch), pa.binary())], names=batch.schema.names)

    return _dealt(docs, length, per_shard, key, coder).mapInArrow(run, SCHEMA)


def shard_file(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _written(ordered: DataFrame, path: str) -> DataFrame:
    """Writes what _dealt() gives as one binary file a shard to path, a folder that all executors share; returns its rows
    without tokens, by slot."""
    where, folder = _place(path)
    where.create_dir(folder, recursive=True)
    names = [c for c in ordered.columns if c != "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, folder = _place(path)
        shard, out, part = None, None, ""

        def close() -> None:
            if out is not None:
                out.close()
                own.move(part, f"{folder}/{shard_file(shard)}")

        for batch in batches:
            for k, tokens in zip(batch.column("shard").to_pylist(), _unpacked(batch), strict=True):
                if k != shard:
                    close()
                    shard, part = k, f"{folder}/.{shard_file(k)}.{uuid.uuid4().hex}"
                    out = own.open_output_stream(part)
                out.write(tokens)
            yield batch.select(names)
        close()

    return cut(ordered.mapInArrow(run, ordered.select(*names).schema), "order-index")


def read_tokens(index: DataFrame, path: str, stride: int) -> DataFrame:
    """SCHEMA of rows of _written: the tokens read from the shards at each byte_offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, folder = _place(path)
        shard, source = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some, tokens = batch.slice(at, 1024), []
                for k, offset in zip(some.column("shard").to_pylist(), some.column("byte_offset").to_pylist(), strict=True):
                    if k != shard:
                        if source is not None:
                            source.close()
                        shard, source = k, own.open_input_file(f"{folder}/{shard_file(k)}")
                    tokens.append(source.read_at(stride, offset))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(tokens, pa.binary())], names=[*some.schema.names, "tokens"])
        if source is not None:
            source.close()

    return index.mapInArrow(run, SCHEMA)


def records(path: str, slot: int, stride: int, per_shard: int = PER_SHARD) -> Iterator[bytes]:
    """The records of the files in path from a slot on, in order: one seek, then sequential reads. A shard that is missing
    before the last one is an error."""
    own, folder = _place(path)
    shard, skip = slot // per_shard, slot % per_shard * stride
    there = {f.base_name for f in own.get_file_info(fs.FileSelector(folder))}
    last = max((int(n[6:-4]) for n in there if n.startswith("shard-") and n.endswith(".bin")), default=-1)
    while shard <= last:
        with own.open_input_file(f"{folder}/{shard_file(shard)}") as source:
            source.seek(min(skip, source.size()))
            while raw := source.read(stride):
                yield raw
        shard, skip = shard + 1, 0


def materialise(docs: DataFrame, path: str, length: int = LENGTH, per_shard: int = PER_SHARD, key: str = KEY, model: str = pieces.MODEL) -> DataFrame:
    """Writes docs as the tokenizer's ids to shards in path; SCHEMA of every sequence, its tokens as the files have them."""
    coder, path = tokenizer(model), resolved(docs.sparkSession, path)
    ordered = _dealt(docs, length, per_shard, key, coder)
    return read_tokens(_written(ordered, path), path, coder.stride(length))


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(read(spark, sf_dir, "documents"), f"{shared_dir(spark)}/order-shards-{uuid.uuid4().hex}")
