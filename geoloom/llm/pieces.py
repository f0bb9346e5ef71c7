"""SentencePiece encoding and decoding: merges by rank for models trained by merges, else the best-scoring
segmentation, with a max-plus scan over giant documents.

The vocabulary and scores come from a SentencePiece model file (a parameter). A text gets a space in front and spaces
become U+2581. Under a model trained by merges (BPE), neighbours whose union is a piece are merged, the best score
first and of equal ones the leftmost, as the tokenizer does (MergeEncoder). Under any other, of all ways to cut the
text into pieces the one with the largest sum of scores is taken, and a character of no piece costs the least score
less 10 (Encoder). A character that is left and no piece is spelled in byte pieces.

No piece crosses the border in front of a run of U+2581, so an ordinary text is cut there and the ids of its
segments are looked up, or worked out once, in each Python worker. A text over GIANT characters is dealt out in
chunks. Merges stay within segments, so their chunks end at borders of segments and are encoded by themselves (a
segment longer than a chunk is one chunk). For best sums, each chunk yields the matrix of best scores from every way a piece can reach in over its left border to every
way one can reach out over its right border. These matrices combine associatively in the max-plus semiring, in
blocks and then over blocks; once each chunk's two borders are known, it is traced back by itself.

Defined results: a null text has null ids, an empty one none; U+2581 itself is spelled in bytes, so decoding gives
back every text exactly. Rows repeated are encoded alike; giant texts that repeat are encoded once.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.tables import cut, fresh, read

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, LITERAL = "▁", "\ud800"
#: Characters over which a text is dealt out in chunks of CHUNK; matrices combine in blocks of BLOCK.
GIANT, CHUNK, BLOCK = 65_536, 16_384, 64
#: Segments remembered by a worker, and the longest of them; segments worked out at once, and characters of a slice
#: of texts that is held at once.
MEMO, MEMO_CHARS = 200_000, 48
ROWS, SLICE = 8_192, 1 << 21
#: Segments of one length from which they are merged together.
TOGETHER = 32
_PRIME = np.uint64(0x9E3779B97F4A7C15)
LOW = -(1 << 62)
#: Ways of equal sums are told apart by what stands below this bit: a hash of each piece's length and its place in
#: its segment. So a text has one best way, however it is dealt out.
SHIFT, TIES = 24, 65_521


class Vocabulary(NamedTuple):
    """weight: piece -> score in integer units, None for a mere prefix of pieces; ids by piece; unknown: a
    character's weight if no piece is that character; spelled: bytes of each id; byte: id of each byte."""

    weight: dict
    ids: dict
    unknown: int
    spelled: list
    byte: list
    longest: int
    cuts: str
    merges: bool = False
    name: str = ""


def load(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a model file, read on the driver and sent to the workers: a fixed size."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    model = sentencepiece_model_pb2.ModelProto.FromString(sp.serialized_model_proto())
    n = sp.get_piece_size()
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    scores = {i: sp.get_score(i) for i in plain}
    low = min(x for x in scores.values() if x > -1e8)
    whole = all(x == int(x) for x in scores.values())
    unit = lambda x: int(round(max(x, low - 10) * (1 if whole else 1 << 16)))
    ids = {sp.id_to_piece(i): i for i in plain}
    weight: dict = {}
    for piece in ids:
        for k in range(1, len(piece)):
            weight.setdefault(piece[:k], None)
    for piece, i in ids.items():
        weight[piece] = unit(scores[i]) << SHIFT
    byte, spelled = [0] * 256, [b""] * n
    for i in range(n):
        if sp.is_byte(i):
            value = int(sp.id_to_piece(i)[3:5], 16)
            byte[value], spelled[i] = i, bytes([value])
        elif i in scores:
            spelled[i] = sp.id_to_piece(i).replace(SPACE, " ").encode()
    inside = {c for p in ids if len(p) > 1 for c in p}
    cuts = "".join(c for c in map(chr, range(128)) if c not in inside) + LITERAL
    assert not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in ids), "a piece crosses a segment's border"
    return Vocabulary(weight, ids, unit(low - 10) << SHIFT, spelled, byte, max(map(len, ids)), cuts, model.trainer_spec.model_type == model.trainer_spec.BPE, hashlib.sha256(sp.serialized_model_proto()).hexdigest())


class Encoder:
    """A worker's state: the vocabulary, and the ids (as bytes of int32) of segments met before."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        own = re.escape(vocabulary.cuts)
        self.segments = re.compile(f"[{own}]|{SPACE}+[^{SPACE}{own}]*|[^{SPACE}{own}]+")
        self.memo: dict[str, bytes] = {}
        by: dict[int, list[str]] = {}
        for piece, w in vocabulary.weight.items():
            if w is not None:
                by.setdefault(len(piece), []).append(piece)
        #: For each length of a piece the sorted hashes of the pieces, and their weights.
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, own in by.items():
            h = _columns(own, n)
            keys = h[0]
            for k in range(1, n):
                keys = keys * _PRIME + h[k]
            if len(np.unique(keys)) < len(keys):
                raise ValueError("two pieces of one length have one hash")
            order = np.argsort(keys)
            self.tables[n] = keys[order], np.array([vocabulary.weight[p] for p in own], np.int64)[order]

    def arcs(self, text: str, i: int, origin: int = 0) -> Iterator[tuple[int, int]]:
        """(end, weight) of every piece that begins at i; the bare character, if it is no piece. origin: the place
        of text in its segment."""
        get, some, salt = self.v.weight.get, False, (origin + i) * 40_503
        for j in range(i + 1, min(len(text), i + self.v.longest) + 1):
            w = get(text[i:j], False)
            if w is False:
                break
            if w is not None:
                some = some or j == i + 1
                yield j, w + (salt + (j - i) * 30_011) * 48_271 % TIES
        if not some:
            yield i + 1, self.v.unknown

    def best(self, text: str, start: int, stop: int, origin: int = 0) -> tuple[list[int], list[int]]:
        """Best sums from start to each place up to len(text), leaving no place at or behind stop; and the place
        before each."""
        n = len(text)
        sums, back = [LOW] * (n + 1), [-1] * (n + 1)
        sums[start] = 0
        for i in range(start, stop):
            here = sums[i]
            if here != LOW:
                for j, w in self.arcs(text, i, origin):
                    if here + w > sums[j]:
                        sums[j], back[j] = here + w, i
        return sums, back

    def spell(self, text: str, back: list[int], start: int, end: int) -> bytes:
        """The ids on the way back from end to start."""
        found: list[int] = []
        while end > start:
            i = back[end]
            piece = text[i:end]
            one = self.v.ids.get(piece)
            if one is None:
                if len(piece) > 1:
                    raise LookupError(piece)
                raw = SPACE if piece == LITERAL else piece
                found.extend(self.v.byte[b] for b in reversed(raw.encode()))
            else:
                found.append(one)
            end = i
        return array("i", found[::-1]).tobytes()

    def segment(self, text: str) -> bytes:
        found = self.memo.get(text)
        if found is None:
            _, back = self.best(text, 0, len(text))
            found = self.spell(text, back, 0, len(text))
            if len(text) <= MEMO_CHARS:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[text] = found
        return found

    def learn(self, segments: list[str]) -> None:
        """Puts the ids of segments into the memo, those of one length at once."""
        by: dict[int, list[str]] = {}
        for x in segments:
            by.setdefault(len(x), []).append(x)
        for n, own in by.items():
            for at in range(0, len(own), ROWS):
                part = own[at : at + ROWS]
                for x, back in zip(part, self._backs(part, n), strict=True):
                    try:
                        self.memo[x] = self.spell(x, back, 0, n)
                    except LookupError:  # two pieces of one hash
                        self.memo[x] = self.spell(x, self.best(x, 0, n)[1], 0, n)

    def _backs(self, own: list[str], n: int) -> list[list[int]]:
        """What best() gives as the place before each, for segments of n characters: substrings are looked up by their
        hashes, and the sums of all segments grow together, place by place."""
        columns, width = _columns(own, n), min(n, self.v.longest)
        arcs, h = [], columns
        for k in range(1, width + 1):
            if k > 1:
                h = h[:-1] * _PRIME + columns[k - 1 :]
            keys, weights = self.tables.get(k, (np.zeros(1, np.uint64), np.full(1, LOW, np.int64)))
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            ties = [(i * 40_503 + k * 30_011) * 48_271 % TIES for i in range(len(h))]
            none = self.v.unknown if k == 1 else LOW
            arcs.append(np.where(keys[at] == h, weights[at] + np.array(ties, np.int64)[:, None], none))
        sums = np.zeros((n + 1, len(own)), np.int64)
        back = np.zeros((n + 1, len(own)), np.int64)
        for j in range(1, n + 1):
            sums[j] = LOW
            for k in range(min(j, width), 0, -1):
                reached = sums[j - k] + arcs[k - 1][j - k]
                better = reached > sums[j]
                sums[j][better] = reached[better]
                back[j][better] = j - k
        return back.T.tolist()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; what their segments have in common is worked out once."""
        cut = [self.segments.findall(normal(t)) if t else [] for t in texts]
        every = {x for own in cut for x in own}
        new = every - self.memo.keys()
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = every
        self.learn([x for x in new if len(x) <= MEMO_CHARS])
        memo, found = self.memo, []
        for own in cut:
            try:
                ids = b"".join([memo[x] for x in own])
            except KeyError:
                ids = b"".join(map(self.segment, own))
            found.append(np.frombuffer(ids, "<i4"))
        return found

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text of any length, in one piece."""
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.v.spelled.__getitem__, ids.tolist()))[1:].decode() if len(ids) else ""

    def reaches(self, before: str, after: str) -> list[int]:
        """How far into after a piece that begins in before can reach: the states of that border."""
        both, at = before + after, len(before)
        found = {0}
        for i in range(max(0, at - self.v.longest + 1), at):
            found.update(j - at for j, _ in self.arcs(both, i) if j > at)
        return sorted(found)

    def _parts(self, chunk: str, right: str) -> tuple[int, int]:
        """(end of the first segment, start of the last) of a chunk; equal to its length and 0 if it has no border.
        The last segment is the one that what stands right of the chunk could go on."""
        spans = [m.span() for m in self.segments.finditer(chunk + right)]
        n = len(chunk)
        first = spans[0][1]
        if first >= n:
            return n, 0
        return first, next(a for a, b in reversed(spans) if a < n)

    def transfer(self, left: str, chunk: str, right: str, origin: int) -> np.ndarray:
        """Best sums from each state of the left border (rows) to each of the right border; LOW: no way. origin:
        how far the segment at the left border has come. What only shifts all sums alike is left out."""
        n, reach = len(chunk), self.v.longest
        ins, outs = self.reaches(left, chunk[:reach]), self.reaches(chunk[-reach:], right)
        first, last = self._parts(chunk, right)
        m = np.full((len(ins), len(outs)), LOW, np.int64)
        if last == 0:
            for r, a in enumerate(ins):
                sums, _ = self.best(chunk + right, a, n, origin)
                m[r] = [sums[n + b] for b in outs]
            return m
        ways = [self.best(chunk[:first], a, first, origin)[0][first] if a <= first else LOW for a in ins]
        sums, _ = self.best(chunk[last:] + right, 0, n - last)
        for r, way in enumerate(ways):
            for c, b in enumerate(outs):
                if way > LOW and sums[n - last + b] > LOW:
                    m[r, c] = way + sums[n - last + b]
        return m

    def trace(self, chunk: str, right: str, a: int, b: int, origin: int) -> bytes:
        """The ids of the pieces that begin in a chunk, once its borders' states are known."""
        n = len(chunk)
        first, last = self._parts(chunk, right)
        if last == 0:
            _, back = self.best(chunk + right, a, n, origin)
            return self.spell(chunk + right, back, a, n + b)
        _, back = self.best(chunk[:first], a, first, origin)
        head = self.spell(chunk[:first], back, a, first)
        middle = b"".join(map(self.segment, self.segments.findall(chunk[first:last])))
        tail = chunk[last:] + right
        _, back = self.best(tail, 0, n - last)
        return head + middle + self.spell(tail, back, 0, n - last + b)

    def chunks(self, text: str, size: int) -> Iterator[tuple[str, str, str, int]]:
        """(left, chunk, right, origin) of a text's chunks, with what stands next to each and how far the segment
        at its left border has come; the last chunk takes in a short rest."""
        s, reach, at, start = normal(text), self.v.longest, 0, 0
        while at < len(s):
            end = at + size if len(s) - at - size > 2 * reach else len(s)
            # Segments from the last one's start on: a long one is looked through once for each chunk it spans.
            for m in self.segments.finditer(s, start):
                if m.end() > at:
                    start = m.start()
                    break
            yield s[max(0, at - reach) : at], s[at:end], s[end : end + reach], at - start
            at = end


class MergeEncoder(Encoder):
    """An encoder for models trained by merges: a segment's neighbours are merged by rank."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(vocabulary)
        self.ranks = {p: w for p, w in vocabulary.weight.items() if w is not None and len(p) > 1}
        #: The id of each character, and of each two pieces that make one: their key, in order, the rank and id of the whole.
        ids, self.size = vocabulary.ids, len(vocabulary.spelled)
        self.char = np.full(0x110000, -1, np.int64)
        pairs = []
        for piece, i in ids.items():
            if len(piece) == 1:
                self.char[ord(piece)] = i
            for k in range(1, len(piece)):
                left, right = ids.get(piece[:k]), ids.get(piece[k:])
                if left is not None and right is not None:
                    pairs.append((left * self.size + right, self.ranks[piece], i))
        self.pairs, self.pair_rank, self.pair_id = np.array(sorted(pairs), np.int64).reshape(-1, 3).T.copy()

    def merged(self, text: str) -> list[str]:
        """The pieces of a segment."""
        if len(text) > MEMO_CHARS:
            return self._merged_long(text)
        rank, parts = self.ranks.get, list(text)
        ranks = [rank(a + b, LOW) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            top = max(ranks)
            if top == LOW:
                break
            at = ranks.index(top)
            parts[at] += parts.pop(at + 1)
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank(parts[at] + parts[at + 1], LOW)
            if at:
                ranks[at - 1] = rank(parts[at - 1] + parts[at], LOW)
        return parts

    def _merged_long(self, text: str) -> list[str]:
        """The same with a heap: a long segment's steps do not look through all of it."""
        rank, parts, n = self.ranks.get, list(text), len(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n:
                both = parts[a] + parts[b]
                w = rank(both)
                if w is not None:
                    heapq.heappush(heap, (-w, a, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, both = heapq.heappop(heap)
            b = after[a]
            if not parts[a] or b >= n or parts[a] + parts[b] != both:
                continue
            parts[a], parts[b], after[a] = both, "", after[b]
            if after[b] < n:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [x for x in parts if x]

    def segment(self, text: str) -> bytes:
        found = self.memo.get(text)
        if found is None:
            ids: list[int] = []
            for piece in self.merged(text):
                one = self.v.ids.get(piece)
                if one is None:
                    ids.extend(self.v.byte[b] for b in (SPACE if piece == LITERAL else piece).encode())
                else:
                    ids.append(one)
            found = array("i", ids).tobytes()
            if len(text) <= MEMO_CHARS:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[text] = found
        return found

    def learn(self, segments: list[str]) -> None:
        """Segments of one length are merged together, a step of all at a time; those of few, or with characters that are no
        piece, one by one."""
        by: dict[int, list[str]] = {}
        for x in segments:
            by.setdefault(len(x), []).append(x)
        for n, own in by.items():
            if len(own) < TOGETHER:
                left = own
            else:
                ids = self.char[np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)]
                known = (ids >= 0).all(axis=1)
                left = [own[i] for i in np.flatnonzero(~known).tolist()]
                if len(self.memo) + len(own) > MEMO:
                    self.memo.clear()
                for who, found in self._together(ids[known]):
                    flat, width, told = found.astype("<i4").tobytes(), 4 * found.shape[1], np.flatnonzero(known)[who].tolist()
                    self.memo.update((own[i], flat[k * width : (k + 1) * width]) for k, i in enumerate(told))
            for x in left:
                self.segment(x)

    def _ranked(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank (LOW if there is none) and id of what two pieces make."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], LOW), self.pair_id[at]

    def _together(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of ids of one length, merged: the places and the ids of those that come to an end at each step."""
        who = np.arange(len(ids))
        if not len(self.pairs):
            yield who, ids
            return
        rank, whole = self._ranked(ids[:, :-1], ids[:, 1:])
        while len(who) and ids.shape[1] > 1:
            live = rank.max(axis=1) > LOW
            if not live.all():
                yield who[~live], ids[~live]
                who, ids, rank, whole = who[live], ids[live], rank[live], whole[live]
            row, at, n = np.arange(len(who)), rank.argmax(axis=1), ids.shape[1] - 1
            ids[row, at] = whole[row, at]
            kept = np.arange(n + 1) != at[:, None] + 1
            ids, gone = ids[kept].reshape(len(who), n), np.arange(n) != at[:, None]
            rank, whole = rank[gone].reshape(len(who), n - 1), whole[gone].reshape(len(who), n - 1)
            for pick, left in ((at > 0, at - 1), (at < n - 1, at)):
                r, c = row[pick], left[pick]
                rank[r, c], whole[r, c] = self._ranked(ids[r, c], ids[r, c + 1])
        yield who, ids

    def parts(self, text: str, size: int) -> Iterator[str]:
        """A normal text in parts that end at the first border of segments behind size characters."""
        at = 0
        for m in self.segments.finditer(text):
            if m.end() - at >= size:
                yield text[at : m.end()]
                at = m.end()
        if at < len(text):
            yield text[at:]


def _columns(own: list[str], n: int) -> np.ndarray:
    """The characters of strings of one length, as numbers from 1: one row for each place."""
    points = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.ascontiguousarray(points.reshape(-1, n).T).astype(np.uint64) + np.uint64(1)


def slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of about SLICE bytes of the text column at most, or of one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + SLICE, side="right")))
            yield batch.slice(at, to - at)
            at = to


def normal(text: str) -> str:
    return SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product, less what all its sums share, so that they stay small however long the text."""
    low = LOW // 2
    m = (np.maximum(a, low)[:, :, None] + np.maximum(b, low)[None, :, :]).max(axis=1)
    return np.where(m <= low, LOW, m - m.max())


def borders(ms: list[np.ndarray], a: int, b: int) -> list[int]:
    """States (as indices) at the borders of a run of matrices, from a before the first to b behind the last."""
    way = np.full((1, len(ms[0])), LOW, np.int64)
    way[0, a] = 0
    ways = [way]
    for m in ms:
        ways.append(times(ways[-1], m))
    at = [b]
    for way, m in zip(reversed(ways[:-1]), reversed(ms), strict=True):
        at.append(int((np.maximum(way[0], LOW // 2) + np.maximum(m[:, at[-1]], LOW // 2)).argmax()))
    return at[::-1]


_encoders: dict[str, Encoder] = {}


def worker_encoder(shared) -> Encoder:
    """This worker's encoder of a vocabulary: one, known by the model's digest."""
    key = shared.value.name
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = (MergeEncoder if shared.value.merges else Encoder)(shared.value)
    return _encoders[key]


def _matrix(row) -> np.ndarray:
    return np.frombuffer(row.m, np.int64).reshape(row.rows, -1)


def _scan(table: DataFrame) -> DataFrame:
    """key, chunk, a, b (states at its borders, as indices) of (key, chunk, rows, m)."""
    blocks = table.withColumn("block", F.floor(F.col("chunk") / BLOCK).cast("int"))

    def combine(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("chunk")
        m = reduce(times, map(_matrix, df.itertuples()))
        return pd.DataFrame({"key": [df.key.iloc[0]], "block": [df.block.iloc[0]], "rows": [len(m)], "m": [m.tobytes()]})

    def over_blocks(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("block")
        at = borders([*map(_matrix, df.itertuples())], 0, 0)
        return pd.DataFrame({"key": df.key, "block": df.block, "a": at[:-1], "b": at[1:]})

    def within(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("chunk")
        at = borders([*map(_matrix, df.itertuples())], int(df.a.iloc[0]), int(df.b.iloc[0]))
        return pd.DataFrame({"key": df.key, "chunk": df.chunk, "a": at[:-1], "b": at[1:]})

    combined = blocks.groupBy("key", "block").applyInPandas(combine, "key string, block int, rows int, m binary")
    ends = combined.groupBy("key").applyInPandas(over_blocks, "key string, block int, a int, b int")
    return blocks.join(ends, ["key", "block"]).groupBy("key", "block").applyInPandas(within, "key string, chunk int, a int, b int")


def _joined(pieces: DataFrame) -> DataFrame:
    """key, ids of (key, chunk, ids)."""
    return pieces.groupBy("key").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])).alias("ids")
    )


def _giant_merged(texts: DataFrame, shared, chunk: int) -> DataFrame:
    """_giant for models trained by merges."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = worker_encoder(shared)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, part in enumerate(e.parts(normal(text), chunk)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key]), pa.array([k], pa.int32()), pa.array([part.encode("utf-8", "surrogatepass")])],
                        names=["key", "chunk", "own"],
                    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = worker_encoder(shared)
        for batch in batches:
            own = [b.decode("utf-8", "surrogatepass") for b in batch.column(2).to_pylist()]
            found = [np.frombuffer(b"".join(map(e.segment, e.segments.findall(x))), "<i4") for x in own]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["key", "chunk", "ids"]
            )

    dealt = texts.mapInArrow(deal, "key string, chunk int, own binary").repartition("key", "chunk")
    return _joined(dealt.mapInArrow(run, "key string, chunk int, ids array<int>"))


def _giant(texts: DataFrame, shared, chunk: int) -> DataFrame:
    """key, ids of (key, text): distinct texts over GIANT characters."""
    if shared.value.merges:
        return _giant_merged(texts, shared, chunk)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = worker_encoder(shared)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, (*parts, origin) in enumerate(e.chunks(text, chunk)):
                    cols = [pa.array([p.encode("utf-8", "surrogatepass")]) for p in parts]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key]), pa.array([k], pa.int32()), *cols, pa.array([origin])],
                        names=["key", "chunk", "left", "own", "right", "origin"],
                    )

    dealt = cut(texts.mapInArrow(deal, "key string, chunk int, left binary, own binary, right binary, origin bigint"), "piece-chunks")
    text = lambda b: b.decode("utf-8", "surrogatepass")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = worker_encoder(shared)
        for batch in batches:
            found = [
                e.transfer(text(a), text(b), text(c), o)
                for a, b, c, o in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(m) for m in found], pa.int32()), pa.array([m.tobytes() for m in found])],
                names=["key", "chunk", "rows", "m"],
            )

    spread = dealt.repartition("key", "chunk")
    states = _scan(spread.mapInArrow(matrices, "key string, chunk int, rows int, m binary"))

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = worker_encoder(shared)
        for batch in batches:
            found = []
            for left, own, right, origin, a, b in zip(*(batch.column(i).to_pylist() for i in range(2, 8)), strict=True):
                left, own, right = text(left), text(own), text(right)
                ins, outs = e.reaches(left, own[: e.v.longest]), e.reaches(own[-e.v.longest :], right)
                found.append(np.frombuffer(e.trace(own, right, ins[a], outs[b], origin), "<i4"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["key", "chunk", "ids"]
            )

    pieces = dealt.join(states, ["key", "chunk"]).select("key", "chunk", "left", "own", "right", "origin", "a", "b").mapInArrow(
        traced, "key string, chunk int, ids array<int>"
    )
    return _joined(pieces)


def encode(docs: DataFrame, path: str = MODEL, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """docs (doc_id, text) with token_ids: the ids of every whole text."""
    short, long = _encoded(docs, docs.sparkSession.sparkContext.broadcast(load(path)), giant, chunk, check=False)
    return short.union(long)


def _encoded(docs: DataFrame, shared, giant: int, chunk: int, check: bool) -> tuple[DataFrame, DataFrame]:
    """The ordinary texts and the giant ones: doc_id, text, token_ids; with check, instead of the text of the ordinary ones
    whether their ids spell it."""
    own = docs.select("doc_id", "text")
    schema = "doc_id bigint, " + ("round_trip boolean" if check else "text string") + ", token_ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = worker_encoder(shared)
        for batch in slices(batches, 1):
            texts = batch.column(1).to_pylist()
            found = e.encode_all([t or "" for t in texts])
            ids = [None if t is None else x for t, x in zip(texts, found, strict=True)]
            said = pa.array([t is None or e.decode(x) == t for t, x in zip(texts, found, strict=True)]) if check else batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), said, pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "round_trip" if check else "text", "token_ids"])

    long = own.filter(F.length("text") > giant).withColumn("key", F.sha2("text", 256))
    short = own.filter(F.coalesce(F.length("text") <= giant, F.lit(True))).mapInArrow(run, schema)
    found = _giant(long.select("key", "text").dropDuplicates(["key"]), shared, chunk)
    return short, long.join(found, "key").select("doc_id", "text", F.col("ids").alias("token_ids"))


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """encoded with decoded: the text that token_ids spell."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(path))
    name = fresh(encoded.columns, "decoded")

    @F.pandas_udf("string")
    def spell(ids: pd.Series) -> pd.Series:
        e = worker_encoder(shared)
        return ids.map(lambda x: None if x is None else e.decode(x))

    return encoded.withColumn(name, spell("token_ids"))


def tokens(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, token_ids and round_trip (decoding gives the text back) of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    short, long = _encoded(docs, shared, GIANT, CHUNK, check=True)
    checked = decode(long, path).select("doc_id", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"), "token_ids")
    n = F.when(F.col("token_ids").isNotNull(), F.size("token_ids")).cast("bigint").alias("n_tokens")
    return short.union(checked).select("doc_id", n, "token_ids", "round_trip")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(read(spark, sf_dir, "documents"))
