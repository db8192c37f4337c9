"""Byte-level BPE with a rank queue over a hierarchical bitmap, and decoding.

A piece is a linked list of byte positions. For every merge rank a bucket holds the positions where that merge
is possible; three levels of 64-bit words tell which buckets have entries, and find-first-set gives the lowest
rank in constant time. Entries are never searched for: when one comes up whose position has another merge by
then, it is skipped. A piece of n bytes costs O(n log n) at most, which matters for pieces of megabytes.
Short pieces that a stretch of texts brings for the first time share one queue: a bucket then holds places in many pieces,
of which the leftmost of each piece are merged at once.

Defined cases: null text counts as empty and gives no ids; repeated rows are encoded each for itself; empty tables give
empty results; columns of the caller are carried in a struct.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing
from .common import stretches

#: Pieces of at most so many characters are remembered, and of them the last so many to twice so many; this bounds a worker's memory.
REMEMBERED_CHARS = 48
REMEMBERED = 400_000
#: Fewer new pieces than the first are merged one by one; those of about so many bytes as the second share a queue.
TOGETHER = (32, 1 << 20)
#: Places of a bucket from which on it is merged in arrays.
IN_ARRAYS = 12


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


class RankQueue:
    """The two lower levels of the bitmap, a bit for each rank and a bit for each word of 64 ranks; empty between pieces.

    The top level (a bit for each word of the second) and the buckets belong to the piece at hand.
    """

    def __init__(self, ranks: int):
        words = (ranks >> 6) + 1
        self.low = [0] * words
        self.mid = [0] * ((words >> 6) + 1)


class Encoder:
    def __init__(self, content: bytes, pattern: str):
        self.ranks = read_ranks(content)
        self.parts = parts_of(content)
        self.packed = {rank: rank.to_bytes(4, "little") for rank in self.parts}
        self.pairs = [self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]
        self.queue = RankQueue(max(self.ranks.values()) + 1)
        self.pairs_of_bytes = np.array(self.pairs, dtype=np.int64).reshape(256, 256)
        self.bytes = np.array([self.ranks.get(bytes((a,)), -1) for a in range(256)], dtype=np.int64)
        cuts = ((self.ranks.get(t[:i]), self.ranks.get(t[i:]), r) for t, r in self.ranks.items() for i in range(1, len(t)))
        cuts = np.array([(a << 32 | b, r) for a, b, r in cuts if a is not None and b is not None] or [(-1, -1)], dtype=np.int64)
        self.keys, self.merged = cuts[np.argsort(cuts[:, 0])].T.copy()
        self.pieces = regex.compile(pattern).findall
        self.known = _Known(self)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece. The queue's steps are written out here: a call for each would cost more than the step."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        rank_of, n = self.ranks.get, len(piece)
        follow = list(range(1, n + 2))  # start of the part after the one at i
        before = list(range(-1, n))
        pending = [-1] * (n + 1)  # rank of merging the part at i with the next one
        low, mid, top, buckets = self.queue.low, self.queue.mid, 0, {}
        pairs, first = self.pairs, piece[0] << 8
        for i in range(n - 1):
            second = piece[i + 1]
            rank = pairs[first | second]
            first = second << 8
            if rank < 0:
                continue
            pending[i] = rank
            if rank in buckets:
                buckets[rank].append(i)  # ascending, so a heap
            else:
                buckets[rank] = [i]
                word = rank >> 6
                low[word] |= 1 << (rank & 63)
                mid[word >> 6] |= 1 << (word & 63)
                top |= 1 << (word >> 6)
        while top:
            high = (top & -top).bit_length() - 1
            bits = mid[high]
            word = (high << 6) + (bits & -bits).bit_length() - 1
            bits = low[word]
            rank = (word << 6) + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                at = heappop(bucket)
            else:
                at = bucket[0]
                del buckets[rank]
                bits &= bits - 1
                low[word] = bits
                if not bits:
                    bits = mid[high]
                    bits &= bits - 1
                    mid[high] = bits
                    if not bits:
                        top &= top - 1
            if pending[at] != rank:
                continue
            gone = follow[at]
            pending[gone] = -1
            after = follow[at] = follow[gone]
            if after < n:
                before[after] = at
            for left in (before[at], at):
                if left < 0:
                    continue
                middle = follow[left]
                rank = rank_of(piece[left : follow[middle]]) if middle < n else None
                if rank is None:
                    pending[left] = -1
                elif rank != pending[left]:
                    pending[left] = rank
                    if rank in buckets:
                        heappush(buckets[rank], left)
                    else:
                        buckets[rank] = [left]
                        word = rank >> 6
                        low[word] |= 1 << (rank & 63)
                        mid[word >> 6] |= 1 << (word & 63)
                        top |= 1 << (word >> 6)
        out, i = [], 0
        while i < n:
            out.append(rank_of(piece[i : follow[i]]))
            i = follow[i]
        return out

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of merging parts with these ids (below 0: the end of a piece), or -1."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.merged[at], -1)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces (little-endian unsigned 32-bit integers), all in one queue.

        Pieces lie one after the other with a place before and after each that no merge crosses. In a piece the lowest rank comes first and of
        equal ones the leftmost, as in ``merge``; how merges of different pieces follow each other makes no difference.
        """
        text = b"\0" + b"\0".join(pieces) + b"\0"
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        ends = np.cumsum(sizes + 1)
        codes, n = np.frombuffer(text, dtype=np.uint8), len(text)
        parts = self.bytes[codes]
        parts[0] = parts[ends] = -1
        piece = np.repeat(np.arange(len(pieces) + 1), np.append(sizes + 1, 1))
        follow, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        pending = np.full(n, -1, dtype=np.int64)
        pending[:-1] = np.where((parts[:-1] >= 0) & (parts[1:] >= 0), self.pairs_of_bytes[codes[:-1], codes[1:]], -1)
        places = np.flatnonzero(pending >= 0)
        places = places[np.argsort(pending[places], kind="stable")]
        used, starts = np.unique(pending[places], return_index=True)
        buckets = {r: x.tolist() for r, x in zip(used.tolist(), np.split(places, starts[1:]))} if len(used) else {}
        low, mid, top = self.queue.low, self.queue.mid, 0
        for rank in buckets:
            word = rank >> 6
            low[word] |= 1 << (rank & 63)
            mid[word >> 6] |= 1 << (word & 63)
            top |= 1 << (word >> 6)
        # The same memory, for single places.
        rank_of, (parts_, piece_, follow_, before_, pending_) = self.ranks.get, map(memoryview, (parts, piece, follow, before, pending))
        while top:
            high = (top & -top).bit_length() - 1
            bits = mid[high]
            word = (high << 6) + (bits & -bits).bit_length() - 1
            bits = low[word]
            rank = (word << 6) + (bits & -bits).bit_length() - 1
            bits &= bits - 1
            low[word] = bits
            if not bits:
                bits = mid[high]
                bits &= bits - 1
                mid[high] = bits
                if not bits:
                    top &= top - 1
            bucket, new = buckets.pop(rank), []
            if len(bucket) < IN_ARRAYS:
                bucket.sort()
                last = -1
                for at in bucket:
                    if pending_[at] != rank:
                        continue
                    if piece_[at] == last:
                        new.append((rank, at))
                        continue
                    last = piece_[at]
                    gone = follow_[at]
                    after = follow_[at] = follow_[gone]
                    before_[after] = at
                    parts_[at], parts_[gone], pending_[gone] = rank, -1, -1
                    left = before_[at]
                    for first, second in ((left, at), (at, after)):
                        if parts_[first] < 0:
                            continue
                        more = rank_of(text[first : follow_[second]]) if parts_[second] >= 0 else None
                        if more is None:
                            pending_[first] = -1
                        elif more != pending_[first]:
                            pending_[first] = more
                            new.append((more, first))
            else:
                at = np.sort(np.array(bucket))
                at = at[pending[at] == rank]
                own = piece[at]
                once = np.append(True, own[1:] != own[:-1]) if len(at) else np.zeros(0, dtype=bool)
                new.extend((rank, x) for x in at[~once].tolist())
                at = at[once]
                gone = follow[at]
                after = follow[gone]
                follow[at], before[after] = after, at
                parts[at], parts[gone], pending[gone] = rank, -1, -1
                first, second = np.concatenate((before[at], at)), np.concatenate((at, after))
                more = self._ranks_of(parts[first], parts[second])
                changed = (more >= 0) & (more != pending[first])
                pending[first] = more
                new.extend(zip(more[changed].tolist(), first[changed].tolist()))
            for more, at in new:
                if more in buckets:
                    buckets[more].append(at)
                else:
                    buckets[more] = [at]
                    word = more >> 6
                    low[word] |= 1 << (more & 63)
                    mid[word >> 6] |= 1 << (word & 63)
                    top |= 1 << (word >> 6)
        left = np.flatnonzero(parts >= 0)
        ids, edges = parts[left].astype("<u4").tobytes(), (4 * np.searchsorted(left, ends)).tolist()
        return [ids[a:b] for a, b in zip([0, *edges], edges)]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.pieces(text)))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """``encode`` of each text; pieces that are new are merged together first."""
        cut = [self.pieces(t) for t in texts]
        self.known.learn(set().union(*cut))
        return [b"".join(map(self.known.__getitem__, x)) for x in cut]


class _Known(dict):
    """Ids of pieces; when full it becomes the older half, from which pieces in use come back."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = b"".join(map(self.encoder.packed.__getitem__, self.encoder.merge(piece.encode("utf-8", "surrogatepass"))))
        if len(piece) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


    def learn(self, pieces: set[str]) -> None:
        """Merge the short ones of ``pieces`` that are not remembered, as far as they may be remembered at a time."""
        encoder = self.encoder
        new = (p for p in pieces.difference(self) if len(p) <= REMEMBERED_CHARS and p not in self.older)
        new = list(islice(new, REMEMBERED))
        if len(new) < TOGETHER[0]:
            return
        if len(self) + len(new) > REMEMBERED:
            self.older = dict(self)
            self.clear()
        content = [p.encode("utf-8", "surrogatepass") for p in new]
        whole = [encoder.ranks.get(c) for c in content]
        self.update((p, encoder.packed[r]) for p, r in zip(new, whole) if r is not None)
        new, content = ([x for x, r in zip(y, whole) if r is None] for y in (new, content))
        for part in hashing.parts(content, TOGETHER[1]):
            self.update(zip(new[part], encoder.merge_many(content[part])))


_ENCODERS: dict[tuple[int, str], Encoder] = {}


@lru_cache(maxsize=1)
def parts_of(content: bytes) -> dict[int, bytes]:
    """The bytes of each id, made once per worker process."""
    return {rank: token for token, rank in read_ranks(content).items()}


def joined(ids: bytes, parts: dict[int, bytes]) -> bytes:
    """The bytes that ids (little-endian unsigned 32-bit integers) stand for."""
    return b"".join(map(parts.__getitem__, memoryview(ids).cast("I").tolist()))


def _encoder(content: bytes, pattern: str) -> Encoder:
    """One per worker process and vocabulary; what it remembers serves later tasks too."""
    key = (hash(content), pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(content, pattern)
    return _ENCODERS[key]


def encoded(
    docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", keep: list[str] | None = None, decode: bool = False
) -> DataFrame:
    """(row_, ids): the columns ``keep`` as a struct, and the ids as binary (little-endian unsigned 32-bit).

    With ``decode`` also ``decoded_``, the bytes that the ids decode to, made in the same pass.
    ``vocabulary`` is a rank file on the driver; its content (below a megabyte, whatever the corpus) is broadcast.
    """
    with open(vocabulary, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())
    keep = docs.columns if keep is None else keep
    source = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row_"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text_")
    )
    added = ["ids", "decoded_"] if decode else ["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content.value, pattern)
        for batch in batches:
            for rows in stretches(batch, "text_"):
                ids = encoder.encode_all(rows.column("text_").to_pylist())
                columns = [rows.column("row_"), pa.array(ids, pa.binary())]
                if decode:
                    columns.append(pa.array([joined(x, encoder.parts) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, ["row_", *added])

    return source.mapInArrow(run, T.StructType([source.schema["row_"], *(T.StructField(n, T.BinaryType()) for n in added)]))


def decoded(df: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """``df`` with the bytes ``decoded_`` that the ids stand for."""
    with open(vocabulary, "rb") as file:
        content = df.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = parts_of(content.value)
        for batch in batches:
            out = [None if x is None else joined(x, parts) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded_"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("decoded_", T.BinaryType())]))
