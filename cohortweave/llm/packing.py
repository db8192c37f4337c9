"""Packing documents into sequences by cutting-stock column generation.

1. Every text is tokenised once; its ids and an end id are cut into full sequences and one remainder. The pieces are written
   with their place in the writing task (chunk, rank within the length).
2. The histogram of remainder lengths (at most ``capacity - 1`` counts, whatever the corpus) goes to the driver. A
   linear program over patterns of lengths is solved by column generation: a knapsack dynamic program over the
   dual prices gives each new pattern.
3. Rounded down, patterns say for every length which ranks go where. Ranks come from the counts per chunk, so that no
   length, however frequent, is ordered in one task. Patterns that leave more than ``slack`` tokens empty, and the
   lengths that rounding leaves over, are laid end to end and cut at sequence ends, so padding stays below
   ``slack / capacity`` plus one sequence.

Defined cases: null text counts as empty (the end id alone); repeated rows are packed each for itself; an empty table
gives an empty result; columns of the caller are carried in a struct.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_measured, save


@dataclass(frozen=True)
class Plan:
    """Where the rank-th piece of a length goes; a bounded table (its size depends on the capacity alone)."""

    lengths: np.ndarray  # of each segment, ascending
    first: np.ndarray  # first rank of the segment within its length
    per: np.ndarray  # pieces of the length in each instance of the pattern
    inner: np.ndarray  # place of the first of them in the pattern
    base: np.ndarray  # sequence of the first instance, or stream position where it starts
    stride: np.ndarray  # 0: one sequence per instance, else the pattern's total length in the stream
    sequences: int  # sequences of patterns kept whole; the stream's come next
    stream: int  # tokens in the stream


def best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable pattern and its value."""
    value = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    reach = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        value[c] = value[c - 1]
        k = reach[c]
        if k:
            gains = value[c - sizes[:k]] + prices[:k]
            j = int(gains.argmax())
            if gains[j] > value[c] + 1e-12:
                value[c], choice[c] = gains[j], j
    pattern, c = np.zeros(len(sizes), dtype=np.int64), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[choice[c]] += 1
            c -= sizes[choice[c]]
    return float(value[capacity]), pattern


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 0.005, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used, fractional, at most ``gap`` above the least number of sequences.

    Revised simplex; ends when the dual bound is within ``gap`` or after ``rounds`` patterns (either gives a valid packing).
    """
    m = len(sizes)
    patterns = np.diag(capacity // sizes).astype(np.int64)
    inverse = np.diag(1.0 / np.diag(patterns))
    use = demand / np.diag(patterns)
    for _ in range(rounds):
        prices = np.maximum(inverse.sum(axis=0), 0.0)
        best, pattern = best_pattern(prices, sizes, capacity)
        if best <= 1 + 1e-9 or prices @ demand / best >= use.sum() * (1 - gap):
            break
        direction = inverse @ pattern
        positive = direction > 1e-10
        if not positive.any():
            break
        ratios = np.full(m, np.inf)
        ratios[positive] = use[positive] / direction[positive]
        out = int(ratios.argmin())
        step = ratios[out]
        use = np.maximum(use - step * direction, 0.0)
        use[out] = step
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        patterns[out] = pattern
    return patterns, use


def plan(histogram: dict[int, int], capacity: int, slack: int) -> Plan:
    """Round the patterns and lay them out."""
    sizes = np.array(sorted(histogram), dtype=np.int64)
    left = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)
    segments: list[tuple[int, int, int, int, int, int]] = []
    taken = dict.fromkeys(map(int, sizes), 0)
    sequences = stream = 0

    def lay(pattern: np.ndarray, times: int, whole: bool) -> None:
        nonlocal sequences, stream
        total, inner = int(pattern @ sizes), 0
        for j in np.flatnonzero(pattern):
            size, per = int(sizes[j]), int(pattern[j])
            segments.append((size, taken[size], per, inner, sequences if whole else stream, 0 if whole else total))
            taken[size] += per * times
            inner += size * per
        if whole:
            sequences += times
        else:
            stream += total * times

    if len(sizes):
        patterns, use = column_generation(sizes, left.astype(float), capacity)
        for p in np.argsort(-use, kind="stable"):
            pattern = patterns[p]
            used = pattern > 0
            times = int(min(np.floor(use[p] + 1e-7), (left[used] // pattern[used]).min()))
            if times > 0:
                left -= times * pattern
                lay(pattern, times, capacity - int(pattern @ sizes) <= slack)
        for j in np.flatnonzero(left):
            lay(np.eye(1, len(sizes), j, dtype=np.int64)[0], int(left[j]), False)
    segments.sort()
    table = np.array(segments, dtype=np.int64).reshape(-1, 6).T
    return Plan(*table, sequences, stream)


def place(p: Plan, lengths: np.ndarray, ranks: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of the pieces; a piece may run over the end of its sequence in the stream."""
    wide = np.int64(1) << 40
    at = np.searchsorted(p.lengths * wide + p.first, lengths * wide + ranks, side="right") - 1
    k = ranks - p.first[at]
    instance, inner = k // p.per[at], p.inner[at] + k % p.per[at] * lengths
    streamed = p.stride[at] > 0
    position = p.base[at] + instance * p.stride[at] + inner
    sequence = np.where(streamed, p.sequences + position // capacity, p.base[at] + instance)
    return sequence, np.where(streamed, position % capacity, inner)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _encoding(content: bytes, pattern: str, added: dict[str, int]) -> tiktoken.Encoding:
    ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, content.splitlines()) if t}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


PIECE = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("chunk", T.LongType()),
        T.StructField("rank", T.LongType()),
    ]
)


def pieces(docs: DataFrame, vocabulary: str, pattern: str, capacity: int, end_id: int, text: str, keep: list[str], added: dict[str, int]) -> DataFrame:
    """Documents as full pieces and one remainder; ids as little-endian unsigned 32-bit integers."""
    with open(vocabulary, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())
    source = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row_"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text_")
    )
    schema = T.StructType([source.schema["row_"], *PIECE.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, chunk = _encoding(content.value, pattern, added), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            of, out, held = [], [[] for _ in PIECE.fields], 0

            def flush():
                columns = [batch.column("row_").take(pa.array(of, pa.int64()))]
                columns += [pa.array(v, pa.binary() if f.name == "ids" else pa.int64()) for v, f in zip(out, PIECE.fields)]
                return pa.RecordBatch.from_arrays(columns, ["row_", *PIECE.names])

            for i, text_ in enumerate(batch.column("text_")):
                ids = np.append(encoding.encode_to_numpy(text_.as_py(), allowed_special="all"), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    of.append(i)
                    for column, v in zip(out, (start, len(part), len(ids), part.tobytes(), chunk, int(seen[len(part)]))):
                        column.append(v)
                    seen[len(part)] += 1
                    held += len(part)
                if held >= 1 << 21:
                    yield flush()
                    of, out, held = [], [[] for _ in PIECE.fields], 0
            if of:
                yield flush()

    return source.mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    capacity: int = 1024,
    end_id: int = 0,
    slack: int = 4,
    text: str = "text",
    keep: list[str] | None = None,
    added: dict[str, int] | None = None,
) -> DataFrame:
    """Per piece: ``keep`` (all columns by default, in ``row_``), start, length, doc_tokens, ids, ids_crc32, sequence_id, offset.

    ``added`` has the tokens that are found in texts before the pattern splits them, with their ids.
    """
    keep = docs.columns if keep is None else keep
    cut = save(pieces(docs, vocabulary, pattern, capacity, end_id, text, keep, added or {}), "pieces")
    counts = save(cut.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n")), "piece_counts")
    rows = counts.filter(F.col("length") < capacity).groupBy("length").agg(F.sum("n").alias("n")).collect()
    layout = plan({r["length"]: r["n"] for r in rows}, capacity, slack)
    shared = docs.sparkSession.sparkContext.broadcast(layout)
    earlier = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.filter(F.col("length") < capacity).select(
        "length", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    ranked = cut.join(broadcast_measured(before), ["length", "chunk"], "left").select("row_", *PIECE.names, "before")
    fields = [ranked.schema["row_"], *[PIECE[n] for n in ("start", "length", "doc_tokens", "ids")]]
    fields += [T.StructField(n, T.LongType()) for n in ("ids_crc32", "sequence_id", "offset")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        after = p.sequences + -(-p.stream // capacity)
        for batch in batches:
            if not batch.num_rows:
                continue
            start, length, chunk, rank = (np.asarray(batch.column(n)) for n in ("start", "length", "chunk", "rank"))
            full = length == capacity
            sequence, offset = after + (chunk << 36) + rank, np.zeros_like(rank)
            if not full.all():
                before_ = np.asarray(batch.column("before").fill_null(0))
                sequence[~full], offset[~full] = place(p, length[~full], (before_ + rank)[~full], capacity)
            room = capacity - offset
            cut_ = length > room
            index = np.repeat(np.arange(len(length)), 1 + cut_)
            second = np.append(False, index[1:] == index[:-1])
            ids = [x.as_py() for x in batch.column("ids")]
            ids = [ids[i][4 * int(room[i]) :] if s else ids[i][: 4 * int(room[i])] if cut_[i] else ids[i] for i, s in zip(index, second)]
            columns = [
                batch.column("row_").take(pa.array(index)),
                start[index] + np.where(second, room[index], 0),
                np.where(second, length[index] - room[index], np.minimum(length, room)[index]),
                np.asarray(batch.column("doc_tokens"))[index],
                pa.array(ids, pa.binary()),
                np.array([zlib.crc32(x) for x in ids], dtype=np.int64),
                sequence[index] + second,
                np.where(second, 0, offset[index]),
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], [f.name for f in fields])

    return ranked.mapInArrow(run, T.StructType(fields))
