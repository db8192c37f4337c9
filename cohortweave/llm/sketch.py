"""Count-min sketches over whole tables, merged by Spark block by block.

A task turns its hashes into counters of ``DEPTH`` rows of ``width`` slots and emits the counters in use by blocks of
65,536 slots (about a byte each). Blocks are shuffled and summed in a stream, one block in memory at a time. What
comes to the driver and is broadcast has a size fixed by the width: a bit per slot (``repeated``), or a byte per slot with
the logarithm of the count (``levels``). Sketches overestimate only: what they call single is single.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .hashing import mixed

DEPTH = 2
BLOCK = 1 << 16
#: Hashes that a task gathers before it counts them (bounds its memory).
FLUSH = 3_000_000
#: The most slots of a row; beyond it sketches tell less apart and later steps do more work, with the same results.
MAX_WIDTH = 1 << 30

Hashes = Callable[[pa.RecordBatch], Iterator[np.ndarray]]


def fitting(entries: int, per_entry: float = 3.0) -> int:
    """A width for so many distinct entries, within 65,536 and MAX_WIDTH."""
    blocks = -(-int(entries * per_entry) // BLOCK)
    return BLOCK * max(1, min(blocks, MAX_WIDTH // BLOCK))


def slots(hashes: np.ndarray, width: int, row: int) -> np.ndarray:
    spread = mixed(hashes + np.uint64(0x632BE59BD9B4E019 * (row + 1) & (1 << 64) - 1))
    return ((spread >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)).astype(np.uint32)


def _encoded(positions: np.ndarray) -> bytes:
    """Ascending 16-bit positions as differences, low bytes first and then high bytes (these are mostly zero)."""
    gaps = np.diff(positions, prepend=0).astype(np.uint16)
    return (gaps & 0xFF).astype(np.uint8).tobytes() + (gaps >> 8).astype(np.uint8).tobytes()


def _decoded(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(2, -1).astype(np.int64)
    return np.cumsum(planes[0] + (planes[1] << 8))


class Counter:
    """Counters of one task: takes hashes, gives rows (block, used, often)."""

    NAMES = ("block", "used", "often")
    SCHEMA = "block long, used binary, often binary"

    def __init__(self, width: int):
        self.width, self.blocks = width, width // BLOCK
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, hashes: np.ndarray) -> Iterator[list[pa.Array]]:
        self.held.append(hashes)
        self.size += len(hashes)
        if self.size >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[list[pa.Array]]:
        if not self.size:
            return
        every = np.concatenate(self.held)
        self.held, self.size = [], 0
        for row in range(DEPTH):
            used, times = np.unique(slots(every, self.width, row), return_counts=True)
            edges = np.searchsorted(used, np.arange(self.blocks + 1, dtype=np.int64) * BLOCK)
            out: tuple[list, list, list] = ([], [], [])
            for b in np.flatnonzero(np.diff(edges)):
                part = slice(edges[b], edges[b + 1])
                inside, n = used[part].astype(np.int64) - b * BLOCK, times[part]
                often = n > 1
                out[0].append(row * self.blocks + int(b))
                out[1].append(_encoded(inside))
                out[2].append(np.flatnonzero(often).astype("<u4").tobytes() + np.minimum(n[often], 2**32 - 1).astype("<u4").tobytes())
            yield [pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())]


def sketch(source: DataFrame, hashes: Hashes, width: int, kind: str) -> np.ndarray:
    """The merged sketch of ``hashes`` of every batch of ``source``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(width)
        for batch in batches:
            for part in hashes(batch):
                for columns in counter.add(part):
                    yield pa.RecordBatch.from_arrays(columns, list(Counter.NAMES))
        for columns in counter.flush():
            yield pa.RecordBatch.from_arrays(columns, list(Counter.NAMES))

    return merged(source.mapInArrow(count, Counter.SCHEMA), width, kind)


def merged(partial: DataFrame, width: int, kind: str) -> np.ndarray:
    """Rows of the merged sketch: ``repeated`` (bits, count of at least two) or ``levels`` (bytes, log2 of the count in quarters)."""
    blocks = width // BLOCK

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, counts = None, np.zeros(BLOCK, dtype=np.uint64)

        def closed() -> pa.RecordBatch:
            if kind == "repeated":
                data = np.packbits(counts >= 2).tobytes()
            else:
                data = np.minimum(np.floor(4 * np.log2(np.maximum(counts, 1))), 254).astype(np.uint8)
                data = np.where(counts > 0, data + 1, 0).astype(np.uint8).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([data], pa.binary())], ["block", "data"])

        for batch in batches:
            for block, used, often in zip(*(batch.column(n).to_pylist() for n in Counter.NAMES)):
                if block != current:
                    if current is not None:
                        yield closed()
                    current = block
                    counts[:] = 0
                positions = _decoded(used)
                counts[positions] += np.uint64(1)
                more = np.frombuffer(often, dtype="<u4").reshape(2, -1)
                counts[positions[more[0]]] += (more[1] - 1).astype(np.uint64)
        if current is not None:
            yield closed()

    summed = partial.select(*Counter.NAMES).repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block long, data binary")
    per_block = BLOCK // 8 if kind == "repeated" else BLOCK
    rows = np.zeros((DEPTH * blocks, per_block), dtype=np.uint8)
    for block, data in summed.toLocalIterator():
        rows[block] = np.frombuffer(data, dtype=np.uint8)
    return rows.reshape(DEPTH, -1)


def repeated(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True where the estimate is two or more."""
    width = rows.shape[1] * 8
    out = np.ones(len(hashes), dtype=bool)
    for row in range(DEPTH):
        at = slots(hashes, width, row)
        out &= (rows[row][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out


def levels(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Estimated frequency classes (0: never seen)."""
    width = rows.shape[1]
    return np.minimum.reduce([rows[row][slots(hashes, width, row)] for row in range(DEPTH)])
