"""Removal of passages that occur earlier, by exact grouping behind a count-min filter.

1. Windows of consecutive words of all documents are counted in merged partition sketches.
2. A second pass emits only windows whose estimate says repeated (none that is repeated is lost) with a 96-bit hash of their words,
   document and start; tasks keep the first of equal windows. Buckets of hashes are brought together and grouped exactly:
   what comes out is the first place of every such window.
3. A third pass joins these places to the documents and removes the words of every window that the filter calls
   repeated and whose first place is elsewhere. So windows never have to be joined by content, and no window,
   however frequent, gathers rows.

Defined cases: no text has no words; documents shorter than a window lose nothing; rows with the same id and text are one document
(equal windows at the same place are the same window), different texts of one id and rows without an id are documents of their own (``document_keys``); a null id comes before all others; an empty table gives an empty result; columns
of the caller are carried in a struct.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing
from .common import document_keys
from .sketch import fitting, repeated, sketch

#: Code points per word, low on purpose: only the width of the sketch depends on it.
CHARS_PER_WORD = 6
#: Windows that a bucket is meant to hold.
BUCKET = 1_000_000
FLUSH = 1_500_000

ENTRY = np.dtype([("h", "<u8"), ("g", "<u4"), ("doc", "<i8"), ("sub", "<i8"), ("start", "<u4")])


def _keys(docs: DataFrame, text: str, doc_id: str) -> list:
    return [*document_keys(docs, text, doc_id), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text_")]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text_").cast(pa.binary()).to_pylist()


def _planes(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes: those that are mostly zero compress to almost nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplaned(data: bytes, n: int, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(-1, n).T).view(kind).ravel()


def _packed(e: np.ndarray) -> bytes:
    """Entries by document and place: hashes as they are, the rest as differences."""
    e = e[np.lexsort((e["start"], e["sub"], e["doc"]))]
    doc, sub = (np.diff(e[f], prepend=np.int64(0)) for f in ("doc", "sub"))
    start = np.diff(e["start"].astype(np.int32), prepend=np.int32(0))
    return e["h"].tobytes() + e["g"].tobytes() + _planes(doc) + _planes(sub) + _planes(start)


def _unpacked(data: bytes) -> list[np.ndarray]:
    n = len(data) // ENTRY.itemsize
    h, g = np.frombuffer(data, "<u8", n), np.frombuffer(data, "<u4", n, 8 * n)
    doc, sub = (np.cumsum(_unplaned(data[k * n : (k + 8) * n], n, "<i8")) for k in (12, 20))
    start = np.cumsum(_unplaned(data[28 * n :], n, "<i4"), dtype=np.int32)
    return [h, g, doc, sub, start.astype(np.uint32)]


def firsts(source: DataFrame, bits, size: int, buckets: int) -> DataFrame:
    """(id_, sub_, starts): for every window estimated repeated, its first place."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, count = bits.value, [], 0

        def flush() -> pa.RecordBatch:
            every = np.concatenate(held)
            every = every[np.lexsort((every["start"], every["sub"], every["doc"], every["g"], every["h"]))]
            every = every[np.append(True, (every["h"][1:] != every["h"][:-1]) | (every["g"][1:] != every["g"][:-1]))]
            bucket = (every["h"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            used = np.flatnonzero(np.diff(edges))
            data = [_packed(every[edges[b] : edges[b + 1]]) for b in used]
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(data, pa.binary())], ["bucket", "data"])

        for batch in batches:
            ids, subs, texts = np.asarray(batch.column("id_")), np.asarray(batch.column("sub_")), _texts(batch)
            for part in hashing.parts(texts):
                own = hashing.Texts(texts[part], size)
                h = own.windows()
                use = np.flatnonzero(repeated(rows, h))
                if not len(use):
                    continue
                at = own.at[use]
                of = own.text_of(at)
                found = np.empty(len(at), dtype=ENTRY)
                found["h"], found["g"] = h[use], own.windows(1)[use] >> np.uint64(32)
                found["doc"], found["sub"], found["start"] = ids[part][of], subs[part][of], at - own.starts[of]
                held.append(found)
                count += len(at)
                if count >= FLUSH:
                    yield flush()
                    held, count = [], 0
        if count:
            yield flush()

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def closed() -> Iterator[pa.RecordBatch]:
            h, g, doc, sub, start = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((start, sub, doc, g, h))
            h, g = h[order], g[order]
            first = order[np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]))]
            doc, sub, start = doc[first], sub[first], start[first]
            order = np.lexsort((start, sub, doc))
            doc, sub, start = doc[order], sub[order], start[order]
            edges = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1])))
            ids, subs = doc[edges], sub[edges]
            parts = [x.astype("<u4").tobytes() for x in np.split(start, edges[1:])]
            for i in range(0, len(ids), 20_000):
                columns = [pa.array(ids[i : i + 20_000]), pa.array(subs[i : i + 20_000]), pa.array(parts[i : i + 20_000], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id_", "sub_", "starts"])

        for batch in batches:
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist()):
                if bucket != current:
                    if held:
                        yield from closed()
                    current, held = bucket, []
                held.append(_unpacked(data))
        if held:
            yield from closed()

    parts = source.mapInArrow(candidates, "bucket long, data binary").repartition("bucket").sortWithinPartitions("bucket")
    return parts.mapInArrow(group, "id_ long, sub_ long, starts binary").groupBy("id_", "sub_").agg(F.collect_list("starts").alias("firsts_"))


def deduplicated(docs: DataFrame, size: int = 20, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """``row_`` (columns ``keep``, all by default), n_words, n_removed, and ``kept_``: the words left, one blank between."""
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    keys = _keys(docs, text, doc_id)
    source = docs.select(*keys)
    chars = source.agg(F.sum(F.length("text_"))).first()[0] or 0
    windows = chars // CHARS_PER_WORD

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        texts = _texts(batch)
        for part in hashing.parts(texts):
            yield hashing.Texts(texts[part], size).windows()

    bits = spark.sparkContext.broadcast(sketch(source.select("text_"), hashes, fitting(windows), "repeated"))
    places = firsts(source, bits, size, max(64, windows // BUCKET))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row_"), *keys)
    joined = rows.join(places, ["id_", "sub_"], "left").select("row_", "text_", "firsts_")
    schema = T.StructType(
        [joined.schema["row_"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_", T.StringType())]
    )

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            texts, firsts_ = _texts(batch), batch.column("firsts_").to_pylist()
            for part in hashing.parts(texts):
                own = hashing.Texts(texts[part], size)
                later = np.zeros(len(own.hashes), dtype=bool)
                later[own.at[repeated(bits.value, own.windows())]] = True
                for start, places in zip(own.starts, firsts_[part]):
                    for p in places or ():
                        later[start + np.frombuffer(p, dtype="<u4")] = False
                at = np.flatnonzero(later)
                gone = np.bincount(at, minlength=len(later) + 1) - np.bincount(at + size, minlength=len(later) + 1)
                stay = np.cumsum(gone)[: len(later)] == 0
                for words, start in zip(own.words, own.starts):
                    left = stay[start : start + len(words)]
                    n_words.append(len(words))
                    n_removed.append(len(words) - int(left.sum()))
                    kept.append(b" ".join(words if left.all() else compress(words, left.tolist())).decode("utf-8"))
            columns = [batch.column("row_"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return joined.mapInArrow(remove, schema)
