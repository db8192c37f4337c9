"""Vector theta joins: a large side scanned once against a bounded side.

The bounded side (queries, anchors) is measured. Within a limit of rows and bytes it is
broadcast and the large side is streamed past it. Beyond the limit it is written as blocks to the
shared folder, which tasks read one after the other. Either way the large side is read once,
where it is, and not shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import measured, scratch_path

# 64 MiB of 1024-d doubles; and of anything else.
MAX_BLOCK_ROWS = 8192
MAX_BLOCK_BYTES = 64 * 1024 * 1024
ROWS_PER_SLICE = 50_000
# Cells of one unit of distance, by which the rows of cohorts that are not written are counted.
CELLS = 1024
# Entries of one rows-by-block distance matrix (32 MiB of doubles).
MAX_CELLS = 4_000_000
# Bytes of carried columns that are emitted at once.
BATCH_BYTES = 8 * 1024 * 1024
# Terms that meet all queries of a block in a matrix product.
HEAD_TERMS = 1024
# Distances are compared on this grid so that block shapes cannot change a result.
GRID = 12

Batches = Iterator[pa.RecordBatch]
Kernel = Callable[[pa.Table, pa.Schema], Callable[[Batches], Batches]]


def matrix(column) -> np.ndarray:
    """A list column as a dense matrix; ragged rows are an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    sizes = pc.unique(pc.list_value_length(column)).to_pylist()
    if len(sizes) != 1 or sizes[0] is None:
        raise ValueError(f"vector dimensions differ: {sorted(map(str, sizes))}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), sizes[0])


def unit(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(size == 0.0, 1.0, size)


def values(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return np.array(column.to_pylist(), dtype=str)
    return column.to_numpy(zero_copy_only=False)


def similarities(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    if rows.shape[1] != others.shape[1]:
        raise ValueError(f"vector dimensions differ: {rows.shape[1]} and {others.shape[1]}")
    return np.round(np.clip(rows @ others.T, -1.0, 1.0), GRID)


def pieces(batches: Batches, width: int) -> Batches:
    """The batches, sliced so that rows times ``width`` stays within one matrix."""
    step = max(1, MAX_CELLS // max(1, width))
    for rows in batches:
        for start in range(0, rows.num_rows, step):
            yield rows.slice(start, step)


def groups(keys: np.ndarray) -> Iterator[tuple[object, np.ndarray]]:
    """Key values with the row positions they occupy, in input order."""
    for key in dict.fromkeys(keys.tolist()):
        yield key, np.flatnonzero(keys == key)


def against(
    large: DataFrame,
    bounded: DataFrame,
    kernel: Kernel,
    schema: T.StructType | str,
    *,
    block_key: list[str],
    max_rows: int = MAX_BLOCK_ROWS,
    max_bytes: int = MAX_BLOCK_BYTES,
) -> DataFrame:
    """Run ``kernel(bounded rows)`` over every row of ``large``, which never moves and may be a stream.

    Above ``max_rows`` or ``max_bytes`` the bounded side is cut into blocks in the shared
    folder, and each task holds a slice of its rows against one block after the other. The kernel
    then sees a part of either side at a time, so its output must be mergeable; rows sharing
    ``block_key`` stay together.
    """
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow_out = to_arrow_schema(out)
    n, size = measured(bounded)
    if n <= max_rows and size <= max_bytes:
        shared = large.sparkSession.sparkContext.broadcast(bounded.toArrow())

        def run(batches: Batches) -> Batches:
            if shared.value.num_rows:
                yield from kernel(shared.value, arrow_out)(batches)

        return large.mapInArrow(run, out)

    n_blocks = max(1, math.ceil(n / max_rows), math.ceil(size / MAX_BLOCK_BYTES))
    path = scratch_path(bounded.sparkSession, "blocks")
    bounded.repartition(n_blocks, *block_key).write.parquet(path)

    def run_blocks(batches: Batches) -> Batches:
        store, root = shared_files(path)
        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("part-"))
        for rows in slices(batches):
            for file in files:
                block = pq.read_table(file, filesystem=store)
                if block.num_rows:
                    yield from kernel(block, arrow_out)(iter(rows))

    return large.mapInArrow(run_blocks, out)


def dealt(large: DataFrame) -> DataFrame:
    """``large`` in even parts, three for each core, where it lies in fewer: every row meets every anchor, so a table in a few files would keep
    most cores idle. One that lies in many parts, or is a stream, stays where it is."""
    if large.isStreaming:
        return large
    parts = 3 * large.sparkSession.sparkContext.defaultParallelism
    return large if large.rdd.getNumPartitions() >= parts else large.repartition(parts, "pk")


def shared_files(path: str) -> tuple[fs.FileSystem, str]:
    """The file system by which a task reaches a path of the shared folder."""
    if path.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def slices(batches: Batches) -> Iterator[list[pa.RecordBatch]]:
    """Batches in groups of at most about ROWS_PER_SLICE rows and MAX_BLOCK_BYTES."""
    held, rows, size = [], 0, 0
    for part in batches:
        held.append(part)
        rows, size = rows + part.num_rows, size + part.nbytes
        if rows >= ROWS_PER_SLICE or size >= MAX_BLOCK_BYTES:
            yield held
            held, rows, size = [], 0, 0
    if held:
        yield held


def batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)]
    arrays = [a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def nearest_rows(queries: pa.Table, schema: pa.Schema):
    """Running top ``depth`` rows per query, one small batch per task."""
    ids = values(queries["query_id"])
    depth = values(queries["depth"]).astype(int)
    targets = unit(matrix(queries["dense"]))

    def run(batches: Batches) -> Batches:
        top = RunningTop(ids, depth)
        for rows in pieces(batches, len(ids)):
            top.add(values(rows.column("pk")), similarities(unit(matrix(rows.column("dense"))), targets))
        yield from top.rows(schema)

    return run


class RunningTop:
    """The best ``depth`` rows of every query so far; ties go to the smaller key."""

    def __init__(self, ids: np.ndarray, depth: np.ndarray) -> None:
        self.ids, self.depth = ids, depth
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0))] * len(ids)
        self.floor = np.full(len(ids), -np.inf)

    def add(self, keys: np.ndarray, scores: np.ndarray, above: float = -np.inf) -> None:
        """Offer rows; scores at or below ``above`` are no hits."""
        better = (scores >= self.floor) & (scores > above)
        for j in np.flatnonzero(better.any(axis=0)):
            score, pk = self.best[j]
            new = np.flatnonzero(better[:, j])
            score = np.concatenate([score, scores[new, j]])
            pk = np.concatenate([pk, keys[new]]) if len(pk) else keys[new]
            order = np.lexsort((pk, -score))[: self.depth[j]]
            self.best[j] = (score[order], pk[order])
            if len(order) == self.depth[j]:
                self.floor[j] = score[order[-1]]

    def rows(self, schema: pa.Schema) -> Batches:
        sizes = [len(score) for score, _ in self.best]
        if sum(sizes):
            pks = np.concatenate([pk for _, pk in self.best if len(pk)])
            scores = np.concatenate([score for score, _ in self.best])
            yield batch([np.repeat(self.ids, sizes).tolist(), pks.tolist(), scores], schema)


def matching_rows(queries: pa.Table, schema: pa.Schema):
    """Running top ``depth`` rows per query by inner product of (terms, weights) vectors."""
    ids = values(queries["query_id"])
    depth = values(queries["depth"]).astype(int)
    flat = queries.select(["terms", "weights"]).combine_chunks()
    terms = pc.list_flatten(flat["terms"]).combine_chunks()
    owner = values(pc.list_parent_indices(flat["terms"]))
    weight = values(pc.list_flatten(flat["weights"]))
    vocabulary = pc.unique(terms)
    slot = values(pc.index_in(terms, value_set=vocabulary))
    by_slot = np.argsort(slot, kind="stable")
    starts = np.searchsorted(slot[by_slot], np.arange(len(vocabulary) + 1))
    # Terms of many queries are columns of a matrix, where all weights are positive integers: their sums are exact in any order.
    counts = len(weight) > 0 and bool(((weight >= 1) & (weight == np.rint(weight)) & np.isfinite(weight)).all())
    fans = np.diff(starts)
    often = np.argsort(-fans, kind="stable")[: min(HEAD_TERMS, MAX_CELLS // max(1, len(ids)))] if counts else np.zeros(0, dtype=np.int64)
    often = often[fans[often] >= max(2, len(ids) // 16)]
    column = np.full(len(vocabulary) + 1, -1)
    column[often] = np.arange(len(often))
    head = np.zeros((len(often), len(ids)))
    of = column[slot]
    np.add.at(head, (of[of >= 0], owner[of >= 0]), weight[of >= 0])

    def run(batches: Batches) -> Batches:
        top = RunningTop(ids, depth)
        for rows in pieces(batches, max(len(ids), len(often))):
            lists = rows.column("terms")
            found = pc.index_in(lists.flatten(), value_set=vocabulary)
            known = np.flatnonzero(values(found.is_valid()))
            where = values(found.fill_null(-1))[known]
            row = values(pc.list_parent_indices(lists))[known]
            w = values(rows.column("weights").flatten())[known]
            exact = counts and bool(((w >= 1) & (w == np.rint(w))).all()) and w.sum() * weight.sum() < 2.0**53
            total = np.zeros(rows.num_rows * len(ids))
            if exact and len(often):
                among = column[where] >= 0
                cells = row[among] * len(often) + column[where[among]]
                matrix_ = np.bincount(cells, w[among], rows.num_rows * len(often)).reshape(rows.num_rows, len(often))
                total = (matrix_ @ head).ravel()
                where, row, w = where[~among], row[~among], w[~among]
            count = None if exact else np.zeros(len(total), dtype=np.int64)
            # Every other matched term meets the queries that have it, a bounded number at a time.
            fan = starts[where + 1] - starts[where]
            for at in _runs(fan):
                hit = by_slot[np.repeat(starts[where[at]], fan[at]) + _ramp(fan[at])]
                cells = np.repeat(row[at], fan[at]) * len(ids) + owner[hit]
                total += np.bincount(cells, np.repeat(w[at], fan[at]) * weight[hit], len(total))
                if count is not None:
                    count += np.bincount(cells, minlength=len(count))
            met = total > 0 if count is None else count > 0
            scores = np.where(met, total, -np.inf).reshape(rows.num_rows, len(ids))
            top.add(values(rows.column("pk")), scores, above=-np.inf)
        yield from top.rows(schema)

    return run


def _runs(fan: np.ndarray) -> Iterator[slice]:
    """Consecutive slices whose fans add up to about one matrix."""
    part = np.cumsum(fan) // MAX_CELLS
    edges = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip([0, *edges], [*edges, len(fan)]):
        if hi > lo:
            yield slice(lo, hi)


def _ramp(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. for every run of the given lengths."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def _anchor_side(anchors: pa.Table):
    order = pc.sort_indices(anchors, sort_keys=[("session_id", "ascending"), ("fit_ord", "ascending")])
    anchors = anchors.take(order)
    return anchors, unit(matrix(anchors["span"])), list(groups(values(anchors["session_id"])))


def radius_rows(anchors: pa.Table, schema: pa.Schema):
    """(session, anchor, row, distance) for every row inside an anchor's radius."""
    anchors, spans, sessions = _anchor_side(anchors)
    session = values(anchors["session_id"])
    fit = values(anchors["fit_pk"])
    radius = values(anchors["radius"])

    def run(batches: Batches) -> Batches:
        for rows in pieces(batches, len(fit)):
            keys = values(rows.column("pk"))
            dist = np.maximum(0.0, 1.0 - similarities(unit(matrix(rows.column("dense"))), spans))
            r, c = np.nonzero(dist <= radius + 10.0**-GRID)
            if len(r):
                yield batch([session[c].tolist(), fit[c].tolist(), keys[r].tolist(), dist[r, c]], schema)

    return run


def closest_rows(k: int) -> Kernel:
    """Running ``k`` closest rows inside each anchor's radius, one small batch per task; ties go to the smaller key."""

    def kernel(anchors: pa.Table, schema: pa.Schema):
        anchors, spans, _ = _anchor_side(anchors)
        radius = values(anchors["radius"])
        at = np.arange(len(radius))

        def run(batches: Batches) -> Batches:
            top = RunningTop(at, np.full(len(at), k))
            for rows in pieces(batches, len(at)):
                dist = np.maximum(0.0, 1.0 - similarities(unit(matrix(rows.column("dense"))), spans))
                top.add(values(rows.column("pk")), np.where(dist <= radius + 10.0**-GRID, -dist, -np.inf), above=-np.inf)
            found = np.repeat(at, [len(score) for score, _ in top.best])
            if len(found):
                keys = np.concatenate([pk for _, pk in top.best if len(pk)])
                near = 0.0 - np.concatenate([score for score, _ in top.best])
                owner = anchors.take(pa.array(found))
                yield batch([values(owner["session_id"]).tolist(), values(owner["fit_pk"]).tolist(), keys.tolist(), near], schema)

        return run

    return kernel


def cohort_rows(anchors: pa.Table, schema: pa.Schema):
    """One row per (session, admitted row): nearest anchor and the admitting anchors."""
    anchors, spans, sessions = _anchor_side(anchors)
    fit = values(anchors["fit_pk"])
    label = values(anchors["chunk_id"])
    radius = values(anchors["radius"])

    def run(batches: Batches) -> Batches:
        for rows in pieces(batches, len(fit)):
            keys = values(rows.column("pk"))
            dist_all = np.maximum(0.0, 1.0 - similarities(unit(matrix(rows.column("dense"))), spans))
            for session, cols in sessions:
                dist = dist_all[:, cols]
                inside = dist <= radius[cols] + 10.0**-GRID
                hit = np.flatnonzero(inside.any(axis=1))
                if len(hit) == 0:
                    continue
                dist, inside = dist[hit], inside[hit]
                near = np.where(inside, dist, np.inf).argmin(axis=1)
                by_pk = np.argsort(fit[cols], kind="stable")
                r, c = np.nonzero(inside[:, by_pk])
                counts = np.bincount(r, minlength=len(hit))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                item = schema.field("qualifying_fit_pks").type.value_type
                admitted = pa.ListArray.from_arrays(
                    pa.array(offsets), pa.array(fit[cols][by_pk][c].tolist(), type=item)
                )
                yield batch(
                    [
                        [session] * len(hit),
                        keys[hit].tolist(),
                        fit[cols][near].tolist(),
                        label[cols][near].tolist(),
                        dist[np.arange(len(hit)), near],
                        radius[cols][near],
                        counts.astype(np.int32),
                        admitted,
                        np.isin(keys[hit], fit[cols]),
                    ],
                    schema,
                )

    return run


def member_rows(f: int, carried: list[str]) -> Kernel:
    """Session, distance and the ``carried`` columns of every row that at least ``f`` of its anchors admit; a row's sessions come out next to each other."""

    def kernel(anchors: pa.Table, schema: pa.Schema):
        anchors, sessions, distances = _nearest_admitted(anchors, f)
        names = np.array([session for session, _ in sessions])

        def run(batches: Batches) -> Batches:
            for rows in pieces(batches, anchors.num_rows):
                near = distances(rows)[1]
                r, s = np.nonzero(np.isfinite(near))
                step = max(1, BATCH_BYTES * rows.num_rows // max(1, rows.nbytes))
                for at in range(0, len(r), step):
                    own, of = r[at : at + step], s[at : at + step]
                    taken = pa.array(own)
                    yield batch([names[of], near[own, of], *[rows.column(c).take(taken) for c in carried]], schema)

        return run

    return kernel


def scored_rows(f: int, twice: bool = False) -> Kernel:
    """Admission, frequency gate and classifier score of every row, in one pass.

    The bounded side carries each session's classifier on its anchors. ``twice`` adds the score computed row by row, beside the one
    from the product of all rows and classifiers.
    """

    def kernel(anchors: pa.Table, schema: pa.Schema):
        anchors, sessions, distances = _nearest_admitted(anchors, f)
        names, first = np.array([session for session, _ in sessions]), np.array([cols[0] for _, cols in sessions])
        coef, intercept = matrix(anchors["coef"])[first], values(anchors["intercept"])[first]
        mean, scale = values(anchors["scaler_mean"])[first], values(anchors["scaler_scale"])[first]

        def run(batches: Batches) -> Batches:
            for rows in pieces(batches, anchors.num_rows):
                keys, near = distances(rows)
                r, s = np.nonzero(np.isfinite(near))
                if len(r):
                    d, dense = near[r, s], matrix(rows.column("dense"))
                    scaled = (d - mean[s]) / scale[s]
                    z = (dense @ coef[:, :-1].T)[r, s] + coef[s, -1] * scaled + intercept[s]
                    own = [_row_scores(dense, scaled, coef, intercept, r, s)] if twice else []
                    yield batch([names[s], keys[r], d, 1.0 / (1.0 + np.exp(-z)), *own], schema)

        return run

    return kernel


def _row_scores(dense: np.ndarray, scaled: np.ndarray, coef: np.ndarray, intercept: np.ndarray, r: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The logistic score of each row's own features, a stretch of rows at a time."""
    out = np.empty(len(r))
    step = max(1, MAX_CELLS // coef.shape[1])
    for at in range(0, len(r), step):
        part = slice(at, at + step)
        features = np.hstack([dense[r[part]], scaled[part, None]])
        out[part] = 1.0 / (1.0 + np.exp(-((features * coef[s[part]]).sum(axis=1) + intercept[s[part]])))
    return out


def _distance(similarity: np.ndarray) -> np.ndarray:
    """Distances on the grid; falls as the similarity grows."""
    return np.maximum(0.0, 1.0 - np.round(np.clip(similarity, -1.0, 1.0), GRID))


def _admitted_from(radius: np.ndarray) -> np.ndarray:
    """The smallest similarity at which each radius admits a row, to the last bit; infinite where none does."""
    inside = lambda x: _distance(x) <= radius + 10.0**-GRID
    low, high = np.full(len(radius), -1.0), np.full(len(radius), 1.0)
    always, never = inside(low), ~inside(high)
    while True:
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        good = inside(middle)
        high, low = np.where(good, middle, high), np.where(good, low, middle)
    return np.where(never, np.inf, np.where(always, -np.inf, high))


def _nearest_admitted(anchors: pa.Table, f: int):
    """The sessions, and a function that gives a batch's keys and the distance of each row to each session's nearest
    admitting anchor: infinite where fewer than ``f`` anchors admit it, or where the session's ``skip`` lists, if there are any, or anchors hold its key.

    Rows are admitted and compared by similarity, of which the distance is a falling function; only the nearest one is turned into a distance.
    """
    anchors, spans, sessions = _anchor_side(anchors)
    fit, least = values(anchors["fit_pk"]), _admitted_from(values(anchors["radius"]))[:, None]
    slot = np.repeat(np.arange(len(sessions)), [len(cols) for _, cols in sessions])
    keys_out, owner = fit, slot
    if "skip" in anchors.column_names:
        listed = pc.list_flatten(anchors["skip"])
        if len(listed):
            keys_out = np.concatenate([fit, values(listed)])
            owner = np.concatenate([slot, slot[values(pc.list_parent_indices(anchors["skip"]))]])
    order = np.argsort(keys_out, kind="stable")
    keys_out, owner = keys_out[order], owner[order]

    def distances(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        keys, own = values(rows.column("pk")), unit(matrix(rows.column("dense")))
        if rows.num_rows and own.shape[1] != spans.shape[1]:
            raise ValueError(f"vector dimensions differ: {own.shape[1]} and {spans.shape[1]}")
        best = np.empty((len(sessions), len(keys)))
        if len(keys):
            every = spans @ own.T
            for i, (_, cols) in enumerate(sessions):
                part = every[cols[0] : cols[-1] + 1]
                inside = part >= least[cols[0] : cols[-1] + 1]
                np.copyto(part, -np.inf, where=~inside)
                np.max(part, axis=0, out=best[i])
                many = inside.view(np.uint8).sum(axis=0, dtype=np.uint8 if len(cols) < 256 else np.int64)
                best[i][many < f] = -np.inf
        near = np.ascontiguousarray(np.where(best > -np.inf, _distance(best), np.inf).T)
        lo, hi = np.searchsorted(keys_out, keys, "left"), np.searchsorted(keys_out, keys, "right")
        near[np.repeat(np.arange(len(keys)), hi - lo), owner[np.repeat(lo, hi - lo) + _ramp(hi - lo)]] = np.inf
        return keys, near

    return anchors, sessions, distances


def _cells(near: np.ndarray) -> np.ndarray:
    """The cell of each distance; 2 * CELLS + 1 where there is none."""
    return np.where(np.isfinite(near), np.minimum(near * CELLS, 2.0 * CELLS), 2.0 * CELLS + 1).astype(np.int64)


def cell_rows(f: int) -> Kernel:
    """How many rows each session admits in each cell of distance, and how many of them have ``keep`` set, one batch of counters per task and block."""

    def kernel(anchors: pa.Table, schema: pa.Schema):
        anchors, sessions, distances = _nearest_admitted(anchors, f)
        width, names = 2 * CELLS + 2, np.array([session for session, _ in sessions])

        def run(batches: Batches) -> Batches:
            count, kept = np.zeros((2, len(sessions) * width), dtype=np.int64)
            for rows in pieces(batches, anchors.num_rows):
                cells = _cells(distances(rows)[1]) + np.arange(len(sessions)) * width
                count += np.bincount(cells.ravel(), minlength=len(count))
                if "keep" in rows.schema.names:
                    kept += np.bincount(cells[values(rows.column("keep"))].ravel(), minlength=len(kept))
            s, cell = np.nonzero(count.reshape(-1, width)[:, :-1])
            if len(s):
                yield batch([names[s], cell, count.reshape(-1, width)[s, cell], kept.reshape(-1, width)[s, cell]], schema)

        return run

    return kernel


def open_rows(f: int, n_bins: int, per_bin: int) -> Kernel:
    """The rows of each session's ``open`` cells, and of its other cells the first ``per_bin`` rows of every bin.

    ``bins`` are the cells in which bin 1 and the later ones begin, so a cell that is not open lies in one bin. The first rows are
    those of smallest ``seeded``, of each slice of rows. Rows of open cells come out without a bin.
    """

    def kernel(anchors: pa.Table, schema: pa.Schema):
        anchors, sessions, distances = _nearest_admitted(anchors, f)
        width, names = 2 * CELLS + 2, np.array([session for session, _ in sessions])
        listed = values(pc.list_value_length(anchors["open"]))
        code = np.full((len(sessions), width), n_bins, dtype=np.int16)  # n_bins: not wanted
        for i, (_, cols) in enumerate(sessions):
            at = int(cols[listed[cols].argmax()])  # the row that carries the session's lists
            if per_bin:
                code[i, :-1] = np.searchsorted(np.array(anchors["bins"][at].as_py()), np.arange(width - 1), "left")
            code[i, anchors["open"][at].as_py()] = -1
        code = code.ravel()

        def run(batches: Batches) -> Batches:
            for held in slices(batches):
                rows = pa.Table.from_batches(held)
                left = np.full((len(sessions), n_bins), per_bin)
                if per_bin:
                    rows = rows.take(pc.sort_indices(rows, sort_keys=[("seeded", "ascending")]))
                for part in pieces(iter(rows.combine_chunks().to_batches()), anchors.num_rows):
                    keys, near = distances(part)
                    cells = _cells(near)
                    bins = code[cells + np.arange(len(sessions)) * width]
                    bins[~np.isfinite(near)] = n_bins
                    take = bins == -1
                    for b in np.flatnonzero(left.any(axis=0)):
                        on = np.flatnonzero(left[:, b])
                        hit = bins[:, on] == b
                        take[:, on] |= hit & (np.cumsum(hit, axis=0) <= left[on, b])
                        left[on, b] = np.maximum(0, left[on, b] - hit.sum(axis=0))
                    r, s = np.nonzero(take)
                    if len(r):
                        found = bins[r, s]
                        yield batch(
                            [names[s], keys[r], near[r, s], cells[r, s], pa.array(found, pa.int32(), mask=found < 0)], schema
                        )

        return run

    return kernel


def nearest_anchors(anchors: pa.Table, schema: pa.Schema):
    """The two closest other anchors of the same session, per anchor."""
    anchors, spans, _ = _anchor_side(anchors)
    session = values(anchors["session_id"])
    fit = values(anchors["fit_pk"])
    ords = values(anchors["fit_ord"])

    def run(batches: Batches) -> Batches:
        for rows in pieces(batches, len(fit)):
            own_session, own_fit = values(rows.column("session_id")), values(rows.column("fit_pk"))
            dist = 1.0 - similarities(unit(matrix(rows.column("span"))), spans)
            other = (own_session[:, None] == session[None, :]) & (own_fit[:, None] != fit[None, :])
            dist = np.where(other, dist, np.inf)
            take = np.argsort(dist, axis=1, kind="stable")[:, :2]
            r = np.repeat(np.arange(len(own_fit)), take.shape[1])
            c = take.ravel()
            ok = np.isfinite(dist[r, c])
            r, c = r[ok], c[ok]
            yield batch(
                [own_session[r].tolist(), own_fit[r].tolist(), fit[c].tolist(), ords[c].tolist(), dist[r, c]], schema
            )

    return run


def held_out_quantiles(q: float) -> Kernel:
    """Per anchor, the quantile of nearest distances once that anchor is removed."""

    def kernel(stats: pa.Table, schema: pa.Schema):
        session, fit = values(stats["session_id"]), values(stats["fit_pk"])
        near, d1, d2 = values(stats["nearest_pk"]), values(stats["d1"]), values(stats["d2"])
        members = dict(groups(session))

        def run(batches: Batches) -> Batches:
            for rows in batches:
                out = []
                for s, f in zip(values(rows.column("session_id")).tolist(), values(rows.column("fit_pk")).tolist()):
                    at = members[s]
                    at = at[fit[at] != f]
                    rest = np.where(near[at] == f, d2[at], d1[at])
                    rest = rest[np.isfinite(rest)]
                    out.append(float(np.quantile(rest, q)) if len(rest) else None)
                if out:
                    yield batch([rows.column("session_id"), rows.column("fit_pk"), out], schema)

        return run

    return kernel


def own_distances(anchors: pa.Table, schema: pa.Schema):
    """Each held-out anchor's own chunk: the nearest other anchor whose recalibrated radius admits it."""
    spans = unit(matrix(anchors["span"]))
    session, other = values(anchors["session_id"]), values(anchors["fit_pk"])
    delta = values(anchors["delta"])

    def run(batches: Batches) -> Batches:
        for rows in pieces(batches, len(other)):
            own_session, own_fit = values(rows.column("session_id")), values(rows.column("fit_pk"))
            dist = np.maximum(0.0, 1.0 - similarities(unit(matrix(rows.column("chunk"))), spans))
            limit = values(rows.column("t_rest"))[:, None] + delta[None, :] + 10.0**-GRID
            ok = (own_session[:, None] == session[None, :]) & (own_fit[:, None] != other[None, :]) & (dist <= limit)
            best = np.where(ok, dist, np.inf).min(axis=1)
            hit = np.isfinite(best)
            yield batch([own_session[hit].tolist(), own_fit[hit].tolist(), best[hit]], schema)

    return run


def closer_rows(anchors: pa.Table, schema: pa.Schema):
    """How many rows beat each held-out anchor's own chunk, without that anchor.

    A row beats it when some other anchor of the session admits it under the
    recalibrated radius at a smaller distance (equal distances: smaller key).
    """
    anchors, spans, sessions = _anchor_side(anchors)
    fit = values(anchors["fit_pk"])
    delta, t_rest = values(anchors["delta"]), values(anchors["t_rest"])
    own = values(anchors["own_distance"])

    def run(batches: Batches) -> Batches:
        beaten = np.zeros(len(fit), dtype=np.int64)
        eps = 10.0**-GRID
        for rows in pieces(batches, len(fit)):
            keys = values(rows.column("pk"))
            dist_all = np.maximum(0.0, 1.0 - similarities(unit(matrix(rows.column("dense"))), spans))
            for _, cols in sessions:
                recovered = [i for i in cols if own[i] is not None and np.isfinite(own[i])]
                if not recovered:
                    continue
                reach = max(own[i] for i in recovered) + eps
                maybe = np.flatnonzero(dist_all[:, cols].min(axis=1) <= reach)
                dist, pk = dist_all[np.ix_(maybe, cols)], keys[maybe]
                is_anchor = np.isin(pk, fit[cols])
                for i in recovered:
                    others = cols != i
                    allowed = dist[:, others] <= t_rest[i] + delta[cols][others] + eps
                    d = dist[:, others]
                    wins = (allowed & ((d < own[i] - eps) | ((d <= own[i] + eps) & (pk < fit[i])[:, None]))).any(axis=1)
                    beaten[i] += int((wins & ~is_anchor).sum())
        yield batch([values(anchors["session_id"]).tolist(), fit.tolist(), beaten], schema)

    return run
