"""Balanced logistic regression for many sessions, on all labelled rows, with repeated stratified folds.

Folds are drawn on keys alone; every row then carries the list of its folds, so vectors move once whatever the number of
repeats. A session of up to ``ApplyParams.local_rows`` labelled rows is fitted inside one task, all its classifiers from one matrix.
Larger ones take distributed Newton steps: tasks sum gradients and Hessians of their rows for every classifier at once, the
sums are added up in bands of rows, solved per classifier, and only weights come back. Both ways solve the same
problem to the same tolerance, so the limit changes where the work happens, not the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.text import seeded_order
from ..params import ApplyParams
from ..session import broadcast_if_small, cut
from .blocks import matrix
from .ordering import prefix

SID = "session_id"
TOLERANCE, MAX_STEPS = 1e-10, 100
#: Weights that are broadcast at once; with more large sessions, some wait.
WAVE_BYTES = 64 * 1024 * 1024
#: Rows of a Hessian that are summed as one value.
BAND = 64


def kfold_assign(frame: DataFrame, n_splits: int, n_repeats: int, seed: int) -> DataFrame:
    """Each row once per repeat, with the fold that holds it out (stratified by label)."""
    runs = frame.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n_repeats))))
    order = [seeded_order(seed, F.col("rep"), F.col("pk")).asc(), F.col("pk").asc()]
    placed = prefix(runs, [SID, "rep", "label"], order, rank="_place")
    return placed.withColumn("fold", ((F.col("_place") - 1) % n_splits).cast("int")).drop("_place")


def with_folds(frame: DataFrame, p: ApplyParams) -> DataFrame:
    """``frame`` with ``folds``: the fold of each repeat. Rows alike in session, key and label share their folds."""
    keys = [SID, "pk", "label"]
    assigned = kfold_assign(frame.select(*keys).distinct(), p.n_splits, p.n_repeats, p.seed)
    per = assigned.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rep", "fold"))).alias("f"))
    return frame.join(broadcast_if_small(per.select(*keys, F.transform("f", lambda x: x.fold).alias("folds"))), keys)


def train(frame: DataFrame, p: ApplyParams = ApplyParams()) -> DataFrame:
    """One classifier per session on all its labelled rows: (session_id, coef, intercept, n_train, n_keep, n_drop)."""
    sizes = frame.groupBy(SID).agg(F.count("*").alias("_n"), F.countDistinct("label").alias("_classes"))
    checked = frame.join(broadcast_if_small(sizes), SID).withColumn(
        "label",
        F.when(F.col("_classes") == 2, F.col("label")).otherwise(
            F.raise_error(F.lit("training needs both KEEP and DROP rows")).cast("int")
        ),
    )
    rows = checked.select(SID, "pk", "label", "features", F.array(F.lit(0)).alias("folds"))
    return _fitted(rows, [(1, -1)], p).select(
        SID, "coef", "intercept", "n_train", "n_keep", (F.col("n_train") - F.col("n_keep")).alias("n_drop")
    )


def kfold_models(folded: DataFrame, p: ApplyParams = ApplyParams()) -> DataFrame:
    """A classifier for each fold of each repeat, fitted to the other folds: (session_id, rep, fold, coef, intercept, n_train, n_keep).

    ``folded`` is a frame ``with_folds``. Folds whose training part has one class only are left out.
    """
    return _fitted(folded, [(r, k) for r in range(1, p.n_repeats + 1) for k in range(p.n_splits)], p)


def kfold_pool(frame: DataFrame, p: ApplyParams = ApplyParams()) -> DataFrame:
    """Held-out predictions: (session_id, rep, fold, pk, label, p_keep), every labelled row once per repeat."""
    folded = cut(with_folds(frame.select(SID, "pk", "label", "features"), p))
    return scored_folds(folded, cut(kfold_models(folded, p)))


def scored_folds(folded: DataFrame, models: DataFrame) -> DataFrame:
    """Every row under the classifiers of its folds; the classifiers of a session are one value, so rows are not copied to meet them."""
    per = models.groupBy(SID).agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.struct("rep", "fold"), F.struct(F.col("coef"), F.col("intercept"))))
        ).alias("models")
    )
    met = folded.join(broadcast_if_small(cut(per)), SID).select(
        SID, "pk", "label", "features", "models", F.posexplode("folds").alias("at", "fold")
    )
    model = F.try_element_at("models", F.struct((F.col("at") + 1).alias("rep"), F.col("fold").alias("fold")))
    found = met.select(SID, (F.col("at") + 1).cast("int").alias("rep"), "fold", "pk", "label", "features", model.alias("m")).where("m IS NOT NULL")
    return found.select(
        SID, "rep", "fold", "pk", "label", vectors.logistic(F.col("features"), F.col("m.coef"), F.col("m.intercept")).alias("p_keep")
    )


def _shares(y: np.ndarray) -> tuple[float, float]:
    """Weights of rows of class 1 and of class 0 by which both classes count alike."""
    n, keep = len(y), y.sum()
    return n / (2.0 * max(1, keep)), n / (2.0 * max(1, n - keep))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-z))


def _newton(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Balanced, L2-penalised logistic regression; the intercept (last weight, last column) is penalised too."""
    keep, drop = _shares(y)
    share = np.where(y == 1, keep, drop)
    w = np.zeros(x.shape[1])
    for _ in range(MAX_STEPS):
        p = _sigmoid(x @ w)
        hess = (x * (share * p * (1.0 - p))[:, None]).T @ x + np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (share * (p - y)) + w)
        w = w - step
        if np.abs(step).max() < TOLERANCE:
            break
    return w


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def _fitted(rows: DataFrame, which: list[tuple[int, int]], p: ApplyParams) -> DataFrame:
    """Classifiers ``which`` (repeat, fold left out) of every session, from rows (session_id, pk, label, features, folds)."""
    sid = dict(rows.dtypes)[SID]
    schema = f"{SID} {sid}, rep int, fold int, coef array<double>, intercept double, n_train long, n_keep long"

    def fits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pk")
        y, folds = pdf["label"].to_numpy(), np.vstack(pdf["folds"].to_list())
        x, out = _with_one(np.vstack(pdf["features"].to_list())), []
        for rep, fold in which:
            use = folds[:, rep - 1] != fold
            if len(set(y[use])) == 2:
                w = _newton(x[use], y[use])
                out.append((pdf[SID].iloc[0], rep, fold, w[:-1].tolist(), w[-1], int(use.sum()), int(y[use].sum())))
        return pd.DataFrame(out, columns=[SID, "rep", "fold", "coef", "intercept", "n_train", "n_keep"])

    sizes = cut(rows.groupBy(SID).agg(F.count("*").alias("_n")))
    large = sizes.where(F.col("_n") > p.local_rows)
    n_large = large.count()
    columns = (SID, "pk", "label", "features", "folds")
    if not n_large:
        return rows.select(*columns).groupBy(SID).applyInPandas(fits, schema)
    small = rows.join(broadcast_if_small(large), SID, "left_anti").select(*columns).groupBy(SID).applyInPandas(fits, schema)
    many = rows.join(broadcast_if_small(large.select(SID)), SID, "left_semi").select(*columns)
    return small.unionByName(_distributed(many, which, n_large, schema))


def _distributed(rows: DataFrame, which: list[tuple[int, int]], n_sessions: int, schema: str) -> DataFrame:
    """Newton steps over rows that stay where they are; each step sums over all rows of the sessions at hand."""
    spark = rows.sparkSession
    width = rows.select(F.size("features")).first()[0] + 1
    waves = -(-n_sessions * len(which) * width * 8 // WAVE_BYTES)
    wave = F.pmod(F.xxhash64(SID), F.lit(waves)).cast("int")
    # Rows of a session lie together, in as many partitions as their number asks for.
    rows = cut(rows.withColumn("_wave", wave).repartitionByRange("_wave", SID, F.xxhash64("pk")).sortWithinPartitions("_wave", SID))
    out = None
    for i in range(waves):
        part = rows.where(F.col("_wave") == i)
        models = spark.createDataFrame(_steps(part, which, width), schema)
        out = models if out is None else out.unionByName(models)
    return out


def _members(rows: DataFrame, which: list[tuple[int, int]]) -> dict[object, np.ndarray]:
    """Per session, the rows and the KEEP rows that each classifier is fitted to (counters only)."""
    placed = rows.select(SID, "label", F.posexplode("folds").alias("at", "fold"))
    held = placed.groupBy(SID, (F.col("at") + 1).alias("rep"), "fold").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("long")).alias("keep"))
    per: dict[object, dict[tuple[int, int], tuple[int, int]]] = {}
    for r in held.toLocalIterator():
        per.setdefault(r[0], {})[(r["rep"], r["fold"])] = (r["n"], r["keep"])
    out = {}
    for sid, got in per.items():
        whole = [sum(v[i] for (rep, _), v in got.items() if rep == 1) for i in (0, 1)]
        out[sid] = np.array([[whole[i] - got.get(m, (0, 0))[i] for i in (0, 1)] for m in which], dtype=np.int64)
    return out


def _steps(rows: DataFrame, which: list[tuple[int, int]], width: int) -> list[tuple]:
    """The models of the sessions in ``rows``; only their weights and counters are on the driver."""
    spark = rows.sparkSession
    members = _members(rows, which)
    usable = {sid: [k for k, (n, keep) in enumerate(m) if 0 < keep < n] for sid, m in members.items()}
    weights = {sid: np.zeros((len(which), width)) for sid in members}
    going = {sid: set(ks) for sid, ks in usable.items() if ks}
    for _ in range(MAX_STEPS):
        if not going:
            break
        state = {sid: (sorted(ks), weights[sid], members[sid]) for sid, ks in going.items()}
        shared = spark.sparkContext.broadcast(state)
        # All at once: an iterator would run the tasks of the last stage one after the other. A wave bounds the steps.
        for sid, k, step in zip(*(c.to_pylist() for c in _solved(rows, which, width, shared).toArrow().columns)):
            step = np.frombuffer(step)
            weights[sid][k] -= step
            if np.abs(step).max() < TOLERANCE:
                going[sid].discard(k)
        going = {sid: ks for sid, ks in going.items() if ks}
        shared.unpersist()
    return [
        (sid, *which[k], weights[sid][k][:-1].tolist(), float(weights[sid][k][-1]), int(members[sid][k][0]), int(members[sid][k][1]))
        for sid, ks in usable.items()
        for k in ks
    ]


def _solved(rows: DataFrame, which: list[tuple[int, int]], width: int, shared) -> DataFrame:
    """(session, classifier, step) of one Newton step."""
    sid_type = dict(rows.dtypes)[SID]
    n_bands = -(-width // BAND)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total = None, None

        def closed() -> Iterator[pa.RecordBatch]:
            """Bands of a classifier's Hessian, with the gradient as a last column."""
            for k, m in zip(shared.value[current][0], total):
                data = [np.ascontiguousarray(m[b * BAND : (b + 1) * BAND]).tobytes() for b in range(n_bands)]
                columns = [pa.array([current] * n_bands), pa.array([k] * n_bands, pa.int32()), pa.array(range(n_bands), pa.int32()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["sid", "k", "band", "data"])

        for batch in batches:
            sids = batch.column(SID).to_pylist()
            edges = [i for i in range(len(sids)) if i == 0 or sids[i] != sids[i - 1]] + [len(sids)]
            for a, b in zip(edges[:-1], edges[1:]):
                sid = sids[a]
                if sid not in shared.value:
                    continue
                ks, weights, members = shared.value[sid]
                if sid != current:
                    if current is not None:
                        yield from closed()
                    current, total = sid, np.zeros((len(ks), width, width + 1))
                part = batch.slice(a, b - a)
                x = _with_one(matrix(part.column("features")))
                y = part.column("label").to_numpy(zero_copy_only=False)
                folds = matrix(part.column("folds"))
                for at, k in enumerate(ks):
                    rep, fold = which[k]
                    n, keep = members[k]
                    share = np.where(y == 1, n / (2.0 * keep), n / (2.0 * (n - keep))) * (folds[:, rep - 1] != fold)
                    p = _sigmoid(x @ weights[k])
                    total[at, :, :width] += (x * (share * p * (1.0 - p))[:, None]).T @ x
                    total[at, :, width] += x.T @ (share * (p - y))
        if current is not None:
            yield from closed()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total = None, None
        row = lambda: pa.RecordBatch.from_arrays(
            [pa.array([current[0]]), pa.array([current[1]], pa.int32()), pa.array([current[2]], pa.int32()), pa.array([total.tobytes()], pa.binary())],
            ["sid", "k", "band", "data"],
        )
        for batch in batches:
            for *key, data in zip(*(c.to_pylist() for c in batch.columns)):
                if key != current:
                    if current is not None:
                        yield row()
                    current, total = key, np.zeros(len(data) // 8)
                total += np.frombuffer(data)
        if current is not None:
            yield row()

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("band")
        sid, k = pdf["sid"].iloc[0], int(pdf["k"].iloc[0])
        m = np.frombuffer(b"".join(pdf["data"])).reshape(width, width + 1)
        step = np.linalg.solve(m[:, :width] + np.eye(width), m[:, width] + shared.value[sid][1][k])
        return pd.DataFrame({"sid": [sid], "k": [k], "step": [step.tobytes()]})

    schema = f"sid {sid_type}, k int, band int, data binary"
    summed = rows.select(SID, "label", "features", "folds").mapInArrow(sums, schema)
    whole = summed.repartition("sid", "k", "band").sortWithinPartitions("sid", "k", "band").mapInArrow(added, schema)
    return whole.groupBy("sid", "k").applyInPandas(solve, f"sid {sid_type}, k int, step binary")
