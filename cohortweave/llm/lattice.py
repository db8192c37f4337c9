"""Near-duplicate vectors by lattice hashing.

Unit vectors are projected at random onto several blocks of eight coordinates per table, scaled so that vectors at the
threshold differ by ``tightness`` in a block, and decoded to points of the E8 lattice. The points of all blocks together
are the cell. A vector is filed under its own cell and looks up that cell and the ``probes`` nearest neighbouring
ones (those whose lattice vector lies most in the direction of what decoding left over). Pairs that meet in some table are
verified by cosine in double precision. Cells are small by construction (volume shrinks with the blocks), have no cap,
and cells of equal vectors cannot grow: equal vectors are one class, met once.

Defined cases: a vector that is null, empty, zero, or has null or non-finite components links with nothing, as does one without a label; vectors of
different length never meet; a null id is no id: the row's component is the smallest other id it reaches, or null;
repeated rows count as vectors of their own; an empty table gives an empty result; columns of the caller are carried in a struct.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import e8, hashing
from .common import save, shuffled
from .components import components


@dataclass(frozen=True)
class Options:
    cosine: float = 0.98
    tables: int = 8
    blocks: int = 2
    probes: int = 12
    tightness: float = 0.35
    seed: int = 7


@lru_cache(maxsize=64)
def projection(seed: int, table: int, dimensions: int, blocks: int) -> np.ndarray:
    """Random directions, orthogonal as far as the dimensions allow."""
    rng = np.random.default_rng([seed, table, dimensions])
    parts = [np.linalg.qr(rng.standard_normal((dimensions, min(dimensions, 8))))[0] for _ in range(blocks)]
    if dimensions >= 8 * blocks:
        return np.linalg.qr(rng.standard_normal((dimensions, 8 * blocks)))[0]
    return np.hstack([np.pad(p, ((0, 0), (0, 8 - p.shape[1]))) for p in parts])


def cells(unit: np.ndarray, table: int, options: Options) -> np.ndarray:
    """Twice the coordinates of the own cell and of the neighbouring ones: (vectors, 1 + probes, 8 * blocks)."""
    n, dimensions = unit.shape
    reach = np.sqrt(2 - 2 * options.cosine) * np.sqrt(min(1.0, 8 / dimensions))
    y = unit @ projection(options.seed, table, dimensions, options.blocks) * (options.tightness / reach)
    y = y.reshape(n * options.blocks, 8)
    home = e8.decode(y)
    roots = e8.roots()
    gain = ((y - home) @ roots.T).reshape(n, options.blocks * len(roots))
    near = np.argpartition(-gain, options.probes, axis=1)[:, : options.probes]
    out = np.repeat((2 * home).reshape(n, 1, options.blocks, 8), 1 + options.probes, axis=1)
    rows, ranks = np.arange(n)[:, None], 1 + np.arange(options.probes)[None, :]
    out[rows, ranks, near // len(roots)] += 2 * roots[near % len(roots)]
    return np.rint(out).astype(np.int64).reshape(n, 1 + options.probes, 8 * options.blocks)


def keys(points: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """One hash per cell; ``salt`` keeps tables, labels and dimensions apart."""
    value = hashing.mixed(salt.astype(np.uint64))[:, None] + np.zeros(points.shape[:2], dtype=np.uint64)
    for i in range(points.shape[2]):
        value = hashing.mixed(value ^ points[:, :, i].astype(np.uint64))
    return value.view(np.int64)


def linked(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", keep: list[str] | None = None, options: Options = Options()) -> DataFrame:
    """Per vector: ``row_`` (columns ``keep``, all by default), n_links, component_id."""
    keep = vectors.columns if keep is None else keep
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row_")
    body = F.col(f"`{embedding}`").cast("array<double>")
    infinite = F.exists(body, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(F.col(f"`{label}`").isNotNull() & (F.size(body) > 0) & ~infinite & F.exists(body, lambda x: x != 0), F.lit(False))
    rows = vectors.select(row, F.col(f"`{vec_id}`").cast("long").alias("id_"), F.col(f"`{label}`").cast("string").alias("label_"), F.when(usable, body).alias("vector_"))
    rows = save(rows.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    # -0.0 and 0.0 are one value in a vector.
    plain = F.transform("vector_", lambda x: x + F.lit(0.0))
    usable_rows = rows.filter("vector_ is not null").select("rid", "id_", "label_", plain.alias("vector_"))
    classes = save(usable_rows.groupBy("label_", "vector_").agg(F.min("rid").alias("node"), F.count(F.lit(1)).alias("copies")), "vector_classes")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, nodes, labels = batch.column("vector_"), np.asarray(batch.column("node")), batch.column("label_").to_pylist()
            lengths = np.asarray(pa.compute.list_value_length(lists))
            flat, starts = np.asarray(lists.flatten()), np.append(0, np.cumsum(lengths)[:-1])
            salts = np.array([hash_of(x) for x in labels], dtype=np.uint64)
            for dimensions in np.unique(lengths):
                own = np.flatnonzero(lengths == dimensions)
                for part in np.array_split(own, -(-len(own) // 2000)):
                    x = flat[starts[part][:, None] + np.arange(dimensions)]
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                    for table in range(options.tables):
                        found = keys(cells(unit, table, options), salts[part] + np.uint64(1_000_003 * table + 7919 * int(dimensions)))
                        count = found.shape[1]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(found.ravel()), pa.array(np.repeat(nodes[part], count)), pa.array(np.tile(np.arange(count) == 0, len(part)))], ["cell", "node", "home"]
                        )

    looked_up = save(classes.select("node", "label_", "vector_").mapInArrow(hashed, "cell long, node long, home boolean"), "lattice_cells")
    homes = looked_up.filter("home").select("cell", F.col("node").alias("other"))
    met = looked_up.select("cell", "node").join(shuffled(homes), "cell").filter("node <> other")
    pairs = met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    side = lambda n, v: shuffled(classes.select(F.col("node").alias(n), F.col("vector_").alias(v), F.col("label_").alias(f"l{v}")))
    pairs = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").filter("lx = ly and size(x) = size(y)").select("a", "b", "x", "y")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(pa.compute.list_value_length(batch.column("x")))
            x, y = (np.asarray(batch.column(c).flatten()) for c in ("x", "y"))
            starts = np.append(0, np.cumsum(lengths)[:-1]).astype(np.int64)
            if not len(starts):
                continue
            scale = lambda v: v / np.repeat(np.maximum.reduceat(np.abs(v), starts), lengths)
            x, y = scale(x), scale(y)
            dot, xx, yy = (np.add.reduceat(v, starts) for v in (x * y, x * x, y * y))
            near = dot / (np.sqrt(xx) * np.sqrt(yy)) >= options.cosine
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near)) for c in ("a", "b")], ["a", "b"])

    links = save(pairs.mapInArrow(verified, "a long, b long"), "vector_links")
    copies = classes.select("node", "copies")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(shuffled(copies.withColumnRenamed("node", "b")), "b").groupBy("a").agg(F.sum("copies").alias("others")).withColumnRenamed("a", "node")
    resolved = classes.join(shuffled(others), "node", "left").join(shuffled(components(links)), "node", "left")
    resolved = resolved.select("label_", "vector_", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root_"))
    placed = save(usable_rows.join(shuffled(resolved), ["label_", "vector_"]).select("rid", "id_", "n_links", "root_"), "placed")
    least = placed.groupBy("root_").agg(F.min("id_").alias("least_"))
    placed = placed.join(shuffled(least), "root_").select("rid", "n_links", "least_")
    return rows.select("row_", "id_", "rid").join(shuffled(placed), "rid", "left").select(
        "row_", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least_", "id_").alias("component_id")
    )


def hash_of(label: str) -> int:
    return int(hashing.word_hashes([label.encode()])[0])
