"""Exact n-gram Jaccard join in a metric space.

1. A sketch of all documents' shingles tells which occur once; a document can only link if four fifths of its
   shingles occur elsewhere. The others are done. Equal sets become one class (copies never meet each other).
2. Documents without a common shingle are at distance 1 and need no comparing, but no pivot could tell them apart
   either. So the first regions are those around pivots reached by shared rare shingles: of the documents with a
   shingle in their prefix (rarest first), the smallest is the pivot, and all others join its region. A linked
   pair shares a prefix shingle and so a region.
3. Regions up to a size are joined in one task: the pivot's distances split a region at their median, and
   documents whose distance lies within the threshold of the split go to both sides (triangle inequality). What a
   split cannot divide is compared pivot by pivot until all are linked or none is left.
4. Larger regions are split by Spark: several pivots make Voronoi cells; a document also goes to cells whose pivot is nearer
   than its own plus twice the threshold; documents linked to the same pivot need no more comparing with each other and
   stay only as partners, in the window of distances that open documents, or those linked to another pivot, can reach. Cells
   go through this again.
   Regions that do not divide are cut into blocks that are compared pairwise, each pair of blocks in its own group.
5. Links (spanning each component) are resolved to components.

Distances are ratios of whole numbers and compared as such: 100 * common >= percent * union. Shingles are told apart by 64-bit hashes.

Defined cases: no text and no words give an empty set, linked with nothing; a null id is no id: the row's component is the smallest other id it
reaches, or null; repeated rows are in one class; an empty table gives an empty result; columns of the caller are carried in a struct.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hashing
from .common import broadcast_measured, save, stretches
from .components import components
from .sketch import fitting, levels, repeated, sketch


@dataclass(frozen=True)
class Options:
    words: int = 5
    percent: int = 80
    region_shingles: int = 3_000_000  # of a region that one task joins
    pivots: int = 8  # of a region that Spark splits
    levels: int = 3  # of such splits before blocks
    block_shingles: int = 1_000_000


#: A count of two in the sketch's scale of levels.
TWICE = 5
#: The most slots of a row of levels, which take a byte each.
LEVEL_SLOTS = 1 << 26


def shingles(text: bytes, words: int) -> np.ndarray:
    """The sorted distinct shingles of a text; fewer words make one shingle of all."""
    hashes = hashing.word_hashes(text.lower().split())
    if 0 < len(hashes) < words:
        return hashing.windows(hashes, len(hashes)) + np.uint64(len(hashes))
    return np.unique(hashing.windows(hashes, words))


def needed(sizes, percent: int):
    """How many shingles a set of this size must share with any partner."""
    return -(-sizes * percent // 100)


def _raw(x: pa.Scalar) -> bytes:
    return x.as_buffer().to_pybytes() if x.is_valid else b""


def _array(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype="<u8")


class Region:
    """Sets of one region over a vocabulary of their own; finds links that span its components."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.parts = np.split(flat, np.cumsum(self.sizes)[:-1])
        self.mark = np.zeros(len(vocabulary), dtype=bool)
        self.root = np.arange(len(sets))
        self.links: list[tuple[int, int]] = []

    def common(self, p: int, members: np.ndarray) -> np.ndarray:
        self.mark[self.parts[p]] = True
        flat = np.concatenate([self.parts[m] for m in members])
        edges = np.append(0, np.cumsum(self.sizes[members])[:-1])
        out = np.add.reduceat(self.mark[flat].astype(np.int64), edges)
        self.mark[self.parts[p]] = False
        return out

    def _link(self, p: int, members: np.ndarray, common: np.ndarray) -> None:
        union = self.sizes[p] + self.sizes[members] - common
        for m in members[100 * common >= self.percent * union]:
            a, b = self.root[p], self.root[m]
            if a != b:
                self.root[self.root == max(a, b)] = min(a, b)
                self.links.append((p, int(m)))

    def join(self, members: np.ndarray, depth: int = 0) -> None:
        """Every pair of members is compared, cannot link by its distances to a pivot, or is in one component already."""
        if len(members) <= 1 or (self.root[members] == self.root[members[0]]).all():
            return
        if len(members) > 32 and depth < 24:
            p, rest = members[0], members[1:]
            common = self.common(p, rest)
            self._link(p, rest, common)
            distance = 1 - common / (self.sizes[p] + self.sizes[rest] - common)
            middle, reach = np.median(distance), 1 - self.percent / 100 + 1e-9
            inner = rest[distance <= middle]
            outer = rest[distance > middle - reach]
            if len(inner) + len(outer) < 1.5 * len(rest) and max(len(inner), len(outer)) < len(rest):
                self.join(inner, depth + 1)
                self.join(outer, depth + 1)
                return
            members = rest
        while len(members) > 1 and not (self.root[members] == self.root[members[0]]).all():
            p, members = members[0], members[1:]
            near = members[(100 * self.sizes[members] >= self.percent * self.sizes[p]) & (100 * self.sizes[p] >= self.percent * self.sizes[members]) & (self.root[members] != self.root[p])]
            if len(near):
                self._link(p, near, self.common(p, near))


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str], values: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of rows that come sorted by ``keys``; one group in memory at a time."""
    current, held = None, []
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in [*keys, *values]]
        for row in zip(*columns):
            key = row[: len(keys)]
            if key != current:
                if held:
                    yield current, held
                current, held = key, []
            held.append(row[len(keys) :])
    if held:
        yield current, held


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["a", "b"])


def _joined(regions: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links of regions of bounded size: rows (keys, node, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, keys, ["node", "set"]):
            nodes = [r[0] for r in rows]
            if len(nodes) > 1:
                region = Region([_array(r[1]) for r in rows], percent)
                region.join(np.arange(len(nodes)))
                if region.links:
                    yield _pairs([(nodes[a], nodes[b]) for a, b in region.links])

    columns = [*keys, "node", "set"]
    return regions.select(*columns).repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(run, "a long, b long")


def _split(region: DataFrame, level: int, options: Options) -> tuple[DataFrame, DataFrame]:
    """(links, cells): one Voronoi level of the large regions ``region`` (region, node, n, by, set); ``by`` is the pivot that a
    document was linked to last on the way to its region, or null: only documents linked to one pivot are settled with each other.

    Pivots are open documents, or any where all are linked.
    """
    salted = F.xxhash64("node", F.lit(level))
    first = F.min(F.struct(F.col("by").isNotNull().alias("closed"), salted.alias("h"), "node"))
    chosen = region.groupBy("region", F.pmod(salted, F.lit(options.pivots)).alias("slot")).agg(first.alias("p"))
    chosen = chosen.withColumn("none_open", F.min("p.closed").over(Window.partitionBy("region"))).filter("p.closed = none_open")
    chosen = chosen.select("region", F.col("p.node").alias("node")).join(region.select("region", "node", "set"), ["region", "node"])
    chosen = chosen.groupBy("region").agg(F.sort_array(F.collect_list(F.struct("node", "set"))).alias("pivots"))
    rows = region.join(chosen, "region").select("region", "node", "n", "by", "set", "pivots")
    percent, reach = options.percent, 1 - options.percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for region_, node, n, by, set_, pivots in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                own, distance, linked = _array(set_), [], []
                for p in pivots:
                    other = _array(p["set"])
                    common = len(np.intersect1d(own, other, assume_unique=True))
                    union = len(own) + len(other) - common
                    distance.append(1 - common / union)
                    linked.append(p["node"] != node and 100 * common >= percent * union)
                if any(p["node"] == node for p in pivots):
                    out += [(region_, node, p["node"], None, None, None, True) for p, hit in zip(pivots, linked) if hit]
                    continue  # compared with every member: done
                home = min(distance)
                for p, d, hit in zip(pivots, distance, linked):
                    if d <= home + 2 * reach + 1e-9:
                        out.append((region_, node, p["node"], n, d, p["node"] if hit else by, hit))
                    elif hit:
                        out.append((region_, node, p["node"], None, None, None, True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["region", "node", "pivot", "n", "d", "by", "hit"])

    placed = save(rows.mapInArrow(run, "region long, node long, pivot long, n long, d double, by long, hit boolean"), "cells")
    links = placed.filter("hit").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    cells = placed.filter("n is not null").withColumn("cell", F.xxhash64("region", "pivot", F.lit(level)))
    # A cell has no more different pivots in ``by`` than there were levels.
    spread = cells.groupBy("cell", "by").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    spread = spread.groupBy("cell").agg(F.collect_list(F.struct("by", "low", "high")).alias("spread"))
    unsettled = lambda s: s["by"].isNull() | F.col("by").isNull() | (s["by"] != F.col("by"))
    inside = F.exists("spread", lambda s: unsettled(s) & F.col("d").between(s["low"] - reach - 1e-9, s["high"] + reach + 1e-9))
    cells = cells.join(spread, "cell").filter(inside).select(F.col("cell").alias("region"), "node", "n", "by")
    return links, cells


def _blocked(region: DataFrame, options: Options) -> DataFrame:
    """Links of regions that do not divide: all pairs of blocks, each pair a group of its own."""
    sizes = region.groupBy("region").agg(F.sum("n").alias("total"))
    blocks = F.ceil(F.col("total") / options.block_shingles)
    rows = region.join(sizes, "region").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    return _joined(rows, ["region", "i", "j"], options.percent)


def _region_links(members: DataFrame, sets: DataFrame, options: Options) -> DataFrame:
    """Links within regions (region, node, n): small ones in a task, large ones split first."""
    spark = members.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    members = members.withColumn("by", F.lit(None).cast("long"))
    for level in range(options.levels + 1):
        sized = members.groupBy("region").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("count"))
        sized = save(sized.filter("count > 1"), "region_sizes")
        small, large = sized.filter(F.col("total") <= options.region_shingles), sized.filter(F.col("total") > options.region_shingles)
        near = save(members.join(broadcast_measured(small.select("region")), "region", "left_semi"), "small_regions")
        near = sets.select("node", "set").join(broadcast_measured(near), "node")
        links = links.unionByName(save(_joined(near, ["region"], options.percent), "region_links"))
        if large.isEmpty():
            break
        far = members.join(broadcast_measured(large.select("region")), "region", "left_semi")
        far = save(far.join(sets.select("node", "set"), "node"), "large_regions")
        if level == options.levels:
            links = links.unionByName(save(_blocked(far, options), "region_links"))
            break
        found, members = _split(far, level, options)
        links = links.unionByName(found)
    return links


def linked(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, options: Options = Options()) -> DataFrame:
    """Per document: ``row_`` (columns ``keep``, all by default), n_shingles, component_id, and ``kept``: one row of each component (of
    the smallest id; of rows with that id, one)."""
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row_")
    source = docs.select(row, F.col(f"`{doc_id}`").cast("long").alias("id_"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text_"))
    chars = source.agg(F.sum(F.length("text_"))).first()[0] or 0

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for x in batch.column("text_"):
            yield shingles(_raw(x), options.words)

    bits = spark.sparkContext.broadcast(sketch(source.select("text_"), hashes, fitting(chars // 6), "repeated"))
    schema = source.select("row_", "id_").schema.add("n_shingles", "long").add("h", "long").add("g", "long").add("set", "binary")

    def surviving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in stretches(whole, "text_")):
            sizes, h, g, sets = [], [], [], []
            for x in batch.column("text_"):
                own = shingles(_raw(x), options.words)
                n = len(own)
                may = n > 0 and int(repeated(bits.value, own).sum()) >= needed(n, options.percent)
                sizes.append(n)
                whole = own.astype("<u8").tobytes() if may else None
                sets.append(whole)
                h.append(int(hashing.mixed(own).sum().view(np.int64)) if may else None)
                g.append(int(hashing.mixed(own ^ np.uint64(hashing.BASES[1])).sum().view(np.int64)) if may else None)
            arrays = [batch.column("row_"), batch.column("id_"), *[pa.array(v, pa.int64()) for v in (sizes, h, g)], pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    rows = save(source.mapInArrow(surviving, schema).withColumn("rid", F.monotonically_increasing_id()), "shingle_sets")
    bits.unpersist()
    may = rows.filter("h is not null")
    classes = save(may.groupBy("h", "g", "n_shingles").agg(F.min("rid").alias("node")), "set_classes")
    sets = save(
        may.join(broadcast_measured(classes.select(F.col("node").alias("rid"))), "rid", "left_semi").select(F.col("rid").alias("node"), F.col("n_shingles").alias("n"), "set"),
        "class_sets",
    )
    total = sets.agg(F.sum("n")).first()[0] or 0

    def of_sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for x in batch.column("set"):
            yield _array(x.as_py())

    rarity = spark.sparkContext.broadcast(sketch(sets.select("set"), of_sets, min(LEVEL_SLOTS, fitting(total)), "levels"))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [])
            for node, n, x in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = _array(x)
                level = levels(rarity.value, own)
                must = int(needed(n, options.percent))
                if int((level >= TWICE).sum()) < must:
                    continue
                order = np.lexsort((own, level))[: n - must + 1]
                keys = own[order][level[order] >= TWICE].view(np.int64)
                out[0].append(keys)
                out[1].append(np.full(len(keys), node))
                out[2].append(np.full(len(keys), n))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], ["key", "node", "n"])

    postings = save(sets.select("node", "n", "set").mapInArrow(prefixes, "key long, node long, n long"), "prefixes")
    rarity.unpersist()
    pivots = postings.groupBy("key").agg(F.min("node").alias("region"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    members = save(postings.join(pivots, "key").select("region", "node", "n").distinct(), "regions")
    roots = components(_region_links(members, sets, options))
    # Rows of a class, classes of a component; ids are summed up before they are shuffled.
    resolved = classes.join(roots, "node", "left").select("h", "g", "n_shingles", "node", F.coalesce("root", "node").alias("root_"))
    placed = may.select("rid", "id_", "h", "g", "n_shingles").join(broadcast_measured(save(resolved, "resolved")), ["h", "g", "n_shingles"])
    placed = save(placed.select("rid", "id_", "root_"), "placed")
    first = F.min(F.struct(F.col("id_").isNull().alias("without"), "id_", "rid"))
    least = placed.groupBy("root_").agg(F.min("id_").alias("least_"), first.getField("rid").alias("keeper_"))
    placed = placed.join(broadcast_measured(least), "root_").select("rid", "least_", (F.col("rid") == F.col("keeper_")).alias("kept_"))
    placed = broadcast_measured(save(placed, "kept"))
    return rows.select("row_", "id_", "n_shingles", "rid").join(placed, "rid", "left").select(
        "row_", "n_shingles", F.coalesce("least_", "id_").alias("component_id"), F.coalesce("kept_", F.lit(True)).alias("kept")
    )
