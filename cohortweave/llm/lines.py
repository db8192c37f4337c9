"""Removal of lines that repeat an earlier line, by an exact set-similarity join.

A line is the set of its words; two lines match at a Jaccard similarity of ``percent``. A line goes when an earlier line
(smaller document id, or same document and earlier place) matches; lines are judged on the input.

1. Words are counted in merged sketches; their estimates give one order for all lines, rarest first.
2. Lines are written once, with hashes of their sets. Of equal sets the first line stays for comparison, the others are repeats.
3. First lines post the words of their prefix (words that occur once anywhere cannot meet and are left out), each with its place,
   the size and a 128-bit parity signature of the set. Buckets of words are joined by size: the length filter ends
   a run, the positional filter and the signature (sets that differ in d words differ in at most d bits) drop pairs.
4. Every line gets its closest earlier candidates verified first. Lines they do not settle, and that had more
   candidates, get all of them verified. So a group of copies costs a few pairs per line, and no match is lost.

Defined cases: no text has one empty line; lines without a word are neither compared nor removed, all others are, however short; rows with the same
id and text are one document (a line is not earlier than itself), different texts of one id and rows without an id are documents of their own
(``document_keys``); a null id comes before all others; an empty table gives an empty
result; columns of the caller are carried in a struct.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing
from .common import broadcast_measured, document_keys, save
from .sketch import Counter, levels, merged, sketch

#: Slots of a row of the word sketch, a byte each, whatever the corpus.
WORD_SLOTS = 1 << 22
BUCKET = 1_000_000
FLUSH = 1_000_000
#: Candidates of a line and bucket that are verified at once; lines they do not settle get all of theirs.
AT_ONCE = 4
#: Pairs held at a time inside a bucket.
PAIRS = 4_000_000

#: Columns that name a line, and the earlier line of a pair.
LINE, EARLIER = ["id_", "sub_", "line"], ["id2", "sub2", "line2"]

#: Marks, in the size of an entry, a line whose candidates are all wanted.
OPEN = np.uint32(1 << 31)
ENTRY = np.dtype([("key", "<u8"), ("doc", "<i8"), ("sub", "<i8"), ("line", "<u4"), ("size", "<u4"), ("at", "<u4"), ("s0", "<u8"), ("s1", "<u8")])


@dataclass(frozen=True)
class Options:
    percent: int = 80
    #: Lines with fewer different words are left as they are; lines without a word always are.
    least_words: int = 1

    def __post_init__(self):
        if self.least_words < 1:
            raise ValueError("least_words must be at least 1")


def line_sets(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(line, word) hashes of the different words of each line, lines in order."""
    line, word = line_words(bodies)
    bits = np.uint64(max(1, len(bodies).bit_length()))
    key = (line.astype(np.uint64) << (np.uint64(64) - bits)) | (word >> bits)
    order = np.argsort(key)
    return different(line, word, key, order, lambda: np.lexsort((word, line)))


def line_words(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(line, word) hashes of all words, in order."""
    counts, word = hashing.split_hashes(bodies)
    return np.repeat(np.arange(len(bodies)), counts), word


def different(line: np.ndarray, word: np.ndarray, key: np.ndarray, order: np.ndarray, exact: Callable[[], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Lines and words in ``order``, which sorts ``key``, each word of a line once; ``exact`` orders where two words of a line share a key."""
    word = word[order]
    twice = key[order]
    twice = twice[1:] == twice[:-1]
    if (twice & (word[1:] != word[:-1])).any():
        order, inverse = exact(), np.argsort(order)
        word = word[inverse][order]
        twice = (line[order][1:] == line[order][:-1]) & (word[1:] == word[:-1])
    once = np.append(np.ones(min(1, len(word)), dtype=bool), ~twice)
    return line[order[once]], word[once]


def summed(values: np.ndarray, line: np.ndarray, n: int, how=np.add) -> np.ndarray:
    """Values of each line put together; lines come in order and may be without values."""
    out = np.zeros(n, dtype=np.uint64)
    if len(line):
        starts = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        out[line[starts]] = how.reduceat(values, starts)
    return out


def ranked_sets(bodies: list[bytes], rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``line_sets`` with the words of a line ordered by level and word; one sort of numbers unless two words of a line agree in 36 bits."""
    line, word = line_words(bodies)
    level = levels(rarity, word)
    key = (line.astype(np.uint64) << np.uint64(44)) | (level.astype(np.uint64) << np.uint64(36)) | (word >> np.uint64(28))
    return different(line, word, key, np.argsort(key), lambda: np.lexsort((word, level, line)))


def overlap(sizes, percent: int):
    """The least common words of two matching lines whose sizes add up to ``sizes``."""
    return -(-percent * sizes // (100 + percent))


LINES = "id_ long, sub_ long, line long, size long, h long, g long, body binary"


def written_lines(source: DataFrame, least: int) -> tuple[DataFrame, np.ndarray]:
    """(id_, sub_, line, size, h, g, body) of every line with enough different words, and the sketch of their words.

    Both come from one pass: tasks write their lines and their counters into one table.
    """
    names = [f.split()[0] for f in f"{LINES}, {Counter.SCHEMA}".split(", ")]
    kinds = [pa.int64()] * 6 + [pa.binary(), pa.int64(), pa.binary(), pa.binary()]

    def row_batch(columns: list[pa.Array], first: int) -> pa.RecordBatch:
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([columns[i - first] if 0 <= i - first < len(columns) else pa.nulls(n, k) for i, k in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(WORD_SLOTS)
        for batch in batches:
            ids, subs, places, bodies = [], [], [], []

            def flush() -> Iterator[pa.RecordBatch]:
                line, word = line_sets(bodies)
                sizes = np.bincount(line, minlength=len(bodies))
                h = summed(hashing.mixed(word), line, len(bodies))
                g = summed(hashing.mixed(word ^ np.uint64(hashing.BASES[1])), line, len(bodies))
                use = np.flatnonzero(sizes >= least)
                columns = [pa.array(np.array(x, dtype=np.int64)[use]) for x in (ids, subs, places)]
                columns += [pa.array(x[use].view(np.int64)) for x in (sizes.astype(np.int64), h, g)]
                yield row_batch([*columns, pa.array([bodies[i] for i in use], pa.binary())], 0)
                for columns in counter.add(word):
                    yield row_batch(columns, 7)

            held = 0
            for id_, sub, text in zip(batch.column("id_").to_pylist(), batch.column("sub_").to_pylist(), batch.column("text_").cast(pa.binary()).to_pylist()):
                for place, body in enumerate(text.split(b"\n")):
                    if body:
                        ids.append(id_)
                        subs.append(sub)
                        places.append(place)
                        bodies.append(body)
                        held += len(body)
                if held > 4 << 20:
                    yield from flush()
                    ids, subs, places, bodies, held = [], [], [], [], 0
            if bodies:
                yield from flush()
        for columns in counter.flush():
            yield row_batch(columns, 7)

    both = save(source.mapInArrow(run, f"{LINES}, {Counter.SCHEMA}"), "lines")
    return both.filter("block is null").select(*names[:7]), merged(both.filter("block is not null"), WORD_SLOTS, "levels")


def _in_prefix(line: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in their lines of words in order, and which of them belong to the prefix."""
    at = np.arange(len(line)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return at, at < (sizes + 1 + (-sizes * percent // 100))[line]


def _prefix_words(lines: DataFrame, rarity, options: Options) -> np.ndarray:
    """The sketch of the words in the prefixes of ``lines``: of a fixed size, and with a level above 0 for each of them."""

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        bodies = batch.column("body").to_pylist()
        for first in range(0, len(bodies), 4000):
            part = bodies[first : first + 4000]
            line, word = ranked_sets(part, rarity.value)
            yield word[_in_prefix(line, np.bincount(line, minlength=len(part)), options.percent)[1]]

    return sketch(lines.select("body"), hashes, WORD_SLOTS, "levels")


def _postings(lines: DataFrame, rarity, buckets: int, options: Options, wanted=None) -> DataFrame:
    """Entries of the lines' prefixes by bucket; with ``wanted`` (a broadcast of ``_prefix_words``) only of words that it has."""
    percent = options.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush() -> pa.RecordBatch:
            every = np.concatenate(held)
            bucket = (every["key"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            order = np.argsort(bucket, kind="stable")
            every, edges = every[order], np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            used = np.flatnonzero(np.diff(edges))
            data = [b"".join(every[f][edges[b] : edges[b + 1]].tobytes() for f in ENTRY.names) for b in used]
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(data, pa.binary())], ["bucket", "data"])

        for batch in batches:
            bodies = batch.column("body").to_pylist()
            for first in range(0, len(bodies), 4000):
                part = bodies[first : first + 4000]
                ids, subs, places, open_ = (batch.column(c).to_numpy(zero_copy_only=False)[first : first + 4000] for c in ("id_", "sub_", "line", "open"))
                line, word = ranked_sets(part, rarity.value)
                sizes = np.bincount(line, minlength=len(part))
                at, use = _in_prefix(line, sizes, percent)
                use[use] = levels(rarity.value, word[use]) > 1
                if wanted is not None:
                    use[use] = levels(wanted.value, word[use]) > 0
                bit = np.uint64(1) << (word & np.uint64(63))
                high = (word >> np.uint64(6)) & np.uint64(1) == 1
                s0, s1 = (summed(np.where(x, bit, np.uint64(0)), line, len(part), np.bitwise_xor) for x in (~high, high))
                entry = np.empty(int(use.sum()), dtype=ENTRY)
                line = line[use]
                entry["key"], entry["at"] = hashing.mixed(word[use]), at[use]
                entry["doc"], entry["sub"], entry["line"], entry["size"] = ids[line], subs[line], places[line], sizes[line]
                entry["size"] |= np.where(open_.astype(bool)[line], OPEN, np.uint32(0))
                entry["s0"], entry["s1"] = s0[line], s1[line]
                held.append(entry)
                count += len(entry)
                if count >= FLUSH:
                    yield flush()
                    held, count = [], 0
        if count:
            yield flush()

    return lines.mapInArrow(run, "bucket long, data binary")


def _pairs_of(e: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, differing bits) of candidate pairs in entries sorted by key and size, a bounded number at a time."""
    i, shift, out, held = np.arange(len(e)), 1, [], 0
    # Only the shorter line's index prefix has to meet the longer one's probe prefix.
    i = i[e["at"] < e["size"].astype(np.int64) - overlap(2 * e["size"].astype(np.int64), percent) + 1]
    while True:
        i = i[i + shift < len(e)]
        j = i + shift
        a, b = e["size"][i].astype(np.int64), e["size"][j].astype(np.int64)
        same = (e["key"][i] == e["key"][j]) & (100 * a >= percent * b)
        i, j, a, b = i[same], j[same], a[same], b[same]
        if not len(i):
            break
        must = overlap(a + b, percent)
        reach = 1 + np.minimum(a - e["at"][i], b - e["at"][j]) - 1
        differ = np.bitwise_count(e["s0"][i] ^ e["s0"][j]).astype(np.int64) + np.bitwise_count(e["s1"][i] ^ e["s1"][j])
        ok = (reach >= must) & (differ <= a + b - 2 * must) & ((e["doc"][i] != e["doc"][j]) | (e["sub"][i] != e["sub"][j]) | (e["line"][i] != e["line"][j]))
        if ok.any():
            out.append((i[ok], j[ok], differ[ok]))
            held += int(ok.sum())
        if held >= PAIRS:
            yield tuple(np.concatenate(c) for c in zip(*out))
            out, held = [], 0
        shift += 1
    if out:
        yield tuple(np.concatenate(c) for c in zip(*out))


def _candidates(postings: DataFrame, options: Options, closest: bool) -> DataFrame:
    """Later and earlier lines that may match: the closest few for each later line and bucket, with ``more``; or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def closed() -> Iterator[pa.RecordBatch]:
            e = np.concatenate(held)
            wanted = e["size"] >= OPEN
            e["size"] &= OPEN - np.uint32(1)
            order = np.lexsort((e["line"], e["sub"], e["doc"], e["size"], e["key"]))
            e, wanted = e[order], wanted[order]
            for i, j, differ in _pairs_of(e, options.percent):
                first = (e["sub"][i] < e["sub"][j]) | ((e["sub"][i] == e["sub"][j]) & (e["line"][i] < e["line"][j]))
                first = (e["doc"][i] < e["doc"][j]) | ((e["doc"][i] == e["doc"][j]) & first)
                early, late = np.where(first, i, j), np.where(first, j, i)
                if not closest:
                    early, late, differ = (x[wanted[late]] for x in (early, late, differ))
                    if not len(late):
                        continue
                order = np.lexsort((e["line"][early], e["sub"][early], e["doc"][early], differ, e["line"][late], e["sub"][late], e["doc"][late]))
                early, late, differ = early[order], late[order], differ[order]
                keys = [e[f][x] for x in (late, early) for f in ("doc", "sub", "line")]
                same = np.append(False, np.logical_and.reduce([k[1:] == k[:-1] for k in keys]))
                early, late, differ = early[~same], late[~same], differ[~same]
                more = np.zeros(len(late), dtype=bool)
                if closest:
                    new = np.append(True, np.logical_or.reduce([e[f][late][1:] != e[f][late][:-1] for f in ("doc", "sub", "line")]))
                    starts = np.flatnonzero(new)
                    counts = np.diff(np.append(starts, len(late)))
                    near = np.arange(len(late)) - np.repeat(starts, counts) < AT_ONCE
                    more = (np.repeat(counts, counts) > AT_ONCE)[near]
                    early, late, differ = early[near], late[near], differ[near]
                columns = [*[e[f][x].astype(np.int64) for x in (late, early) for f in ("doc", "sub", "line")], differ, more]
                for k in range(0, len(late), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 100_000]) for c in columns], [*LINE, *EARLIER, "differ", "more"])

        for batch in batches:
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist()):
                if bucket != current:
                    if held:
                        yield from closed()
                    current, held = bucket, []
                n, at = len(data) // ENTRY.itemsize, 0
                entry = np.empty(n, dtype=ENTRY)
                for f in ENTRY.names:
                    entry[f] = np.frombuffer(data, dtype=ENTRY[f], count=n, offset=at)
                    at += n * ENTRY[f].itemsize
                held.append(entry)
        if held:
            yield from closed()

    grouped = postings.repartition("bucket").sortWithinPartitions("bucket")
    return grouped.mapInArrow(run, "id_ long, sub_ long, line long, id2 long, sub2 long, line2 long, differ long, more boolean")


def _verified(pairs: DataFrame, lines: DataFrame, options: Options) -> DataFrame:
    """Pairs with ``match``: whether the lines' words are similar enough."""
    needed = pairs.select(*LINE).unionByName(pairs.select(*[F.col(b).alias(a) for a, b in zip(LINE, EARLIER)])).distinct()
    bodies = lines.select(*LINE, "body").join(broadcast_measured(save(needed, "needed_lines")), LINE, "left_semi")
    bodies = save(bodies, "needed_bodies")
    both = pairs.join(bodies.withColumnRenamed("body", "x"), LINE).join(
        bodies.select(*[F.col(a).alias(b) for a, b in zip(LINE, EARLIER)], F.col("body").alias("y")), EARLIER
    )
    kept = [c for c in both.columns if c not in ("x", "y")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            match = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = set(x.split()), set(y.split())
                common = len(x & y)
                match.append(100 * common >= options.percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(match, pa.bool_())], [*kept, "match"])

    return both.mapInArrow(run, T.StructType([*[both.schema[c] for c in kept], T.StructField("match", T.BooleanType())]))


def repeats(source: DataFrame, options: Options = Options()) -> DataFrame:
    """(id_, sub_, line) of every line to remove; ``source`` has id_, sub_ and text_."""
    lines, rows = written_lines(source, options.least_words)
    rarity = source.sparkSession.sparkContext.broadcast(rows)
    place = F.struct(*LINE)
    firsts = lines.groupBy("h", "g", "size").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last")
    equal = lines.select(*LINE, "h", "g", "size").join(broadcast_measured(save(firsts.drop("last"), "equal_lines")), ["h", "g", "size"])
    equal = save(equal.filter(place > F.col("first")).select(*LINE), "repeated_lines")
    chosen = lines.select(*LINE, "size", "body").join(broadcast_measured(equal.distinct()), LINE, "left_anti")
    total = lines.agg(F.sum("size")).first()[0] or 0
    buckets = max(64, total // 5 // BUCKET)
    close = _candidates(_postings(chosen.withColumn("open", F.lit(False)), rarity, buckets, options), options, closest=True)
    best = close.groupBy(*LINE, *EARLIER).agg(F.max("more").alias("more"))
    best = save(best, "closest_lines")
    tested = save(_verified(best, lines, options), "tested_lines")
    removed = equal.unionByName(tested.filter("match").select(*LINE))
    open_ = tested.groupBy(*LINE).agg(F.max("match").alias("settled"), F.max("more").alias("more"))
    open_ = save(open_.filter("not settled and more").select(*LINE), "open_lines")
    if not open_.isEmpty():
        # Only words in prefixes of open lines and lines of sizes that these can match take part, and only their pairs are emitted.
        reach = F.sequence(F.ceil(F.col("size") * options.percent / 100), F.floor(F.col("size") * 100 / options.percent))
        sizes = chosen.join(broadcast_measured(open_), LINE, "left_semi").select(F.explode(reach).alias("size")).distinct()
        again = chosen.join(broadcast_measured(save(sizes, "open_sizes")), "size", "left_semi")
        again = again.join(broadcast_measured(open_.withColumn("open", F.lit(True))), LINE, "left").fillna(False, ["open"])
        wanted = _prefix_words(chosen.join(broadcast_measured(open_), LINE, "left_semi"), rarity, options)
        wanted = source.sparkSession.sparkContext.broadcast(wanted)
        rest = _candidates(_postings(again, rarity, buckets, options, wanted), options, closest=False).select(*LINE, *EARLIER)
        rest = save(rest.distinct().join(tested.select(*LINE, *EARLIER), [*LINE, *EARLIER], "left_anti"), "further_lines")
        removed = removed.unionByName(_verified(rest, lines, options).filter("match").select(*LINE))
    return save(removed.distinct(), "removed_lines")


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, options: Options = Options()) -> DataFrame:
    """``row_`` (columns ``keep``, all by default), n_lines, n_removed, and ``kept_``: the lines left (null text stays null)."""
    keep = docs.columns if keep is None else keep
    key = document_keys(docs, text, doc_id)
    gone = repeats(docs.select(*key, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text_")), options)
    gone = gone.groupBy("id_", "sub_").agg(F.sort_array(F.collect_list("line")).alias("gone_"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row_"), *key, F.col(f"`{text}`").alias("text_"))
    joined = rows.join(broadcast_measured(save(gone, "removed_by_document")), ["id_", "sub_"], "left").select("row_", "text_", "gone_")
    schema = T.StructType([joined.schema["row_"], *[T.StructField(n, T.LongType()) for n in ("n_lines", "n_removed")], T.StructField("kept_", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_removed, kept = [], [], []
            for text_, places in zip(batch.column("text_").to_pylist(), batch.column("gone_").to_pylist()):
                drop = set(places or ())
                n_lines.append((text_ or "").count("\n") + 1)
                n_removed.append(len(drop))
                kept.append(text_ if not drop else "\n".join(p for i, p in enumerate(text_.split("\n")) if i not in drop))
            yield pa.RecordBatch.from_arrays([batch.column("row_"), pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], schema.names)

    return joined.mapInArrow(run, schema)
