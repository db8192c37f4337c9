"""Phrases that occur together more often than their parts would, by stripes.

A stripe is the counter of the words that follow one prefix. Stripes grow level by level, each level from one pass over coded texts:

1. Texts are cut into pieces and words once and written as blocks of codes with the block's own dictionary. Counts of all dictionaries,
   merged, are the stripe of the empty prefix: word counts, and the number of words of each language.
2. Level k counts the words after every prefix of k words. A task adds up its stripes before it sends them, stripes with one prefix are
   merged elementwise, cut into ``SLICES`` slices by next word, so that no stripe, however long, meets in one task. Entries below ``least``
   are dropped: a longer phrase never occurs more often than its parts, so a place is only counted if both the prefix and
   what follows its first word are frequent. Which are frequent tells a Bloom filter of the level before; what it lets through wrongly is
   counted and dropped like other rare phrases, so the result does not depend on it.
3. A frequent entry is a phrase. From its prefix it takes over the counts of its first words, from the phrase behind its first word those of
   its last words, which are all counts that its score needs. The largest entry of a phrase's stripe and the largest of the entries that end with it
   are the extensions that can make it superfluous: where a longer phrase does, one that is longer by a single word does too.
4. Scores are exact decimals. The best of every language are found in parts first, and words are looked up only for phrases that can be among them.

Words are told apart by 64-bit hashes, which are checked over the whole vocabulary: if two words share one, all are hashed anew. An entry
is known by the hashes of its prefix and of its last word (128 bits).

Defined cases: null text counts as empty and has no words; a null language is ``und``; repeated rows count each for itself; a word of another case of A to Z
is the same word; languages without candidates give no rows, an empty table gives an empty result; columns of the caller other than text and
language are not read; a long text is coded in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_measured, save, stretches
from .hashing import BASES, mixed

#: Ends of pieces become one byte that UTF-8 never has, tabs become blanks.
_END = b"\xff"
_TABLE = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b for b in range(256))

#: A block ends with the text that brings it to so many words, or so many different ones.
BLOCK_WORDS = 1_000_000
BLOCK_TERMS = 100_000
#: Blocks in a file, which a task reads at once, some 7 MB each.
FILE_BLOCKS = 4
#: Bytes of a text that are cut into words at once.
PART_BYTES = 4 << 20
#: Entries that a task gathers before it adds them up and sends them.
FLUSH = 1_500_000
#: Places of a block that are looked at together.
STRETCH = 250_000
#: Bytes of stripes that are sent as one batch.
SENT_BYTES = 8 << 20
#: Words of the corpus for each bucket of stripes.
BUCKET_WORDS = 400_000
SLICES = 64
#: Bits of the filter for each frequent phrase, and the most in all (64 MiB); with more phrases it lets more places through to be counted.
FILTER_BITS_EACH = 16
FILTER_BITS = 1 << 29
FILTER_BLOCK = 1 << 19
#: Parts in which the best phrases of a language are ranked first.
RANK_PARTS = 64


@dataclass(frozen=True)
class Options:
    longest: int = 5
    #: Least occurrences of a phrase.
    least: int = 100
    #: A phrase goes if a longer one has at least this percent of its occurrences.
    subsumed_percent: int = 100
    top: int = 2000

    def __post_init__(self):
        if self.longest < 2 or self.least < 1 or self.top < 1 or not 0 < self.subsumed_percent <= 100:
            raise ValueError(f"out of range: {self}")


class _Codes(dict):
    """Codes of a language's words in a block; new words get the block's next code."""

    def __init__(self, lang: str, langs: list[str], words: list[bytes]):
        super().__init__({_END: 0})
        self.lang, self.langs, self.words = lang, langs, words

    def __missing__(self, word: bytes) -> int:
        self.langs.append(self.lang)
        self.words.append(word)
        code = self[word] = len(self.words)
        return code


def _cut(data: bytes) -> Iterator[list[bytes]]:
    """Words and piece ends of a folded text, about ``PART_BYTES`` at a time."""
    first = 0
    while first < len(data):
        last = first + PART_BYTES
        last = len(data) if last >= len(data) else data.find(b" ", last)
        last = len(data) if last < 0 else last
        yield data[first:last].replace(_END, b" \xff ").split()
        first = last


def coded(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Blocks of whole texts: langs, words and counts of the block's dictionary, and codes (little-endian 32-bit, 0 between pieces)."""
    source = docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang_"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text_")
    )

    def block(langs: list[str], words: list[bytes], codes: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate(codes)
        columns = [
            pa.array([langs], pa.list_(pa.string())),
            pa.array([[w.decode("utf-8") for w in words]], pa.list_(pa.string())),
            pa.array([np.bincount(every, minlength=len(words) + 1)[1:].tolist()], pa.list_(pa.int64())),
            pa.array([every.astype("<u4").tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["langs", "words", "counts", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, words, codes, of, held = [], [], [], {}, 0
        for batch in batches:
            for part in stretches(batch, "text_"):
                together: dict[str, list[bytes]] = {}
                for tongue, body in zip(part.column("lang_").to_pylist(), part.column("text_").cast(pa.binary()).to_pylist()):
                    together.setdefault(tongue, []).append(body)
                for tongue, bodies in together.items():
                    own = of.get(tongue) or of.setdefault(tongue, _Codes(tongue, langs, words))
                    for tokens in _cut(_END.join(b.lower().translate(_TABLE) for b in bodies)):
                        codes.append(np.fromiter(map(own.__getitem__, tokens), dtype=np.uint32, count=len(tokens)))
                        held += len(tokens)
                    codes.append(np.zeros(1, dtype=np.uint32))
                if held >= BLOCK_WORDS or len(words) >= BLOCK_TERMS:
                    yield block(langs, words, codes)
                    langs, words, codes, of, held = [], [], [], {}, 0
        if held:
            yield block(langs, words, codes)

    return source.mapInArrow(run, "langs array<string>, words array<string>, counts array<long>, codes binary")


def word_counts(blocks: DataFrame) -> DataFrame:
    """(lang, word, f): the stripe of the empty prefix, merged."""
    entries = blocks.select(F.explode(F.arrays_zip("langs", "words", "counts")).alias("e"))
    return entries.groupBy(F.col("e.langs").alias("lang"), F.col("e.words").alias("word")).agg(F.sum("e.counts").alias("f"))


def _word_hash(lang, word, seed: int):
    return F.xxhash64(lang, word, F.lit(seed))


def _seed(counts: DataFrame) -> int:
    """A seed under which no two words of the vocabulary share a hash."""
    for seed in range(20):
        clash = counts.groupBy(_word_hash(F.col("lang"), F.col("word"), seed).alias("h")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if clash.isEmpty():
            return seed
    raise RuntimeError("no seed tells all words apart")


def _slots(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for k in range(2):
        yield mixed(keys + np.uint64(BASES[k])) & np.uint64(bits - 1)


def _filter(keys: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter of the column ``key``, put together in blocks; its size is bounded by ``FILTER_BITS``."""
    bits = FILTER_BLOCK
    while bits < min(FILTER_BITS, FILTER_BITS_EACH * count):
        bits *= 2

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column("key")).astype(np.int64).view(np.uint64)
            every = np.unique(np.concatenate(list(_slots(own, bits))))
            block, first = np.unique(every // FILTER_BLOCK, return_index=True)
            data = [(x % FILTER_BLOCK).astype("<u4").tobytes() for x in np.split(every, first[1:])] if len(every) else []
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int64)), pa.array(data, pa.binary())], ["block", "data"])

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, on = None, np.zeros(FILTER_BLOCK, dtype=bool)
        closed = lambda: pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([np.packbits(on).tobytes()], pa.binary())], ["block", "data"])
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                if block != current:
                    if current is not None:
                        yield closed()
                    current = block
                    on[:] = False
                on[np.frombuffer(data, dtype="<u4")] = True
        if current is not None:
            yield closed()

    schema = "block long, data binary"
    blocks = keys.select("key").mapInArrow(positions, schema).repartition("block").sortWithinPartitions("block").mapInArrow(united, schema)
    out = np.zeros((bits // FILTER_BLOCK, FILTER_BLOCK // 8), dtype=np.uint8)
    for block, data in blocks.toLocalIterator():
        out[block] = np.frombuffer(data, dtype=np.uint8)
    return out.ravel()


def _passed(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), dtype=bool)
    for at in _slots(keys, len(bloom) * 8):
        out &= (bloom[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1
    return out


def _extended(prefix: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of their prefixes and last words."""
    return mixed(prefix * np.uint64(BASES[0]) + last)


class _Stripes:
    """Stripes of one task: takes places (hash of the prefix, hash of the next word), gives rows (bucket, data)."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.size = buckets, [], 0

    def add(self, prefix: np.ndarray, last: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(_summed([(prefix, last, np.ones(len(prefix), dtype=np.uint64))]))
        self.size += len(self.held[-1][0])
        if self.size >= FLUSH:  # what equal entries leave room for is filled up before it is sent
            self.held = [_summed(self.held)]
            self.size = len(self.held[0][0])
            if self.size >= FLUSH // 2:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        prefix, last, times = _summed(self.held) if len(self.held) > 1 else self.held.pop()
        self.size = 0
        bucket = mixed(prefix + np.uint64(BASES[1]) * (last % np.uint64(SLICES)))
        bucket = ((bucket >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        prefix = prefix[order]
        last = last[order]
        times = times[order]
        used, first = np.unique(bucket[order], return_index=True)
        del bucket, order
        data, at, size = [], 0, 0
        for i, (a, b) in enumerate(zip(first, np.append(first[1:], len(prefix)))):
            data.append(_written(prefix[a:b], last[a:b], times[a:b]))
            size += len(data[-1])
            if size >= SENT_BYTES or i == len(used) - 1:
                yield pa.RecordBatch.from_arrays([pa.array(used[at : i + 1], pa.int64()), pa.array(data, pa.binary())], ["bucket", "data"])
                data, at, size = [], i + 1, 0


def _summed(held: list) -> list[np.ndarray]:
    """Equal entries of ``held``, which is emptied, added up in order of prefix and next word; columns are put in order one after the other."""
    columns = [list(c) for c in zip(*held)]
    held.clear()
    for i, parts in enumerate(columns):
        columns[i] = np.concatenate(parts)
        parts.clear()
    if not len(columns[0]):
        return columns
    order = np.lexsort((columns[1], columns[0]))
    for i in range(3):
        columns[i] = columns[i][order]
    del order
    prefix, last, times = columns
    first = np.flatnonzero(np.append(True, (prefix[1:] != prefix[:-1]) | (last[1:] != last[:-1])))
    return [prefix[first], last[first], np.add.reduceat(times, first)]


def _written(prefix: np.ndarray, last: np.ndarray, times: np.ndarray) -> bytes:
    """Stripes as bytes: their number, their prefixes and lengths, then next words and counts (counts as planes of bytes, which are mostly zero)."""
    first = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
    lengths = np.diff(np.append(first, len(prefix))).astype("<u4")
    planes = np.ascontiguousarray(times.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return len(first).to_bytes(8, "little") + prefix[first].tobytes() + lengths.tobytes() + last.tobytes() + planes.tobytes()


def _read(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    prefix = np.repeat(np.frombuffer(data, "<u8", n, 8), np.frombuffer(data, "<u4", n, 8 + 8 * n))
    at, m = 8 + 12 * n, len(prefix)
    planes = np.frombuffer(data, np.uint8, 8 * m, at + 8 * m).reshape(8, m).T
    return prefix, np.frombuffer(data, "<u8", m, at), np.ascontiguousarray(planes).view("<u8").ravel()


def entries(hashed: DataFrame, size: int, words, bloom, least: int, buckets: int) -> DataFrame:
    """(prefix, next, key, f): phrases of ``size`` words that occur ``least`` times, as prefix and next word.

    ``hashed`` has the dictionary's hashes and the codes of each block; ``words`` and ``bloom`` are the filters (broadcast) of frequent words and of frequent
    phrases of one word less.
    """

    def stretch(code: np.ndarray, own: np.ndarray, usable: np.ndarray, stripes: _Stripes) -> Iterator[pa.RecordBatch]:
        n = len(code) - size + 2  # places where a prefix fits
        if n <= 1:
            return
        on, word = usable[code], own[code]
        whole = on[:n].copy()
        for j in range(1, size - 1):
            whole &= on[j : j + n]
        at = np.flatnonzero(whole)
        key = word[at]
        for j in range(1, size - 1):
            key = _extended(key, word[at + j])
        if size > 2:
            stay = _passed(bloom.value, key)
            at, key = at[stay], key[stay]
        # The phrase behind the first word must be frequent too: it is the prefix of the next place.
        follows = np.flatnonzero(at[1:] == at[:-1] + 1) if len(at) else at
        if len(follows):
            yield from stripes.add(key[follows], word[at[follows] + size - 1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes, least_words = _Stripes(buckets), words.value
        for batch in batches:
            for hashes, codes in zip(batch.column("hashes"), batch.column("codes")):
                own = np.append(np.int64(0), hashes.values.to_numpy(zero_copy_only=False)).view(np.uint64)
                usable = _passed(least_words, own)
                usable[0] = False
                every = np.frombuffer(codes.as_buffer(), dtype="<u4")
                # A stretch has a place more than it counts, which tells whether its last one has a follower.
                for start in range(0, len(every), STRETCH):
                    yield from stretch(every[start : start + STRETCH + size - 1], own, usable, stripes)
        yield from stripes.flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, size_ = None, [], 0

        def closed() -> pa.RecordBatch:
            prefix, last, times = _summed(held)
            stay = times >= least
            prefix, last, times = prefix[stay], last[stay], times[stay]
            columns = [prefix.view(np.int64), last.view(np.int64), _extended(prefix, last).view(np.int64), times.astype(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["prefix", "next", "key", "f"])

        for batch in batches:
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data")):
                if bucket != current:
                    if held:
                        yield closed()
                    current, held, size_ = bucket, [], 0
                held.append(_read(data.as_buffer().to_pybytes()))
                size_ += len(held[-1][0])
                if size_ >= FLUSH:  # rows of one bucket from very many tasks are added up in between
                    held = [_summed(held)]
                    size_ = len(held[0][0]) // 2
        if held:
            yield closed()

    sent = hashed.mapInArrow(count, "bucket long, data binary")
    tasks = max(int(hashed.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // 4)
    together = sent.repartition(tasks, "bucket").sortWithinPartitions("bucket")
    return together.mapInArrow(merge, "prefix long, next long, key long, f long")


def phrases(blocks: DataFrame, counts: DataFrame, options: Options) -> tuple[list[DataFrame], int]:
    """Tables of frequent phrases of 1 to ``longest`` words, and the seed of the word hashes.

    Columns: lang, key (hash), words (hashes), f, firsts (counts of the first 1, 2, .. words) and rests (counts of what is left of the phrase then).
    """
    spark = blocks.sparkSession
    seed = _seed(counts)
    hash_ = _word_hash(F.col("lang"), F.col("word"), seed)
    none = F.array().cast("array<long>")
    first = counts.filter(F.col("f") >= options.least).select("lang", hash_.alias("key"), F.array(hash_).alias("words"), "f", none.alias("firsts"), none.alias("rests"))
    tables = [save(first, "phrases_1")]
    hashed = blocks.select(F.transform(F.arrays_zip("langs", "words"), lambda z: _word_hash(z.langs, z.words, seed)).alias("hashes"), "codes")
    total = counts.agg(F.sum("f")).first()[0] or 0
    buckets = max(64, total // BUCKET_WORDS)
    held = []
    for size in range(2, options.longest + 1):
        before = tables[-1]
        n = before.count()
        if not n:
            break
        held.append(spark.sparkContext.broadcast(_filter(before, n)))
        found = save(entries(hashed, size, held[0], held[-1], options.least, buckets), f"stripes_{size}")
        prefix = before.select(F.col("key").alias("prefix"), "lang", F.col("words").alias("head"), F.col("f").alias("of_head"), F.col("firsts").alias("firsts_"))
        tail = before.select(F.col("words").alias("tail"), F.col("f").alias("of_tail"), F.col("rests").alias("rests_"))
        whole = found.join(broadcast_measured(prefix), "prefix").withColumn("words", F.concat("head", F.array("next")))
        whole = whole.withColumn("tail", F.slice("words", 2, size - 1)).join(broadcast_measured(tail), "tail")
        tables.append(
            save(
                whole.select(
                    "lang", "key", "words", "f",
                    F.concat("firsts_", F.array("of_head")).alias("firsts"), F.concat(F.array("of_tail"), "rests_").alias("rests"),
                ),
                f"phrases_{size}",
            )
        )
        if len(held) > 1:
            held.pop().unpersist()
    for b in held:
        b.unpersist()
    return tables, seed


def _subsumed(tables: list[DataFrame], size: int) -> DataFrame | None:
    """(words, longest_f): for phrases of ``size`` words, the most that one with one word more occurs."""
    if size >= len(tables):
        return None
    longer = tables[size]
    both = longer.select(F.slice("words", 1, size).alias("words"), "f").unionByName(longer.select(F.slice("words", 2, size).alias("words"), "f"))
    return both.groupBy("words").agg(F.max("f").alias("longer_f"))


def scored(tables: list[DataFrame], totals: DataFrame, options: Options) -> DataFrame:
    """(lang, words, a, l, r, n, score) of every candidate that no longer one makes superfluous."""
    out = None
    for size in range(2, len(tables) + 1):
        own = tables[size - 1].select("lang", "words", F.col("f").alias("a"), "firsts", "rests")
        longer = _subsumed(tables, size)
        if longer is not None:
            own = own.join(longer, "words", "left").filter(
                F.col("longer_f").isNull() | (100 * F.col("longer_f") < options.subsumed_percent * F.col("a"))
            )
            own = own.drop("longer_f")
        out = own if out is None else out.unionByName(own)
    out = out.join(broadcast_measured(totals), "lang")
    whole = "decimal(19,0)"
    scores = F.expr(
        f"transform(arrays_zip(firsts, rests), z -> (1000 * cast(a as {whole}) * cast(n as {whole})) div (cast(z.firsts as {whole}) * cast(z.rests as {whole})))"
    )
    out = out.withColumn("scores", scores).withColumn("score", F.array_min("scores")).withColumn("cut", F.array_position("scores", F.col("score")).cast("int"))
    return out.select("lang", "words", "a", F.element_at("firsts", F.col("cut")).alias("l"), F.element_at("rests", F.col("cut")).alias("r"), "n", "score")


def _best(df: DataFrame, order: str, top: int) -> DataFrame:
    """The first ``top`` rows of every language: first within parts, then among their winners."""
    part = df.withColumn("part_", F.pmod(F.xxhash64("words"), F.lit(RANK_PARTS)))
    part = part.withColumn("rank", F.expr(f"row_number() over (partition by lang, part_ order by {order})")).filter(F.col("rank") <= top)
    return part.withColumn("rank", F.expr(f"row_number() over (partition by lang order by {order})").cast("long")).filter(F.col("rank") <= top).drop("part_")


def mined(docs: DataFrame, options: Options = Options(), text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of every language, by score, occurrences and bytes of the phrase.

    a, l and r count the phrase and the two parts of its weakest cut, n all words of the language; score is 1000 a n / (l r), rounded down.
    """
    schema = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
    blocks = save(coded(docs, text, lang), "blocks", FILE_BLOCKS)
    counts = save(word_counts(blocks), "word_counts")
    tables, seed = phrases(blocks, counts, options)
    if len(tables) < 2:
        return docs.sparkSession.createDataFrame([], schema)
    totals = save(counts.groupBy("lang").agg(F.sum("f").alias("n")), "word_totals")
    found = save(scored(tables, totals, options), "collocations")
    worst = _best(found.select("lang", "words", "score", "a"), "score desc, a desc", options.top).groupBy("lang").agg(
        F.min(F.struct("score", "a")).alias("least_")
    )
    among = found.join(broadcast_measured(save(worst, "least_scores")), "lang").filter(F.struct("score", "a") >= F.col("least_")).drop("least_")
    named = counts.filter(F.col("f") >= options.least).select(_word_hash(F.col("lang"), F.col("word"), seed).alias("word_hash"), "word")
    spelled = among.select("*", F.posexplode("words").alias("at", "word_hash")).join(broadcast_measured(named), "word_hash")
    spelled = spelled.groupBy("lang", "words", "a", "l", "r", "n", "score").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelled"))
    spelled = spelled.withColumn("phrase", F.array_join(F.transform("spelled", lambda s: s.word), " "))
    return _best(spelled, "score desc, a desc, phrase", options.top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
