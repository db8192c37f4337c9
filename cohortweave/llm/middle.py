"""Fill-in-the-middle: documents are cut at two token boundaries and put together anew.

Every code point gets a class: inside of a word, end of a word, blank, line feed. The classes of many texts form one wavelet matrix:
a bit vector for each bit of the class, each stably sorted by the bit before, with counts of set bits by words of 64. Rank queries
(how many code points of a class before a place) take one step per bit. The number of boundaries before a place is a sum of such ranks, and
the place of the k-th boundary of a text is found by bisection on ranks, for all cuts of all texts at once.

A unit is a word with the blanks before it (blanks at the end of a text are one more), a line with its line feed, or a code point.

Defined cases: null text counts as empty; empty texts, texts that hold a mark, and those that the draw leaves out stay as they are
(form ``plain``); a null id draws like an empty one; repeated rows are cut alike, as the draw hangs on the id alone; an empty table gives an empty
result; texts are handled in blocks of about ``BLOCK_BYTES`` bytes, a longer text alone; columns of the caller are carried in a struct.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stretches

#: Bytes of the texts whose wavelet matrix is in memory at once.
BLOCK_BYTES = 2_000_000

INSIDE, WORD_END, BLANK, LINE_FEED = range(4)
#: For each unit: the classes whose code points end one.
ENDS = {"word": (WORD_END,), "line": (LINE_FEED,), "char": (INSIDE, WORD_END, BLANK, LINE_FEED)}


@dataclass(frozen=True)
class Options:
    seed: int = 42
    unit: str = "word"
    #: Percent of documents that are rearranged, and of these the percent with the suffix first.
    rate: int = 50
    suffix_first: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        if self.unit not in ENDS:
            raise ValueError(f"unit is one of {', '.join(ENDS)}, not {self.unit}")
        if not (self.prefix and self.suffix and self.middle) or len({self.prefix, self.suffix, self.middle}) < 3:
            raise ValueError("the three marks must differ and not be empty")


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) + 64) // 64 * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Ranks of symbols below 2**bits."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.size = bits, len(symbols)
        self.levels: list[tuple[Bits, int]] = []
        for level in reversed(range(bits)):
            on = (symbols >> level) & 1
            self.levels.append((Bits(on), len(on) - int(on.sum())))
            symbols = np.concatenate((symbols[on == 0], symbols[on == 1]))

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before each place."""
        first, last = np.zeros_like(at), at
        for level, (vector, zeros) in zip(reversed(range(self.bits)), self.levels):
            if symbol >> level & 1:
                first, last = zeros + vector.rank(first), zeros + vector.rank(last)
            else:
                first, last = first - vector.rank(first), last - vector.rank(last)
        return last - first


class Boundaries:
    """Unit boundaries of some texts, by ranks over the classes of their code points."""

    def __init__(self, texts: list[str], unit: str):
        self.lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.of_unit = ENDS[unit]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
        blank = (points == 32) | ((points >= 9) & (points <= 13))
        next_blank = np.append(blank[1:], True)
        full = self.lengths > 0
        if full.any():
            next_blank[self.ends[full] - 1] = True
        classes = np.where(blank, np.where(points == 10, LINE_FEED, BLANK), np.where(next_blank, WORD_END, INSIDE)).astype(np.uint8)
        self.matrix = WaveletMatrix(classes, 2)
        self.base = self.before(self.starts)
        whole = self.before(self.ends) - self.base
        last = np.full(len(texts), -1, dtype=np.int64)
        last[full] = classes[self.ends[full] - 1]
        self.rest = full & ~np.isin(last, self.of_unit)  # something follows the last boundary
        self.units = whole + self.rest

    def before(self, at: np.ndarray) -> np.ndarray:
        """Boundaries before each place in the joined texts: ranks of all classes that end a unit, summed."""
        return sum(self.matrix.rank(c, at) for c in self.of_unit)

    def after(self, units: np.ndarray) -> np.ndarray:
        """Code points of each text that its first so many units have (bisection on ranks)."""
        low, high = self.starts.copy(), self.ends.copy()
        want = self.base + units
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            enough = self.before(middle) >= want
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        return low - self.starts


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transformed(docs: DataFrame, options: Options = Options(), text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """``row_`` (columns ``keep``, all by default), n, form, prefix_chars, middle_chars and ``output``, the text put together anew.

    ``n`` counts units. ``spm`` is suffix, prefix, middle; ``psm`` is prefix, suffix, middle, each behind its mark.
    """
    keep = docs.columns if keep is None else keep
    marks = (options.prefix, options.suffix, options.middle)
    drawn = [h.alias(f"h{k + 1}") for k, h in enumerate(draws(F.col(f"`{doc_id}`"), options.seed))]
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row_")
    source = docs.select(row, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text_"), *drawn)
    fields = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())]
    schema = T.StructType([source.schema["row_"], *(T.StructField(n, t) for n, t in fields)])

    def put(body: str, form: str, first: int, second: int) -> str:
        if form == "plain":
            return body
        prefix, middle, suffix = body[:first], body[first:second], body[second:]
        p, s, m = marks
        return f"{p}{prefix}{s}{suffix}{m}{middle}" if form == "psm" else f"{s}{suffix}{p}{prefix}{m}{middle}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in stretches(batch, "text_", BLOCK_BYTES):
                texts = rows.column("text_").to_pylist()
                h = [np.asarray(rows.column(f"h{k}"), dtype=np.int64) for k in (1, 2, 3, 4)]
                own = Boundaries(texts, options.unit)
                cuts = h[0] % (own.units + 1), h[1] % (own.units + 1)
                first, second = own.after(np.minimum(*cuts)), own.after(np.maximum(*cuts))
                holds = np.fromiter((any(m in t for m in marks) for t in texts), dtype=bool, count=len(texts))
                plain = (own.lengths == 0) | holds | (h[2] % 100 >= options.rate)
                forms = np.where(plain, "plain", np.where(h[3] % 100 < options.suffix_first, "spm", "psm")).tolist()
                output = list(map(put, texts, forms, first.tolist(), second.tolist()))
                columns = [
                    rows.column("row_"),
                    pa.array(own.units, pa.int64()),
                    pa.array(forms, pa.string()),
                    pa.array(first, pa.int64(), mask=plain),
                    pa.array(second - first, pa.int64(), mask=plain),
                    pa.array(output, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return source.mapInArrow(run, schema)


def restored(output: Column, form: Column, options: Options = Options()) -> Column:
    """The text that an output was made of. Exact, as texts that hold a mark are never rearranged."""
    marks = "|".join("".join(f"\\x{{{ord(c):x}}}" for c in m) for m in (options.prefix, options.suffix, options.middle))
    parts = F.split(output, marks)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
