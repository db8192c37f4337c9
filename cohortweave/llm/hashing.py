"""Hashes of words and of runs of words, in arrays, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: A worker remembers the hashes of so many words at most.
REMEMBERED = 200_000

_MASK = (1 << 64) - 1
#: Odd multipliers (any would do).
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value
        return value


_WORDS = _Words()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits (a bijection on 64 bits)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


#: Which bytes separate words (as ``bytes.split`` has it), and masks that keep the first bytes of eight.
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
#: Words of more bytes are hashed one by one.
_LONG = 64


def split_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The number of words of each text, and the hashes of all words in order (not those of ``word_hashes``).

    Words are cut and hashed eight bytes at a time in arrays, for corpora whose words are too many to remember.
    """
    data = b"\n".join(texts) + bytes(b"\n" * (_LONG + 8))
    blank = _BLANK[np.frombuffer(data, dtype=np.uint8)]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    edges = edges if blank[0] else np.append(0, edges)
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    out = mixed((eight[starts] & _FIRST_BYTES[np.minimum(sizes, 8)]) ^ (sizes.astype(np.uint64) * np.uint64(BASES[0])))
    left, done = np.flatnonzero((sizes > 8) & (sizes <= _LONG)), 8
    while len(left):
        part = eight[starts[left] + done] & _FIRST_BYTES[np.minimum(sizes[left] - done, 8)]
        out[left] = mixed(out[left] * np.uint64(BASES[1]) + part)
        done += 8
        left = left[sizes[left] > done]
    for i in np.flatnonzero(sizes > _LONG):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + sizes[i]])
    return counts, out


def windows(hashes: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """One hash per run of ``size`` consecutive words; empty where there are fewer words.

    Runs are put together from runs of powers of two, so the work grows with the logarithm of ``size``.
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out, done, power, factor, part = np.zeros(n, dtype=np.uint64), 0, 1, BASES[which], hashes
    while True:
        if size & power:
            out += part[done : done + n] * np.uint64(pow(BASES[which], done, 1 << 64))
            done += power
        power *= 2
        if power > size:
            return mixed(out)
        part = part[: len(part) - power // 2] + part[power // 2 :] * np.uint64(factor)
        factor = factor * factor & _MASK


class Texts:
    """Words of some texts in one array, and the windows that lie within a text."""

    def __init__(self, texts: list[bytes], size: int):
        self.words = [t.split() for t in texts]
        self.counts = np.array([len(w) for w in self.words], dtype=np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.hashes = word_hashes([w for ws in self.words for w in ws])
        self.size = size
        left = np.repeat(self.starts + self.counts, self.counts) - np.arange(len(self.hashes))
        self.at = np.flatnonzero(left >= size)  # of windows, in the array of all words

    def windows(self, which: int = 0) -> np.ndarray:
        every = windows(self.hashes, self.size, which)
        return every[self.at] if len(self.at) else every[:0]

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts + self.counts, at, side="right")


def parts(texts: list[bytes], most: int = 2 << 20) -> list[slice]:
    """Slices of about ``most`` bytes of texts (one text at least)."""
    out, first, held = [], 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most:
            out.append(slice(first, i + 1))
            first, held = i + 1, 0
    if first < len(texts):
        out.append(slice(first, len(texts)))
    return out
