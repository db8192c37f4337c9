"""Words of lines cut and hashed in arrays, and what the second round of the line join posts."""

import random

import numpy as np
from pyspark.sql import functions as F

from cohortweave.llm import hashing, lines

PIECES = ["a", "a\0", "é漢", "\x1c\x85", "x" * 7, "x" * 8, "x" * 9, "y" * 16, "y" * 17, "z" * 64, "z" * 65, "ab" * 900, "ab" * 899 + "ba"]


def odd_lines():
    rng, blanks = random.Random(3), [" ", "\t", "\x0b", "\x0c", "\r", "  "]
    pool = PIECES + [f"w{i}" for i in range(40)]
    out = ["", " ", "\t a", *PIECES]
    out += ["".join(rng.choice(blanks) + rng.choice(pool) for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    return [x.encode() for x in out]


def test_words_are_cut_and_told_apart():
    bodies = odd_lines()
    counts, hashes = hashing.split_hashes(bodies)
    assert counts.tolist() == [len(b.split()) for b in bodies]
    known = {}
    for word, h in zip((w for b in bodies for w in b.split()), hashes.tolist()):
        assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)
    assert [len(x) for x in hashing.split_hashes([])] == [0, 0]


def test_sets_of_lines_also_when_words_share_a_key(monkeypatch):
    bodies, rarity = odd_lines(), np.random.default_rng(1).integers(0, 9, (2, lines.WORD_SLOTS)).astype(np.uint8)
    plain = hashing.split_hashes

    def check():
        line, word = plain(bodies)
        line = np.repeat(np.arange(len(bodies)), line)
        word = hashing.split_hashes(bodies)[1]
        want = sorted(set(zip(line.tolist(), word.tolist())))
        assert list(zip(*(x.tolist() for x in lines.line_sets(bodies)))) == want
        level = dict(zip(word.tolist(), lines.levels(rarity, word).tolist()))
        assert list(zip(*(x.tolist() for x in lines.ranked_sets(bodies, rarity)))) == sorted(want, key=lambda x: (x[0], level[x[1]], x[1]))

    check()
    # Words told apart by their last two bits only.
    monkeypatch.setattr(hashing, "split_hashes", lambda b: (lambda c, w: (c, w & np.uint64(3)))(*plain(b)))
    check()


def test_second_round_posts_words_of_open_lines_only(spark, monkeypatch):
    monkeypatch.setattr(lines, "AT_ONCE", 1)
    rng, posted, plain = random.Random(1), [], lines._postings

    def counted(*args):
        out = plain(*args)
        posted.append(out.agg(F.sum(F.length("data"))).first()[0] // lines.ENTRY.itemsize)
        return out

    monkeypatch.setattr(lines, "_postings", counted)
    rows = [(i, 0, "\n".join(" ".join(f"w{rng.randrange(600)}" for _ in range(20)) for _ in range(20))) for i in range(40)]
    # Too long for the signature to tell apart: the last of the three has two candidates, and neither matches.
    shared = [f"s{i}" for i in range(800)]
    rows += [(100 + k, 0, " ".join(shared + [f"w{i}" for i in range(200 * k, 200 * k + 200)])) for k in range(3)]
    gone = lines.repeats(spark.createDataFrame(rows, "id_ long, sub_ long, text_ string")).collect()
    assert gone == []
    assert len(posted) == 2 and posted[1] * 4 < posted[0]
