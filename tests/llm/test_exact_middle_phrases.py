"""op11, op12 and op13 against brute force: nulls, ties, repeated rows, long texts, empty tables, clashing names."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortweave.llm import collocation, exact, middle

SCHEMA = "doc_id long, text string, lang string, row_ string, id_ string, n int, form string, word string, f int, key int, body_ string, place_ int"
AWKWARD = [(1, None), (2, ""), (3, " \n\t \x0b"), (4, "one"), (4, "one"), (4, "ONE"), (None, "One"), (None, None), (5, "É é 漢 🙂 " * 30), (6, "\x00 \x1c \x85 x " * 10)]


def docs(spark, rows):
    """Rows (doc_id, text[, lang]); the other columns clash with names that the operators use."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "r", "i", 1, "f", "w", 2, 3, "b", 4) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def fold(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


# exact copies


def brute_exact(rows, largest):
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[fold(r[1])].append(r[0])
    out = []
    for r in rows:
        ids = [i for i in groups[fold(r[1])] if i is not None]
        best = (max(ids) if largest else min(ids)) if ids else None
        out.append((r[0], best, len(groups[fold(r[1])]), hashlib.sha256(fold(r[1]).encode()).hexdigest()))
    return sorted(out, key=repr)


def exact_rows():
    rng = random.Random(1)
    pool = ["".join(rng.choice("aAbBéÉ ß") for _ in range(rng.randrange(0, 6))) for _ in range(60)]
    rows = AWKWARD + [(100 + i, rng.choice(pool)) for i in range(400)] + [(900 + i, "long " * 60_000 + rng.choice("xXy")) for i in range(6)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact(spark, keep):
    rows = exact_rows()
    got = exact.verdicts(docs(spark, rows), keep).select("row_.doc_id", "keep_id", "group_size", "text_sha256", "kept", "row_.text").collect()
    assert sorted((tuple(r[:4]) for r in got), key=repr) == brute_exact(rows, keep == "largest")
    kept = [r for r in got if r["kept"]]
    assert Counter(fold(r["text"]) for r in kept) == Counter({fold(r[1]) for r in rows})
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_exact_tells_collisions_apart(spark, bits):
    """With hashes of a few bits nearly all groups collide; the bytes decide."""
    rows = exact_rows()
    few = lambda digest: F.substring(F.hex(digest), 1, bits)
    got = exact.verdicts(docs(spark, rows), hashed=few, cheap=lambda text: F.lit(0).cast("long"))
    got = got.select("row_.doc_id", "keep_id", "group_size", "text_sha256", "kept").collect()
    assert sorted((tuple(r[:4]) for r in got), key=repr) == brute_exact(rows, False)
    assert sum(r["kept"] for r in got) == len({fold(r[1]) for r in rows})


def test_exact_hot_groups_and_large_sides(spark, monkeypatch):
    rows = [(i, "Copy" if i % 3 == 0 else f"text {i // 2}") for i in range(3000)]
    monkeypatch.setattr(exact, "HOT_ROWS", 100)
    monkeypatch.setattr("cohortweave.llm.common.BROADCAST_BYTES", 0)
    got = exact.verdicts(docs(spark, rows)).select("row_.doc_id", "keep_id", "group_size", "text_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_exact(rows, False)


def test_exact_documents_and_empty(spark):
    table = docs(spark, AWKWARD)
    out = exact.deduplicated(table)
    assert out.columns == table.columns and out.count() == len({fold(r[1]) for r in AWKWARD})
    assert exact.verdicts(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        exact.deduplicated(table, keep="first")


# fill-in-the-middle

TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_middle(doc_id, text, o=middle.Options()):
    text = text or ""
    tokens = {"word": TOKENS.findall(text), "char": list(text), "line": re.findall(r"[^\n]*\n|[^\n]+", text)}[o.unit]
    digest = hashlib.sha256(f"{o.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in (o.prefix, o.suffix, o.middle)) or h[2] % 100 >= o.rate:
        return n, "plain", None, None, text
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < o.suffix_first:
        return n, "spm", len(p), len(m), f"{o.suffix}{s}{o.prefix}{p}{o.middle}{m}"
    return n, "psm", len(p), len(m), f"{o.prefix}{p}{o.suffix}{s}{o.middle}{m}"


def middle_rows():
    rng = random.Random(5)
    chars = "ab é漢🙂\n\t\r  \x0b\x1c "
    rows = AWKWARD + [(100 + i, "".join(rng.choice(chars) for _ in range(rng.randrange(0, 90)))) for i in range(300)]
    rows += [(500 + i, f"a <{c}> b c d") for i in range(5) for c in "PSM"] + [(600 + i, "a <p> < P> b") for i in range(4)]
    rows += [(700 + i, "".join(rng.choice(chars) for _ in range(300_000))) for i in range(4)] + [(710, "x" * 200_000), (711, " " * 200_000)]
    return rows


@pytest.mark.parametrize(
    "options",
    [middle.Options(), middle.Options(rate=100), middle.Options(rate=100, suffix_first=0, unit="char", seed=7), middle.Options(rate=100, unit="line", prefix="(*)", suffix="\\", middle="$|")],
)
def test_middle(spark, options, monkeypatch):
    monkeypatch.setattr(middle, "BLOCK_BYTES", 10_000)
    rows = middle_rows()
    out = middle.transformed(docs(spark, rows), options)
    out = out.select("row_.doc_id", "row_.text", "n", "form", "prefix_chars", "middle_chars", "output", middle.restored(F.col("output"), F.col("form"), options).alias("restored"))
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[2:7]) == brute_middle(r["doc_id"], r["text"], options)
        assert r["restored"] == (r["text"] or "")
    assert len({r["form"] for r in got}) >= 2


def test_middle_empty_and_options(spark):
    assert middle.transformed(docs(spark, [])).count() == 0
    for wrong in ({"unit": "page"}, {"prefix": ""}, {"prefix": "<S>"}):
        with pytest.raises(ValueError):
            middle.Options(**wrong)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 7), max_size=300))
def test_wavelet_ranks(symbols):
    matrix = middle.WaveletMatrix(np.array(symbols, dtype=np.uint8), 3)
    at = np.arange(len(symbols) + 1)
    for s in range(8):
        assert matrix.rank(s, at).tolist() == [symbols[:i].count(s) for i in at]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té漢", max_size=40), min_size=1, max_size=6))
def test_boundaries(texts):
    own = middle.Boundaries(texts, "word")
    cuts = [TOKENS.findall(t) for t in texts]
    assert own.units.tolist() == [len(c) for c in cuts]
    for k in range(max(map(len, cuts)) + 1):
        units = np.array([min(k, len(c)) for c in cuts])
        assert own.after(units).tolist() == [len("".join(c[:k])) for c in cuts]


# phrases


def brute_phrases(rows, o):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", fold(text)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for k in range(1, o.longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= o.least}
        most = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    most[p[i : i + k]] = max(most[p[i : i + k]], a)
        rated = []
        for p, a in found.items():
            if p in most and 100 * most[p] >= o.subsumed_percent * a:
                continue
            score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rated.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (s, a, phrase, left, right) in enumerate(sorted(rated)[: o.top]):
            out.append((lang, i + 1, phrase.decode(), -a, left, right, total[lang], -s))
    return sorted(out, key=repr)


def phrase_rows():
    rng = random.Random(9)
    pool = ["the", "The", "of", "é", "É", "漢", "a-b", "x\x1cy", "\x85", "new", "york", "city", "hall"]
    ends = [" "] * 12 + ["\t", ". ", ",", "\n", "\x0b", "!?", " ; "]
    text = lambda n: "".join(rng.choice(pool) + rng.choice(ends) for _ in range(n))
    rows = [(i, text(rng.randrange(0, 60)), rng.choice(["en", "de", None, "", "und"])) for i in range(300)]
    rows += [(900, "new york city hall and so on again " * 3000, "en"), (901, "a b a b a " * 40, "xx"), (902, "a a a a a a a a a " * 9, "yy"), (903, text(40_000), "fr")]
    return rows + [r[:2] + ("en",) for r in AWKWARD]


@pytest.mark.parametrize(
    "options", [collocation.Options(least=5), collocation.Options(least=3, top=7), collocation.Options(longest=3, least=4, subsumed_percent=60), collocation.Options(longest=7, least=20, top=100000)]
)
def test_phrases(spark, options, monkeypatch):
    monkeypatch.setattr(collocation, "BLOCK_WORDS", 5_000)
    monkeypatch.setattr(collocation, "PART_BYTES", 1_000)
    monkeypatch.setattr(collocation, "FLUSH", 2_000)
    rows = phrase_rows()
    got = sorted(map(tuple, collocation.mined(docs(spark, rows), options).collect()), key=repr)
    assert got == brute_phrases(rows, options)


def test_phrases_do_not_hang_on_the_filter(spark, monkeypatch):
    """A filter that lets everything through, and sides too large for a broadcast."""
    monkeypatch.setattr(collocation, "_passed", lambda bloom, keys: np.ones(len(keys), dtype=bool))
    monkeypatch.setattr("cohortweave.llm.common.BROADCAST_BYTES", 0)
    rows, options = phrase_rows()[:120], collocation.Options(least=5)
    got = sorted(map(tuple, collocation.mined(docs(spark, rows), options).collect()), key=repr)
    assert got == brute_phrases(rows, options)


def test_phrase_words_with_one_hash_are_hashed_anew(spark, monkeypatch):
    real = collocation._word_hash
    monkeypatch.setattr(collocation, "_word_hash", lambda lang, word, seed: F.length(word).cast("long") if seed == 0 else real(lang, word, seed))
    rows, options = phrase_rows()[:60], collocation.Options(least=5)
    got = sorted(map(tuple, collocation.mined(docs(spark, rows), options).collect()), key=repr)
    assert got and got == brute_phrases(rows, options)


def test_exact_scores_beyond_64_bits(spark):
    tables = [None, spark.createDataFrame([("en", [1, 2], 3 * 10**15, [4 * 10**15], [5 * 10**15])], "lang string, words array<long>, f long, firsts array<long>, rests array<long>")]
    totals = spark.createDataFrame([("en", 9 * 10**17 + 7)], "lang string, n long")
    row = collocation.scored(tables, totals, collocation.Options()).first()
    assert row["score"] == 1000 * 3 * 10**15 * (9 * 10**17 + 7) // (20 * 10**30)


def test_phrases_of_nothing(spark):
    assert collocation.mined(docs(spark, [])).count() == 0
    assert collocation.mined(docs(spark, AWKWARD)).count() == 0
    with pytest.raises(ValueError):
        collocation.Options(longest=1)


def test_stripes_are_sent_in_little_memory():
    """1.44 million different entries of 24 bytes: their columns are put in order one after the other and sent in parts."""
    import tracemalloc

    rng = np.random.default_rng(1)
    parts = [tuple(rng.integers(0, 2**63, 240_000).astype(np.uint64) for _ in range(2)) for _ in range(6)]
    tracemalloc.start()
    try:
        stripes, rows = collocation._Stripes(64), []
        for prefix, last in parts:
            rows += [len(x) for x in stripes.add(prefix, last)]
        for x in stripes.flush():
            rows.append(sum(len(collocation._read(data.as_py())[0]) for data in x.column("data")))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(rows) == 6 * 240_000 and peak < 110_000_000
