"""Packing against its contract, checked piece by piece with the tokenizers library."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cohortweave.llm import packing
from cohortweave.llm.packing_query import VOCABULARY, op1_cutting_stock, packed


def check(rows, texts, capacity=1024):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        of_doc[r["doc_id"]].append(r)
        of_sequence[r["sequence_id"]].append(r)
    assert set(of_doc) == set(texts)
    for doc, text in texts.items():
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for r in sorted(of_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for members in of_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
        padding += capacity - at
    return padding, len(of_sequence)


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    padding, sequences = check(op1_cutting_stock(spark, sf_dir).collect(), texts)
    assert padding <= 1024 + 4 * sequences


def test_awkward_lengths(spark):
    # Remainders of which no two fit together: patterns are laid end to end and cut.
    texts = {i: " the" * (600 + i % 3) for i in range(60)} | {100: None, 101: "", 102: "漢字 \x00 🙂", 103: " of" * 1023, 104: " of" * 5000}
    df = spark.createDataFrame([(k, v, 1, 2) for k, v in texts.items()], "doc_id long, text string, offset int, row_ int")
    padding, sequences = check(packed(df.repartition(5)).collect(), texts)
    assert padding <= 1024 + 4 * sequences
    assert packed(df.limit(0)).count() == 0
    assert packed(df.filter("doc_id = 100")).count() == 1
    assert packed(df.filter("doc_id = 104").unionAll(df.filter("doc_id = 104"))).count() >= 10


def test_plan_places_every_rank_once():
    rng = np.random.default_rng(3)
    histogram = {int(s): int(n) for s, n in zip(rng.choice(np.arange(1, 128), 60, replace=False), rng.integers(1, 400, 60))}
    p = packing.plan(histogram, 128, 2)
    used = defaultdict(list)
    for size, n in histogram.items():
        sequence, offset = packing.place(p, np.full(n, size), np.arange(n), 128)
        for s, o in zip(sequence, offset):
            used[int(s)].append((int(o), size))
    overrun = 0
    for s in range(p.sequences + -(-p.stream // 128)):
        at = overrun
        for o, size in sorted(used[s]):
            assert o == at
            at += size
        overrun = max(0, at - 128)
        assert s >= p.sequences or overrun == 0


def test_column_generation_reaches_the_bound():
    sizes, demand = np.array([30, 45, 70]), np.array([100.0, 80.0, 60.0])
    patterns, use = packing.column_generation(sizes, demand, 100, gap=1e-9)
    assert np.allclose(use @ patterns, demand)
    assert abs(use.sum() - (60 + (80 * 45 - 0) / 90 + 40 / 3)) < 1e-6


def test_added_tokens_are_found_in_texts(spark):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [f"a document {end} the next", end, f"{end}{end} x", f"it's{end}'s  {end}  \n{end}", "<|endoftext| > <|endoftext|", f"<|endo{end}ftext|>", f"漢{end}字 " * 900]
    got = packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for doc, text in enumerate(texts):
        ids = np.array([*lib.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        of_doc = [r for r in got if r["doc_id"] == doc]
        assert sum(r["length"] for r in of_doc) == len(ids)
        for r in of_doc:
            assert r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
