"""The rank queue against the public library, and exact round trips."""

import base64
import hashlib
import random

import public_tokenizers
import tiktoken

from cohortweave.llm import bpe
from cohortweave.llm.bpe_query import op3_rank_queue_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(content):
    return list(memoryview(content).cast("I"))


def test_encoder_equals_library():
    encoder, lib, rng = bpe.Encoder(open(PATH, "rb").read(), public_tokenizers.PATTERN), library(), random.Random(5)
    odd = ["", " ", "\n\n  \n", "a" * 3000, "ab" * 2500, "don't we'll I'm 's'", "\x1c\x1d\x85  x y", "naïve ½ ٣٤ 漢字かな 🙂🙂👩‍👩‍👧", "é" * 999, "==" * 700 + "x"]
    pool = "aabcdeéñ漢🙂 \n\t'.,123ſ٣ſ½\x1c 　"
    odd += ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 400))) for _ in range(400)]
    for text in odd:
        assert ids_of(encoder.encode(text)) == lib.encode_ordinary(text), repr(text)


def test_long_piece_is_not_quadratic():
    encoder, lib = bpe.Encoder(open(PATH, "rb").read(), public_tokenizers.PATTERN), library()
    rng = random.Random(1)
    piece = "".join(rng.choice("etaoinshr") for _ in range(60_000))
    assert encoder.merge(piece.encode()) == lib.encode_ordinary(piece)


def test_query_equals_library(spark, sf_dir):
    lib = library()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op3_rank_queue_bpe(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        ids = lib.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_nulls_repeats_and_clashing_names(spark):
    schema = "doc_id long, text string, ids string, row_ int, decoded_ int"
    df = spark.createDataFrame([(1, None, "x", 1, 2), (1, None, "x", 1, 2), (None, "ab ab", None, None, None), (3, "", "", 0, 0)], schema)
    out = bpe.decoded(bpe.encoded(df, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert sorted(bytes(r["decoded_"]) for r in out) == [b"", b"", b"", b"ab ab"]
    assert {r["row_"]["ids"] for r in out} == {"x", "", None}
    assert bpe.encoded(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
