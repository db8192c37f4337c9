"""Many pieces in one queue."""

import base64
import random

import public_tokenizers
import pytest
import tiktoken

from cohortweave.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def given():
    return open(PATH, "rb").read()


def shuffled():
    """A vocabulary in which a token may come before the tokens that it can be put together from."""
    rng = random.Random(4)
    longer = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 7))) for _ in range(300)})
    rng.shuffle(longer)
    tokens = [bytes((b,)) for b in range(256)] + longer
    return b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens))


@pytest.mark.parametrize("in_arrays", [0, 3, 10**9])
@pytest.mark.parametrize("content, pool", [(given, "aabcdeéñ漢🙂='\0 \n"), (shuffled, "abc"), (shuffled, "aab\0")])
def test_many_pieces_equal_library(content, pool, in_arrays, monkeypatch):
    monkeypatch.setattr(bpe, "IN_ARRAYS", in_arrays)
    content, rng = content(), random.Random(7)
    encoder = bpe.Encoder(content, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=bpe.read_ranks(content), special_tokens={})
    pieces = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 40))) for _ in range(500)] + ["a" * n for n in range(1, 49)]
    # A piece that is a token is looked up before the queue.
    pieces = [p for p in pieces if p.encode() not in encoder.ranks] + ["a", "\0", "b"]
    got = encoder.merge_many([p.encode() for p in pieces])
    for piece, ids in zip(pieces, got):
        assert memoryview(ids).cast("I").tolist() == library.encode_ordinary(piece), piece
    again = encoder.merge_many([p.encode() for p in pieces])
    assert again == got and not any(encoder.queue.low) and not any(encoder.queue.mid)


@pytest.mark.parametrize("remembered", [40, 1000, 400_000])
def test_new_pieces_of_texts_share_a_queue(remembered, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", remembered)
    monkeypatch.setattr(bpe, "TOGETHER", (32, 100))
    encoder, rng = bpe.Encoder(given(), public_tokenizers.PATTERN), random.Random(2)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    alone, plain = [], encoder.merge
    monkeypatch.setattr(encoder, "merge", lambda piece: (alone.append(piece), plain(piece))[1])
    pool = ["".join(rng.choice("etaoinshrdlu漢é") for _ in range(rng.randrange(1, 12))) for _ in range(1500)] + ["x" * 70]
    for _ in range(3):
        texts = ["", "one"] + [" ".join(rng.choice(pool) for _ in range(40)) for _ in range(60)]
        for text, ids in zip(texts, encoder.encode_all(texts)):
            assert memoryview(ids).cast("I").tolist() == library.encode_ordinary(text)
        assert len(encoder.known) <= remembered
    if remembered == 400_000:
        assert sum(len(p) <= bpe.REMEMBERED_CHARS for p in alone) < bpe.TOGETHER[0] * 3
