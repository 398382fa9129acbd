import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from turnloom.llm import bpe

RANKS = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
THEIRS = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.Codec(RANKS, P.PATTERN)

ODD = [
    "", " ", "  ", "\n", "a", "don't stop", "DON'T 's 'll'llama ''s !'s x'", "'", "'s", "a 's b", "a  's", "a\n's", "1'2 3's",
    "tabs\t\tand  spaces \n\n end  ", " x  y z", "日本語の文章です。", "naïve café ÀÉ", "😀😀 x", "<|endoftext|>",
    "\x1c\x1d\x85 a", "ⅷ½²x", "'re've'm'd't", "l'l'll", "a" * 300, "!" * 70 + "?" * 70, "﻿​ z", "x" * 64, "y" * 65, "अ" * 50,
]


def _random_texts(n):
    rng = random.Random(3)
    letters = "aeést'’ \n\t12½!?.-日😀 "
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(n)]


def test_same_ids_as_the_library():
    texts = ODD + _random_texts(2000)
    for text, ids in zip(texts, CODEC.encode(texts)):
        assert ids == THEIRS.encode_ordinary(text), repr(text)
        assert CODEC.decode(ids) == text.encode()


def test_kinds_of_all_characters():
    every = ["a" + chr(i) + "b " + chr(i) + " 1" + chr(i) for i in range(0x3000) if not 0xD800 <= i < 0xE000]
    for text, ids in zip(every, CODEC.encode(every)):
        assert [p for p in bpe.regex.findall(P.PATTERN, text)] == CODEC.splitter.split([text])[0], repr(text)
        assert CODEC.decode(ids) == text.encode()


@pytest.mark.parametrize("piece", [b"a" * 5000, b"ab" * 3000, bytes(range(256)) * 8, b"the quick" * 200])
def test_long_pieces_by_one_tree(piece):
    assert CODEC.encoder.merge_long(piece) == THEIRS._core_bpe.encode_single_piece(piece)


def test_short_trees_equal_long_trees():
    rng = random.Random(5)
    pieces = [bytes(rng.choice(b"thean d") for _ in range(rng.randrange(2, 65))) for _ in range(500)]
    assert [list(x) for x in CODEC.encoder.merge_short(pieces)] == [CODEC.encoder.merge_long(p) for p in pieces]


def test_other_pattern_and_kept_pieces(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 3)
    codec = bpe.Codec(RANKS, r"\w+|\W+")
    for text in ["one two three four five", "one two"]:
        assert b"".join(map(codec.encoder.token.__getitem__, codec.encode([text])[0])) == text.encode()


def test_frame(spark):
    rows = [(1, None, "x"), (2, "", "y"), (2, "Hello  wörld", "z"), (None, "a" * 100_000, None), (3, "Hello  wörld", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, bpe.encode_decode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True).collect()), key=str)
    want = []
    for doc_id, text, _ in rows:
        ids = THEIRS.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), ids))
    assert got == sorted(want, key=str)
    assert bpe.encode_decode(df.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
