"""Ids equal the library's, decoding gives the text back."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from leafwise.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.ranks_of(PATH, P.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}, special_tokens={})
ODD = ["", "a", " ", "  a", "a  b", "a\n b ", "x " * 5, "'s 't don't", "\n\n a", "é" * 3000, "a" * 5000 + " " + "ab" * 3000, "日本語 テスト　x", "👍🏽 ok", " lead", "tail ", "a \n b  c", "<|endoftext|>", "a b  c", " x y"]


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_odd_texts():
    for text, got in zip(ODD, bpe.Encoder(RANKS).encode(ODD), strict=True):
        assert ids(got) == LIBRARY.encode_ordinary(text), text[:40]
        assert RANKS.decode(got).decode() == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_texts(texts):
    for text, got in zip(texts, bpe.Encoder(RANKS).encode(texts), strict=True):
        assert ids(got) == LIBRARY.encode_ordinary(text)


def test_merges_of_random_pieces():
    draw = random.Random(1)
    pieces = ["".join(draw.choice("aberst ") for _ in range(draw.randint(1, 70))).strip() or "x" for _ in range(500)]
    for piece, got in zip(pieces, RANKS.encode_pieces([p.encode() for p in pieces]), strict=True):
        whole = tiktoken.Encoding("one", pat_str=r"[\s\S]+", mergeable_ranks=RANKS.rank, special_tokens={})
        assert ids(got) == whole.encode_ordinary(piece)
        break
    whole = tiktoken.Encoding("one", pat_str=r"[\s\S]+", mergeable_ranks=RANKS.rank, special_tokens={})
    assert [ids(x) for x in RANKS.encode_pieces([p.encode() for p in pieces])] == [whole.encode_ordinary(p) for p in pieces]


def test_full_tables_change_nothing(monkeypatch):
    texts = [f"word{i} other{i * 7} again" for i in range(50)]
    want = bpe.Encoder(RANKS).encode(texts)
    monkeypatch.setattr(bpe, "PIECES_KEPT", 3)
    monkeypatch.setattr(bpe, "SEGMENTS_KEPT", 3)
    encoder = bpe.Encoder(RANKS)
    assert [encoder.encode([t])[0] for t in texts] == want


def test_rows(spark, table):
    docs = table([(1, "Hello there", "en", "a", 1), (1, "Hello there", "en", "a", 1), (2, None, None, None, None), (None, "", "x", "y", 0)])
    rows = bpe.digest_documents(docs, PATH, P.PATTERN).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded_sha256 == empty) for r in rows) == [(0, 0, True), (1, 2, False), (1, 2, False), (2, 0, True)]
    full = bpe.encode_documents(docs.withColumnRenamed("lang", "ids_"), PATH, P.PATTERN, keep=("source",)).orderBy("doc_id").collect()
    assert [(r.source, bytes(r.decoded).decode()) for r in full][-1] == (None, "") and bpe.digest_documents(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_lone_long_pieces_and_many_agree():
    draw = random.Random(2)
    pieces = [bytes(draw.choice(b"aberst") for _ in range(draw.choice([3, 900, 1_000, 20_000]))) for _ in range(6)] + [b"ab", b"a" * 700]
    whole = tiktoken.Encoding("one", pat_str=r"[\s\S]+", mergeable_ranks=RANKS.rank, special_tokens={})
    for piece in pieces:
        assert ids(RANKS._alone(piece)) == whole.encode_ordinary(piece.decode())
        if len(piece) < 1_100:
            width = max(2, 1 << (len(piece) - 1).bit_length())
            assert list(RANKS._merged([piece] * 2, width)) == [RANKS._alone(piece)] * 2
    long = bytes(draw.choice(b"aberstxyz") for _ in range(300_000))
    assert RANKS.decode(RANKS.encode_pieces([long])[0]) == long


def test_other_patterns_take_whole_texts():
    pattern = r"[\s\S]{1,7}"
    encoder = bpe.Encoder(bpe.ranks_of(PATH, pattern))
    library = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=RANKS.rank, special_tokens={})
    texts = ["the quick people, were reading.", "a b c d", ""]
    assert [ids(x) for x in encoder.encode(texts)] == [library.encode_ordinary(t) for t in texts]
    assert bpe.Encoder(RANKS).spaced and not encoder.spaced


def test_clashing_names(spark, table):
    docs = table([(1, "Hello there", "en", "a", 1)]).withColumnRenamed("lang", "ids").withColumnRenamed("source", "decoded")
    row = bpe.encode_documents(docs, PATH, P.PATTERN, keep=("ids", "decoded")).first().asDict()
    assert row["ids"] == "en" and row["decoded"] == "a" and row["_ids"] == LIBRARY.encode_ordinary("Hello there") and bytes(row["_decoded"]) == b"Hello there"
