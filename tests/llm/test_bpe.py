"""Byte-level BPE against the tiktoken library, the round trip, and odd inputs."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from sweeplens.llm import bpe, queries

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(RANKS), bpe.exact_patterns(public_tokenizers.PATTERN))


def encoded(texts, encoder):
    out = [[] for _ in texts]
    for row, ids in bpe._encoded_parts(texts, encoder):
        out[row] += ids.tolist()
    return out


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 30_000, dtype=np.uint64))
    found = bpe.PerfectHash(keys)
    assert sorted(found.slots(keys).tolist()) == list(range(keys.size))
    assert bpe.PerfectHash(keys[:0]).slots(keys).tolist() == [-1] * keys.size


def test_first_tier_finds_the_vocabulary_and_nothing_else(encoder):
    tokens = [*list(RANKS)[::7], b"qqzzqq", b"\xff\xff\xff", b" neverseenword"]
    raw = np.frombuffer(b"".join(tokens), dtype=np.uint8)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))
    assert encoder.vocabulary.find(raw, bounds).tolist() == [RANKS.get(t, -1) for t in tokens]


def test_second_tier_equals_the_library():
    rng = random.Random(5)
    for _ in range(2000):
        piece = bytes(rng.choice(b"aeinrst \xc3\xa9\xff!1") for _ in range(rng.randrange(1, 40)))
        assert bpe.merged(piece, RANKS) == LIBRARY._encode_single_piece(piece)


def test_encoding_equals_the_library(encoder, monkeypatch):
    rng = random.Random(2)
    letters = "abX  \n\t'sreZ9é漢字🙂-_.՘ᲊ\x85\x1c\xa0́\r "
    texts = ["", None, "a" * 3000, " " * 300, " \n" * 200 + "x", "it's  they'll\n\n x ", "!" * 2000, "㐀\U000323b0 ⃁"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(120))) for _ in range(800)]
    expected = [LIBRARY.encode_ordinary(t or "") for t in texts]
    assert encoded(texts, encoder) == expected
    monkeypatch.setattr(bpe, "REMEMBERED", 3)  # generations turn over all the time
    assert encoded(texts, bpe.Encoder(encoder.vocabulary, bpe.exact_patterns(public_tokenizers.PATTERN))) == expected


def test_parts_of_a_long_text_encode_alone():
    rng = random.Random(4)
    text = "".join(rng.choice(["ab", " ", "  ", "\n", "'s", "9", "é ", "!"]) for _ in range(4000))
    cut = list(bpe.parts(text, 50))
    assert "".join(cut) == text and len(cut) > 20
    assert sum((LIBRARY.encode_ordinary(p) for p in cut), []) == LIBRARY.encode_ordinary(text)


def test_edges(spark):
    long = "word " * 300_000 + "x" * 70_000
    rows = [(1, "hello world", "k"), (1, "hello world", "k"), (2, None, None), (None, "", ""), (3, long, "long")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids_ string")
    both = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, keep=["doc_id", "ids_"], with_bytes=True).collect()
    assert len(both) == 5
    for row in both:
        text = next((r[1] or "") for r in rows if r[0] == row["doc_id"])
        assert list(row["ids"]) == LIBRARY.encode_ordinary(text) and bytes(row["decoded"]).decode() == text
    only = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert sorted(len(r["decoded"]) for r in bpe.decode(only, RANKS).collect()) == sorted(len(r[1] or "") for r in rows)
    assert bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError, match="made here"):
        bpe.encode(docs.withColumnRenamed("ids_", "IDS"), RANKS, public_tokenizers.PATTERN, keep=["IDS"])
    with pytest.raises(ValueError, match="vocabulary"):
        bpe.Vocabulary(RANKS).decode(np.array([50256]))


def test_query_equals_the_library(spark):
    import hashlib

    found = {r["doc_id"]: r for r in queries.op11_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    for row in docs:
        ids = LIBRARY.encode_ordinary(row["text"] or "")
        assert found[row["doc_id"]]["n_tokens"] == len(ids)
        assert found[row["doc_id"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[row["doc_id"]]["decoded_sha256"] == hashlib.sha256((row["text"] or "").encode()).hexdigest()
