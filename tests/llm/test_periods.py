"""Periodic runs against brute force, the stitching of tiles, and odd inputs."""

import hashlib
import random
import re

import numpy as np
import pytest

from sweeplens.llm import periods, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    found = {}
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def kept(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repetitive(rng, size, letters):
    words = []
    while len(words) < size:
        period = [f"w{rng.randrange(letters)}" for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 21, 40]))]
        words += (period * 12)[: rng.randrange(1, 12) * len(period) + rng.randrange(len(period))]
        words += [f"w{rng.randrange(letters)}" for _ in range(rng.randrange(10))]
    return words


def test_z_function():
    rng = random.Random(1)
    for _ in range(200):
        x = [rng.randrange(2) for _ in range(rng.randrange(1, 30))]
        z = periods.z_function(x)
        for i in range(len(x)):
            assert z[i] == next((k for k in range(len(x) - i) if x[k] != x[i + k]), len(x) - i)


def test_words_are_split_at_ascii_white_space_only():
    import pyarrow as pa

    texts = ["a b  c\x0b", None, "", " x\x85y ", "Z"]
    raw, start, stop, first = periods.words(pa.array(texts))
    found = [[raw[start[i]: stop[i]].tobytes().decode() for i in range(a, b)] for a, b in zip(first[:-1], first[1:])]
    assert found == [WORD.findall(t or "") for t in texts]


@pytest.mark.parametrize("pieces", [1, 64])
def test_equals_brute_force(spark, monkeypatch, pieces):
    monkeypatch.setattr(periods, "BOUNDARIES", pieces)
    monkeypatch.setattr(periods, "CELLS", 64)
    rng = random.Random(pieces)
    docs = [(i, " ".join(repetitive(rng, rng.choice([0, 5, 30, 200, 900]), rng.choice([1, 2, 4, 60])))) for i in range(150)]
    found = periods.runs(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(6)).collect()
    assert len(found) == len(docs)
    for row in found:
        words = WORD.findall(dict(docs)[row["doc_id"]])
        assert [tuple(r) for r in row["runs"]] == brute(words)
        assert row["collapsed"] == kept(words, brute(words))


def test_edges(spark):
    long = ["a", "b", "c", "d", "e"] * 30_000 + ["z"] + ["q"] * 20_000
    same = "x y " * 20 + "end"
    rows = [(1, same, 7), (1, same, 8), (1, "u " * 9, 9), (None, same, 1), (2, None, 2), (3, "", 3), (4, " \n", 4), (5, " ".join(long), 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key int")
    found = [(r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periods.runs(docs).collect()]
    pair = ([(0, 40, 2)], "x y end")
    expected = [(1, *pair), (1, *pair), (1, [(0, 9, 1)], "u"), (None, *pair), (2, [], ""), (3, [], ""), (4, [], ""),
                (5, [(0, 150_000, 5), (150_001, 20_000, 1)], "a b c d e z q")]
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert periods.runs(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    import zlib

    found = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    with_runs = 0
    for doc_id, text in docs:
        words, h = WORD.findall(text or ""), zlib.crc32(str(doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs, row = brute(words), found[doc_id]
        with_runs += bool(runs)
        best = min(((-length, s, q) for s, length, q in runs), default=(None, None, None))
        assert row["n_runs"] == len(runs)
        assert (row["length"], row["start"], row["period"]) == (best[0] and -best[0], best[1], best[2])
        assert row["exponent_milli"] == (1000 * -best[0] // best[2] if runs else None)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in sorted((s, length, q) for s, length, q in runs))
        assert row["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(kept(words, runs).encode()).hexdigest()
    assert with_runs > 5


def test_runs_by_start_then_period(spark):
    pieces = [(1, 1, 2, 0, 10), (1, 1, 2, 8, 30), (1, 1, 3, 0, 12), (1, 1, 4, 0, 30), (1, 1, 1, 40, 45)]
    frame = spark.createDataFrame(pieces, "id bigint, key bigint, period bigint, begin bigint, end bigint")
    found = periods.runs_of(frame).select("start", "length", "period").collect()
    assert sorted(map(tuple, found)) == [(0, 12, 3), (0, 30, 2)]


def test_texts_without_repeats_make_no_tiles():
    words = np.arange(5000, dtype=np.uint64)
    words[1:4000:7] = 3  # one word again and again, but never beside itself
    hashes = periods.textarrays.mix(words)
    assert not list(periods.boundaries(hashes, np.array([0, 2500, 5000])))
    twice = np.concatenate((hashes[:40], hashes[:40], hashes[40:]))  # a repeat of two is no run
    found = list(periods.boundaries(twice, np.array([0, twice.size])))
    assert not found or all(not periods.fragments(twice.tolist(), int(c), small) for small, _, cuts in found for c in cuts)
