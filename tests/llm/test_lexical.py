"""Ranked search against brute force, the sharing of common terms, and odd inputs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sweeplens.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def term_list(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, k=10):
    counted = [(name, Counter(term_list(text))) for name, text in docs]
    counted = [(name, tf, sum(tf.values())) for name, tf in counted if tf]
    total, everything = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, tf, _ in counted for t in tf)
    out = []
    for item, text in items:
        scores = []
        for name, tf, n in counted:
            m = 25 + 75 * n * total // everything
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m))
                        for t in term_list(text) if t in tf)
            if score > 0:
                scores.append((-score, name is None, name or 0, name))
        out += [(item, rank, name, -s) for rank, (s, _, _, name) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def texts(rng, n, words):
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("cells", [1 << 22, 1 << 10])
def test_equals_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(lexical, "CELLS", cells)
    rng = random.Random(cells)
    words = [f"w{i}" for i in range(60)] + ["Été", "été", "A-b", "x_y", "漢字", "9", "\x7f"]
    docs = [(i, t) for i, t in enumerate(texts(rng, 400, words))]
    docs += [(500 + i, docs[7][1]) for i in range(40)] + [(900, None), (901, ""), (None, docs[7][1]), (7, docs[8][1]), (7, docs[8][1])]
    passage = " ".join(rng.choice(words) for _ in range(25))
    items = [(i, t) for i, t in enumerate(texts(rng, 30, words))] + [(100 + i, passage + " " + t) for i, t in enumerate(texts(rng, 10, words))]
    items += [(200, None), (201, ""), (202, "unseen"), (203, docs[7][1]), (203, "w1 w1 W1 w2")]
    found = lexical.rank(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5),
                         spark.createDataFrame(items, "item_id bigint, text string"))
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    docs = list(enumerate(texts(rng, 100, words)))
    items = [(f"i{i}", t) for i, t in enumerate(texts(rng, 20, words))]
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 700)
    found = lexical.rank(spark.createDataFrame(docs, "number bigint, score string"), spark.createDataFrame(items, "item string, terms string"),
                         k=3, doc_col="number", text_col="score", item_col="item", item_text_col="terms")
    assert found.columns == ["item", "rank", "number", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items, 3)


def test_sharing_computes_common_sets_once():
    rng = random.Random(3)
    passages = [rng.sample(range(1000), 30) for _ in range(4)]
    items = []
    for _ in range(60):
        chosen = {t: 1 for p in rng.sample(passages, 2) for t in p}
        chosen.update({rng.randrange(1000, 5000): rng.randrange(1, 3) for _ in range(5)})
        items.append(chosen)
    sharing = lexical.Sharing.of(items)
    shared, plain = sharing.additions()
    assert plain == sum(len(i) for i in items) and shared < plain / 3
    postings = lexical.Postings.of(np.repeat(np.arange(5000), 2), np.tile([0, 1], 5000), np.ones(10_000, np.int64), 5000, 2)
    values = np.random.default_rng(1).integers(0, 10**10, 10_000)
    for number, total in sharing.accumulators(postings, values):
        assert total.tolist() == [sum(int(values[2 * t + d]) * c for t, c in items[number].items()) for d in (0, 1)]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, " - "), (3, "")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert lexical.rank(docs, items).count() == 0
    assert lexical.rank(docs.limit(0), items).count() == 0
    some = spark.createDataFrame([(1, "a " * 400_000 + "b", 0), (2, "b", 1)], "doc_id bigint, text string, rank int")
    assert lexical.rank(some, items.limit(0)).count() == 0
    assert sorted(map(tuple, lexical.rank(some, items).collect()), key=str) == brute([(1, "a " * 400_000 + "b"), (2, "b")], [(1, "a b")])
    assert lexical.length_parts(np.array([10**9]), 10**12, 10**15)[0] == 25 + 75 * 10**9 * 10**12 // 10**15
    with pytest.raises(ValueError, match="differ"):
        lexical.rank(docs, items, doc_col="item_id")
