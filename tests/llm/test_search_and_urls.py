"""Exact top-k search and url verdicts against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweeplens.llm import topk, urlfilter
from sweeplens.llm.queries import RULES

VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute_top(rows, k, step):
    usable = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            usable.setdefault(i, []).append([math.floor(256 * float(np.float32(x))) for x in v])
    out = []
    for q in sorted(i for i in usable if i % step == 0):
        scores = sorted((-sum(a * b for a, b in zip(usable[q][0], v)), i) for i, vs in usable.items() if i != q for v in vs)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return out


@pytest.mark.parametrize("block,query_block", [(4096, 512), (7, 3)])
def test_top_k(spark, block, query_block):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, -0.25, 0.0, 0.5, 1.0]) for _ in range(6)], 0) for i in range(120)]  # many ties
    rows += [(200, None, 0), (201, [], 0), (202, [1.0, None] * 3, 0), (203, [math.nan] * 6, 0), (204, [math.inf] + [0.0] * 5, 0), (None, [1.0] * 6, 0)]
    vectors = topk.quantised(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding")
    got = topk.top_k(vectors, vectors.where("id % 10 = 0"), 5, block, query_block).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, 5, 10)


def test_top_k_few_repeated_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.5, 0.0], 0), (1, [0.5, 0.0], 0), (2, [1.0], 0)], VECTORS)
    v = topk.quantised(few, "vec_id", "embedding")
    assert sorted(map(tuple, topk.top_k(v, v.where("id = 0")).collect())) == [(0, 1, 1, 256 * 128), (0, 2, 1, 256 * 128)]
    assert topk.top_k(v.where("false"), v.where("false")).count() == 0
    assert topk.top_k(v, v.where("false")).count() == 0


def test_repeated_query_ids_do_not_hang_on_row_order(spark):
    rows = [(0, [1.0, 0.0], 0), (0, [0.0, 1.0], 0), (0, [0.0, 1.0], 0), (1, [4.0, 0.0], 0), (2, [0.0, 3.0], 0), (3, [1.0, 1.0], 0)]
    for order in (rows, rows[::-1]):
        v = topk.quantised(spark.createDataFrame(order, VECTORS).repartition(3), "vec_id", "embedding")
        got = [tuple(r) for r in topk.top_k(v, v.where("id = 0"), 3).orderBy("rank").collect()]
        assert got == [(0, 1, 1, 4 * 65536), (0, 2, 2, 3 * 65536), (0, 3, 3, 65536)]


def test_scores_that_leave_64_bits_fail(spark):
    for value in (1e300, 2.0**40):
        v = topk.quantised(spark.createDataFrame([(0, [value]), (1, [value])], "vec_id bigint, embedding array<double>"), "vec_id", "embedding")
        with pytest.raises(Exception, match="too large|64 bits"):
            topk.top_k(v, v.where("id = 0")).collect()


def test_scores_beyond_doubles_are_exact(spark):
    big = spark.createDataFrame([(0, [2**31 + 1, 1]), (1, [2**30 + 1, 1]), (2, [2**30 + 1, 0])], "id bigint, v array<bigint>")
    assert [tuple(r) for r in topk.top_k(big, big.where("id = 0"), 1).collect()] == [(0, 1, 1, (2**31 + 1) * (2**30 + 1) + 1)]


def lists_of(block):
    return topk.Lists(block, np.argsort(block, axis=0, kind="stable").astype("<i4"))


def test_reading_stops_early():
    rng = np.random.default_rng(0)
    block = np.round(rng.normal(size=(3000, 4)) * 100)
    block[:20] *= 8
    query = np.round(np.abs(rng.normal(size=(6, 4))) * 10)
    places, read = topk.nra(query, lists_of(block), 5)
    assert 0 < read < 0.5 * len(block) and all(len(p) <= 0.02 * len(block) for p in places)
    for q, found in zip(query, places):
        scores = block @ q
        assert set(np.flatnonzero(scores >= np.sort(scores)[-5])) <= set(found)


def test_a_floor_from_other_blocks_ends_the_reading_before_it_begins():
    rng = np.random.default_rng(1)
    block, query = np.round(rng.normal(size=(500, 6)) * 10), np.round(rng.normal(size=(4, 6)) * 10)
    scores = query @ block.T
    places, read = topk.nra(query, lists_of(block), 5, floor=np.full(4, 1e9))
    assert read == 0 and all(p.size == 0 for p in places)
    floor = np.sort(scores, axis=1)[:, -3]
    places, _ = topk.nra(query, lists_of(block), 5, floor=floor)
    for at, found in enumerate(places):
        assert set(np.flatnonzero(scores[at] >= floor[at])) <= set(found)


@pytest.mark.parametrize("portion", [1, 700])
def test_queries_in_portions(spark, monkeypatch, portion):
    monkeypatch.setattr(topk, "PORTION", portion)
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(-9, 9)) for _ in range(3 + i % 2)], 0) for i in range(150)]
    vectors = topk.quantised(spark.createDataFrame(rows, VECTORS).repartition(3), "vec_id", "embedding")
    got = topk.top_k(vectors, vectors.where("id % 10 = 0"), 4, 20, 2).collect()
    usable = {i: [256 * int(x) for x in v] for i, v, _ in rows}
    for q in range(0, 150, 10):
        want = sorted((-sum(a * b for a, b in zip(usable[q], v)), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))[:4]
        assert sorted((-r["score"], r["vec_id"]) for r in got if r["query_id"] == q) == want


URLS = ["http://www.theran.example.net/de/155?x=1", "HTTPS://WWW.Example.ORG/es/12#top", "http://m.a.example.org/en/176.html", "https://b.example.org/en/2",
        "https://x.com/fr/1", "https://x.com/de/1", "https://x.com", "http://org", "http://org/", "http://notorg/", "ftp://h?q=/a", "no scheme", "", None,
        "http://a.b/c://d/e", "http://com/fr/", "http://exam\u00e9.org/\u00e9?", "http://x.example.org/en/1", "://y.org/z", "http://" + "a" * 500 + ".net/" + "b/" * 2000]


def brute_url(url):
    host = path = ""
    if url is not None and "://" in url:
        host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fitting = []
    for verdict, text in RULES:
        own, rest = text.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest):
            fitting.append((len(text), text, verdict))
    return host, path, max(fitting)[1:] if fitting else (None, None)


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "<p>the ran word</p>", "x") for i, u in enumerate(URLS + URLS[:1])], "page_id bigint, url string, html string, rule string")
    got = {r["page_id"]: r for r in urlfilter.judge(pages, RULES, corpus=(pages, "html")).collect()}
    assert len(got) == len(URLS) + 1
    for i, url in enumerate(URLS):
        host, path, (rule, verdict) = brute_url(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == (verdict or ("block" if got[i]["score"] > 0 else "allow"))
    assert got[0]["score"] == got[len(URLS)]["score"]


def test_url_model(spark):
    """The learnt part follows the words of the rules' decisions."""
    rows = [(i, f"http://shop{'bad' if i % 2 else 'good'}.{'com/de' if i % 2 else 'com/fr'}/{'casino' if i % 2 else 'library'}/{i}") for i in range(200)]
    rows += [(1000, "http://goodshop.net/library/7"), (1001, "http://badshop.net/casino/7")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    words = spark.createDataFrame([("shop good bad shop library casino",)] * 3, "text string")
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(pages, RULES, corpus=(words, "text")).collect()}
    assert (got[1000], got[1001]) == ("allow", "block")
    assert urlfilter.judge(pages.where("false"), RULES).count() == 0


def brute_split(name, counts, total):
    """The best of all splits; unknown pieces cost more the longer they are."""
    def score(part):
        return math.log(counts[part] / (total + 1)) if part in counts else -math.log(total + 1) - 2.3 * len(part)

    best = None
    for cuts in range(1 << max(len(name) - 1, 0)):
        parts, at = [], 0
        for i in range(1, len(name) + 1):
            if i == len(name) or cuts >> (i - 1) & 1:
                parts.append(name[at:i])
                at = i
        value = sum(map(score, parts))
        if best is None or value > best[0]:
            best = (value, parts)
    return best


def test_segments_are_the_best_of_all_splits():
    rng = random.Random(3)
    for _ in range(150):
        counts = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))): rng.randrange(1, 60) for _ in range(8)}
        total = sum(counts.values()) + rng.randrange(50)
        name = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 10)))
        found = urlfilter.Segmenter(counts, total).split(name)
        value = sum(math.log(counts[p] / (total + 1)) if p in counts else -math.log(total + 1) - 2.3 * len(p) for p in found)
        assert "".join(found) == name and value == pytest.approx(brute_split(name, counts, total)[0])
    s = urlfilter.Segmenter({"the": 50, "ran": 20, "her": 5, "an": 9, "t": 1}, 85)
    assert s.split("theran") == ("the", "ran") and s.split("") == () and "".join(s.split("xyzthe")) == "xyzthe"


def test_every_word_counts(spark):
    t = spark.createDataFrame([("a a a b b c",), (None,), ("<x>D</x>",), ("q" * 300,)], "t string")
    counts = urlfilter.word_counts(t, "t")
    assert dict(map(tuple, counts.collect())) == {"a": 3, "b": 2, "c": 1, "d": 1, "q" * 300: 1}
    hosts = spark.createDataFrame([("abba12.c-" + "q" * 300 + "zz",), ("",), ("7.7",), ("abba12.c-" + "q" * 300 + "zz",)], "host string")
    found = dict(map(tuple, urlfilter.segmented(hosts, counts).collect()))
    assert found == {"abba12.c-" + "q" * 300 + "zz": ["a", "b", "b", "a", "0", "c", "q" * 300, "zz"], "": [], "7.7": ["0", "0"]}


def test_scores_are_bayes_scores_of_the_segmented_words(spark):
    rng = random.Random(5)
    words = ["shop", "bad", "good", "mail", "king", "fish"]
    rows = [(i, f"http://{''.join(rng.sample(words, 2))}{i % 3}.{rng.choice(['com', 'org', 'net'])}/{rng.choice(['de', 'fr', 'x'])}/{rng.choice(words)}") for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    text = spark.createDataFrame([(" ".join([*words, "com org net com org net"]),)], "t string")
    got = urlfilter.judge(pages, RULES, corpus=(text, "t")).collect()
    counts = Counter([*words, "com", "org", "net", "com", "org", "net"])

    def bag(url):
        host, path, rule = brute_url(url)
        out = []
        for piece in urlfilter.pieces(host):
            out += ["h:0"] if piece.isdigit() else [f"h:{w}" for w in urlfilter.Segmenter(dict(counts), 12).split(piece)]
        return out + [f"p:{w}" for w in re.findall("[a-z]+", path)], rule[1]

    seen = {"allow": Counter(), "block": Counter()}
    docs = Counter()
    for _, url in rows:
        found, verdict = bag(url)
        if verdict:
            seen[verdict].update(urlfilter._bucket(t) for t in found)
            docs[verdict] += 1
    known = set(seen["allow"]) | set(seen["block"])
    size = {c: sum(n.values()) + 0.5 * len(known) for c, n in seen.items()}
    for r in got:
        found, _ = bag(rows[r["page_id"]][1])
        want = math.log(docs["block"] / docs["allow"]) + sum(
            math.log((seen["block"][b] + 0.5) / size["block"]) - math.log((seen["allow"][b] + 0.5) / size["allow"])
            for b in map(urlfilter._bucket, found) if b in known)
        assert r["score"] == pytest.approx(want)
    with pytest.raises(ValueError, match="of its own"):
        urlfilter.judge(pages.withColumnRenamed("page_id", "Host"), RULES, id_col="Host")
