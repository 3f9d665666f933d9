"""Toxicity, quality, fingerprints, mixing and the whole pipeline."""

import hashlib
import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sweeplens.llm import jaccard, mixing, passages, quality, syncmers, toxicity
from sweeplens.llm.queries import QUERIES
from sweeplens.llm.shared import components, kth_smallest

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, epoch int"
LABELS = "doc_id bigint, quality int, toxic int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 0.5, 1) for i, t, s in rows], DOCS)


def test_toxicity_held_out(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op3_toxicity"](spark, SF).collect() if r["held_out"] and r["doc_id"] in labels]
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in rows)
    assert right >= 0.9 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_interactions_are_learnt():
    """A label that only a pair of terms tells is beyond additive weights."""
    rng = np.random.default_rng(0)
    x = (rng.random((3000, 6)) < 0.5).astype(np.uint8)
    y = (x[:, 0] == x[:, 1]).astype(float)
    bias, w, v = toxicity.fit(x, y)
    z = bias + x @ w + 0.5 * (((x @ v) ** 2).sum(axis=1) - x @ (v**2).sum(axis=1))
    assert ((z > 0) == (y == 1)).mean() > 0.95


def test_a_label_that_only_a_pair_tells(spark):
    """Neither word alone says anything; both, or none of them, mean label 1."""
    rng = random.Random(3)
    filler = [f"word{k}" for k in range(60)]
    rows, labels = [], []
    for i in range(1600):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = rng.sample(filler, 12) + ["zorbling"] * a + ["quuxers"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(a == b)))
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, LABELS)
    model = toxicity.train(docs, marks.where("doc_id % 4 > 0"))
    got = {r["doc_id"]: r["score_"] for r in toxicity.scored(docs, model).collect()}
    held = [(got[i] >= 0.5) == bool(y) for i, _, y in labels if i % 4 == 0]
    assert sum(held) / len(held) > 0.9


def test_toxicity_edges(spark):
    rows = [(i, f"you {'idiot' if i % 3 == 0 else 'friend'} number {i}", "a") for i in range(90)] + [(100, None, "a"), (101, "", "a"), (None, "idiot", "a"), (102, "x " * 50000, None)]
    docs = frame(spark, rows + rows[:1])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)] + [(None, 1, 1), (5, None, None), (5, 1, 0)], LABELS)
    model = toxicity.train(docs, labels)
    got = toxicity.scored(docs, model)
    assert got.columns == [*docs.columns, "score_"] and got.count() == len(rows) + 1
    by = {r["doc_id"]: r["score_"] for r in got.collect()}
    assert all((by[i] >= 0.5) == (i % 3 == 0) for i in range(90)) and by[None] >= 0.5 and by[100] == by[101] < 0.5
    kept = toxicity.accepted(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in by.items() if s < 0.5}
    assert toxicity.train(docs, labels.where("false")) is None
    assert {r["score_"] for r in toxicity.scored(docs, None).collect()} == {0.0}
    assert toxicity.scored(docs.where("false"), model).count() == 0


def test_quality(spark):
    rng = random.Random(1)
    good = [f"w{rng.randrange(30)}" for _ in range(4000)]
    rows = [(i, " ".join(good[20 * i: 20 * i + 20]) if i % 4 else "### $$$ " * 10, "a") for i in range(200)] + [(300, None, "a"), (301, "", "a"), (None, "w1 w2", "a")]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 200, 2)] + [(None, 1, 0), (7, None, 0)], LABELS)
    docs = frame(spark, rows)
    got = quality.resample(docs, labels, share=0.75).collect()
    assert len(got) == 203 and sum(r["keep"] for r in got) == round(0.75 * 203)
    assert all(r["log_weight"] == 0 for r in got if r["doc_id"] in (300, 301))
    junk = [r["keep"] for r in got if r["doc_id"] is not None and r["doc_id"] < 200 and r["doc_id"] % 4 == 0]
    assert sum(junk) <= 2
    keys = sorted((r["gumbel_key"] for r in got), reverse=True)
    assert min(r["gumbel_key"] for r in got if r["keep"]) >= keys[round(0.75 * 203)] - 1e-6
    again = {(r["doc_id"], r["keep"]) for r in quality.resample(docs.repartition(5), labels, share=0.75).collect()}
    assert again == {(r["doc_id"], r["keep"]) for r in got}
    assert not any(r["keep"] for r in quality.resample(docs, labels, share=0.0).collect())
    assert quality.resample(docs.where("false"), labels).count() == 0
    assert {r["log_weight"] for r in quality.resample(docs, labels.where("false")).collect()} == {0.0}


def _hash(value, seed):
    return xxhash.xxh64_intdigest(value.encode() if isinstance(value, str) else int(value).to_bytes(8, "little", signed=True), seed)


def _signed(x):
    return x - 2**64 if x >= 2**63 else x


def _many(*values):
    seed = 42
    for v in values:
        seed = _hash(v, seed)
    return _signed(seed)


def brute_anchors(text, k=5, s=2):
    import regex

    def of(tokens):
        h = [_many(t) for t in tokens]
        g = [_many(*h[i: i + s]) for i in range(len(h) - s + 1)]
        span, out = k - s, {}
        for i in range(len(g) - span):
            if min(g[i], g[i + span]) <= min(g[i + 1: i + span]):
                mark = (_many(*[g[i + j] for j in range(0, span, s)], g[i + span]) % 2**64) >> 32
                out.setdefault(mark, i + 1)
        return out if len(h) >= k else {}

    tokens = regex.findall(r"[\p{L}\p{N}]{1,4}|[^\s\p{L}\p{N}]+", text)
    found = of(tokens)
    if len(tokens) < 3 * k:
        for mark, place in of(list(text)).items():
            found[mark] = min(place, found.get(mark, place))
    packed = sorted((m << 31) + p for m, p in found.items())[:64]
    return "".join(f"{x:016x}" for x in packed or [((_many(text) % 2**64) >> 32) << 31])


def test_fingerprints(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcd \n,é中") for _ in range(n)) for n in (0, 1, 4, 7, 12, 30, 60, 200, 900, 3000)]
    texts += [texts[8], texts[8][:700] + texts[9][:200], None, "x" * 50000, " " * 40, "\U0001f600 a b"]
    docs = frame(spark, [(i * 7 - 20, t, "a") for i, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in syncmers.edited_fingerprints(docs).collect()}
    for i, t in enumerate(texts):
        t, nxt, r = t or "", texts[(i + 1) % len(texts)] or "", got[i * 7 - 20]
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == brute_anchors(t) and r["edited_fingerprint"] == brute_anchors(edited), repr(t[:50])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    same = frame(spark, [(1, texts[9], "a"), (2, texts[9], "a"), (2, texts[9], "a"), (None, texts[8], "a")])
    rows = syncmers.edited_fingerprints(same).collect()
    assert len(rows) == 4 and len({r["fingerprint"] for r in rows}) == 2
    assert max(r["near_next"] for r in rows) == 1.0
    alone = syncmers.edited_fingerprints(same.where("doc_id = 1")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0
    assert syncmers.edited_fingerprints(same.where("false")).count() == 0


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(1, 40), s) for i, s in enumerate(["big"] * 300 + ["mid"] * 60 + ["tiny"] * 10 + [None] * 25)] + [(900, "", "void"), (901, None, "void"), (None, "a b", "mid")]
    docs = frame(spark, rows)
    sources = mixing.source_tokens(docs, "source", mixing.word_count(F.col("text")))
    tokens = {r["source"]: r["tokens"] for r in sources.collect()}
    total = sum(tokens.values())
    for limit in (1.5, 3.0):
        m = mixing.solve(sources, limit)
        p = {s: (t / total) ** m.exponent for s, t in tokens.items() if t}
        ratio = {s: p[s] / tokens[s] for s in p}
        assert max(ratio.values()) / min(ratio.values()) == pytest.approx(limit, rel=1e-5)
        mixed = mixing.mix(docs, max_repetition=limit)
        assert mixed.columns == [*docs.columns, "epoch_", "mix_key"]
        found = mixed.collect()
        count = {}
        for r in found:
            count.setdefault(r["source"], {}).setdefault((r["doc_id"], r["text"]), []).append(r["epoch_"])
        assert {s: len(d) for s, d in count.items()} == {"big": 300, "mid": 61, "tiny": 10, None: 25, "void": 2}  # all appear
        for s, d in count.items():
            assert all(sorted(e) == list(range(1, len(e) + 1)) for e in d.values())
            if tokens[s]:
                used = sum(len(t.split()) * len(e) for (_, t), e in d.items())
                want = m.budget * p[s] / sum(p.values())
                assert want - 40 <= used <= want + 1e-3
        assert all(0 <= r["mix_key"] < 1 for r in found)
    assert mixing.solve(sources, entropy=0.9).entropy == pytest.approx(0.9, abs=1e-5)
    assert mixing.solve(sources, entropy=9.0).exponent == pytest.approx(0.0, abs=1e-6)
    uneven = spark.createDataFrame([("a", 9, 900), ("b", 1, 100)], "source string, docs bigint, tokens bigint")
    sharper = mixing.solve(uneven, entropy=0.2)
    assert sharper.entropy == pytest.approx(0.2, abs=1e-5) and sharper.exponent > 1
    assert mixing.solve(uneven, entropy=0.325083).exponent == pytest.approx(1.0, abs=1e-4)
    assert mixing.solve(uneven.withColumn("tokens", F.lit(5).cast("bigint")), entropy=0.1).entropy == pytest.approx(math.log(2))
    assert mixing.solve(uneven, entropy=0.0, budget=100.0).entropy < 1e-9
    cut = mixing.mix(docs, max_repetition=3.0, budget=total / 2)
    assert total / 2 - 160 <= sum(len((r["text"] or "").split()) for r in cut.collect()) <= total / 2 + 1e-6
    a, b = (sorted((str(r["doc_id"]), r["epoch_"]) for r in mixing.mix(d, max_repetition=1.5).collect()) for d in (docs, docs.repartition(7)))
    assert a == b
    assert mixing.mix(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        mixing.solve(sources)


def test_shared_helpers(spark):
    rng = random.Random(7)
    values = [rng.choice([-(2**63), 2**63 - 1, 0, -1, 5]) if rng.random() < 0.2 else rng.randrange(-(2**62), 2**62) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v bigint")
    for k in (1, 2, 250, 499, 500):
        assert kth_smallest(df, F.col("v"), k) == sorted(values)[k - 1]
    assert kth_smallest(df, F.col("v"), 501) is None
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (None, 3), (300, 299), (-5, 300)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {**{i: 0 for i in range(1, 61)}, **{200 + i: 100 for i in range(50)}, 300: -5, 299: -5}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "source_mixing", "best_fit_packing"]
    found, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        found = corpus_pipeline.written(stage(spark, found, SF), name)
        seen.append(found)
        if name != "best_fit_packing":
            assert found.columns == docs.columns and found.dtypes == docs.dtypes
    clean, single, cut, mixed, packed = seen
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in clean.collect()}
    assert len(gone & toxic) >= 0.85 * len(toxic)
    classes = {r["doc_id"]: r["component_id"] for r in jaccard.classes(clean, jaccard.Rule(5, 80, 100)).collect()}
    assert {r["doc_id"] for r in single.collect()} == {i for i, c in classes.items() if i == c}
    assert passages.repeated(cut).count() <= 0.1 * max(passages.repeated(single).count(), 1)
    assert {r["doc_id"] for r in mixed.collect()} == {r["doc_id"] for r in cut.collect()} == {r["doc_id"] for r in single.collect()}
    rows = packed.collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in mixed.collect()}
    assert len({r["sequence_id"] for r in rows}) <= math.ceil(sum(r["length"] for r in rows) / 2048) * 1.01 + 1
