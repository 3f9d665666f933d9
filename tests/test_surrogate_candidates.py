"""Splits, bins, rank correlation, candidate pools and top-k."""

import random
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sweeplens.operators import candidates as K
from sweeplens.operators import surrogate as S


def test_quantile_bins(spark):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate((0.1, 0.2, 0.3, 0.4, 0.5))], "id int, v double")
    for total in (None, 5):
        got = [r["bin"] for r in S.quantile_bins(rows, "v", 3, [F.col("id")], total=total).orderBy("id").collect()]
        assert got == [0, 0, 1, 2, 2]


def test_spearman_is_ordinal(spark):
    rng = random.Random(3)
    data = [(k, float(rng.randrange(9)), float(rng.randrange(9))) for k in range(60)]
    rows = spark.createDataFrame(data, "id int, a double, b double")
    rank = lambda c: np.argsort(np.argsort([d[c] for d in data], kind="stable"), kind="stable")
    want = np.corrcoef(rank(1), rank(2))[0, 1]
    assert S.spearman(rows, "a", "b", [F.col("id")]).first()["spearman"] == pytest.approx(want)
    twice = rows.withColumn("g", F.explode(F.array(F.lit("x"), F.lit("y")))).withColumn("b", F.when(F.col("g") == "y", F.col("a")).otherwise(F.col("b")))
    assert {r["g"]: r["spearman"] for r in S.spearman(twice, "a", "b", [F.col("id")], ["g"]).collect()} == {"x": pytest.approx(want), "y": 1.0}
    assert S.spearman(rows.limit(1), "a", "b", [F.col("id")]).first()["spearman"] == 0.0


@pytest.mark.parametrize("sizes, frac, want", [
    ({0: 30, 1: 31, 2: 30}, 0.05, {0: 1, 1: 2, 2: 2}), ({0: 2, 1: 1}, 0.05, {0: 1, 1: 0}), ({0: 10, 1: 10}, 0.25, {0: 2, 1: 3}),
])
def test_allocation(sizes, frac, want):
    got = S.allocate(sizes, frac)
    assert sum(got.values()) == sum(want.values()) and all(got[b] < sizes[b] for b in sizes)
    assert got == want


def test_holdout(spark):
    rows = spark.createDataFrame([([k], float(k % 17)) for k in range(100)], "layer_key array<int>, v double")
    split = {r["split"]: r["count"] for r in S.holdout_split(rows, "v", "layer_key", 0.1, 1).groupBy("split").count().collect()}
    assert split == {"train": 90, "holdout": 10}
    tiny = S.holdout_split(rows.limit(2), "v", "layer_key", 0.1, 1)
    assert sorted(r["split"] for r in tiny.collect()) == ["holdout", "train"]


def test_merge_priority(spark):
    rows = spark.createDataFrame([
        ([1], 1.0, "single_block", "r/20250101_000000", 9, 1), ([1], 2.0, "beam", "r/x", 1, 2), ([1], 3.0, "beam", "r/20240101", 1, 3),
        ([1], 4.0, "beam", "r/20240101", 1, 4), ([2], 5.0, "other", "r/x", 1, 5), ([2], 6.0, "other", "r/x", 2, 6)],
        "layer_key array<int>, score double, source string, source_path string, mtime bigint, seq bigint")
    assert {r["layer_key"][0]: r["score"] for r in S.merge_sources(rows).collect()} == {1: 3.0, 2: 6.0}


@pytest.fixture(scope="module")
def ids(spark):
    return spark.range(4000, numPartitions=3).withColumnRenamed("id", "candidate_id")


def test_pool_invariants(spark, ids):
    anchors = spark.createDataFrame([("3,1,1,4,1,1",), ("1,2",), ("x",), ("",)], "counts_csv string")
    usable = K.anchor_table(anchors, 6)
    assert usable.count() == 1
    pool = K.generate(ids, 6, max_extra=5, max_repeat=2, anchors=usable)
    rows = pool.collect()
    assert len(rows) == 4000 and {r["source"] for r in rows} == {"random", "anchor_mutation"}
    for r in rows:
        c = r["counts"]
        assert len(c) == 6 and sum(c) - 6 == r["extra_layers"] <= 5 and min(c) >= 1
        assert r["counts_csv"] == ",".join(map(str, c)) and r["relative_overhead"] == pytest.approx(r["extra_layers"] / 6)
        if r["source"] == "random":
            assert max(c) <= 3
    share = sum(r["source"] == "anchor_mutation" for r in rows) / 4000
    assert 0.40 < share < 0.50
    extras = [r["extra_layers"] for r in rows if r["source"] == "random"]
    assert all(300 < extras.count(k) < 450 for k in range(6))
    again = K.generate(ids.repartition(7), 6, max_extra=5, max_repeat=2, anchors=usable).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def plain_uniform(seed, k, draw):
    """The draws inside a candidate, in Python integers."""
    x = (k * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03 + draw * 0x8CB92BA72F3D8DD7) % 2**64
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> shift)) * mul % 2**64
    return ((x ^ (x >> 31)) >> 11) / 2**53


def plain_candidate(k, n, max_extra, max_repeat, anchors, share=0.45, steps=8, seed=42):
    def drawn(draw):
        value = 42
        for part in (k, seed, draw):
            value = xxhash.xxh64(struct.pack("<q", part), seed=value).intdigest()
        return (value >> 11) / 2**53

    def shift(add, u):
        open_layers = [i for i in range(n) if (counts[i] < 1 + max_repeat if add else counts[i] > 1)]
        if open_layers:
            counts[open_layers[min(int(u * len(open_layers)), len(open_layers) - 1)]] += 1 if add else -1

    mutate = drawn(0) < share
    listed = [[1] * n, *sorted(anchors)]
    counts = list(listed[int(drawn(1) * len(listed))]) if mutate else [1] * n
    u = plain_uniform(seed, k, 2)
    for step in range(1 + int(u * steps) if mutate else min(int(u * (max_extra + 1)), n * max_repeat)):
        shift(not mutate or plain_uniform(seed, k, 4 + 2 * step) < 0.65, plain_uniform(seed, k, 3 + 2 * step))
    draw = 1 << 20
    while sum(counts) - n > max_extra and max(counts) > 1:
        shift(False, plain_uniform(seed, k, draw))
        draw += 1
    return counts


@pytest.mark.parametrize("broadcast", [10_000, 0])
def test_pool_equals_a_plain_draw(spark, ids, monkeypatch, broadcast):
    monkeypatch.setattr(K, "BROADCAST_ANCHORS", broadcast)
    rng = random.Random(6)
    listed = [[rng.randrange(1, 5) for _ in range(6)] for _ in range(40)]
    anchors = spark.createDataFrame([(a,) for a in listed], "counts array<int>")
    for given, table in ((listed, anchors), ([], anchors.limit(0)), ([], None)):
        for r in K.generate(ids.limit(600), 6, max_extra=7, max_repeat=3, anchors=table).collect():
            assert r["counts"] == plain_candidate(r["candidate_id"], 6, 7, 3, given)


def test_full_layers_are_not_picked(ids):
    rows = K.generate(ids.limit(300), 3, max_extra=50, max_repeat=1, anchor_share=0.0).collect()
    assert max(r["extra_layers"] for r in rows) == 3 and all(max(r["counts"]) <= 2 for r in rows)


def test_distinct_top_k(spark, ids):
    predictor = K.linear_predictor({"method": [1.0, 2.0, 0.0, 0.5], "math": [1.0, 0.0, 0.0, 0.0], "eq": [0.0, 1.0, 0.0, 0.0]})
    scored = K.score(K.generate(ids, 4, max_extra=4, max_repeat=3), predictor, 0.5, 1.5, 1.0)
    best = {}
    for r in scored.filter("accepted").collect():
        key = (-r["pred_final"], r["candidate_id"])
        best[r["counts_csv"]] = min(best.get(r["counts_csv"], key), key)
    want = sorted(best.items(), key=lambda kv: kv[1])
    for k, probe in ((5, None), (5, scored.filter("candidate_id % 3 = 0")), (500, scored.filter("candidate_id % 3 = 0"))):
        got = [(r["counts_csv"], r["candidate_id"]) for r in K.distinct_top_k(scored, k, probe).orderBy("rank").collect()]
        assert got == [(c, key[1]) for c, key in want[:k]]
    searched = K.search(ids, 4, predictor, 5, 0.5, 1.5, 1.0, max_extra=4, max_repeat=3).orderBy("rank").collect()
    assert [r["counts_csv"] for r in searched] == [c for c, _ in want[:5]]


def test_topk_config(spark):
    top = spark.createDataFrame([(1, 9, "s", 0.5, 1.0, 1.0, 1.0, 0.75, "1,2,2,1")],
                                "rank int, candidate_id bigint, source string, relative_overhead double, pred_method double, pred_math double, pred_eq double, pred_final double, counts_csv string")
    rows = K.topk_config(top, 4).orderBy("rank").collect()
    assert [r["config_line"] for r in rows] == ["0,0", "layers:0,1,1,2,2,3"] and rows[0]["layer_key"] == [0, 1, 2, 3] and rows[1]["extra_layers"] == 2


def test_training_finds_a_linear_target(spark):
    rng = random.Random(1)
    data = []
    for k in range(120):
        c = [rng.randrange(1, 4) for _ in range(4)]
        data.append(([k], c, float(c[0] * 2 - c[1]), float(c[0]), float(c[1])))
    rows = spark.createDataFrame(data, "layer_key array<int>, counts array<int>, balanced_score double, math_delta double, eq_delta double")
    split = S.holdout_split(rows, "balanced_score", "layer_key", 0.2, 1)
    result = S.train(split, retries=0, rounds_scale=0.012)
    assert result.gate_passed and result.trials[0]["spearman_method"] > 0.8
    imp = {r["layer_idx"]: r["weight"] for r in S.feature_importance(result, 4).collect()}
    assert set(imp) == {0, 1, 2, 3} and imp[0] > 0
    assert S.predicted_vs_true(split, result.models).count() == 120


def test_single_block_flag(spark, one):
    from sweeplens.functions import layers as L
    cases = [([0, 1, 2, 3], False), ([0, 1, 0, 1, 2, 3], True), ([0, 1, 2, 3, 2, 3], True), ([0, 0, 0, 1, 2, 3], False), ([0, 1, 1, 2, 2, 3], False)]
    for key, want in cases:
        assert one(x=S.is_single_block(F.array(*[F.lit(k) for k in key]), 4))["x"] is want


def test_queries_train_all_presets_with_their_own_rounds(spark):
    from sweeplens.plans.catalog import surrogate as catalog

    out = {r["trial"]: r for r in catalog.surrogate_train(spark, "/root/testdata/sf0.001").collect()}
    assert [(out[t]["rounds"], out[t]["depth"]) for t in (1, 2, 3, 4)] == [(500, 6), (700, 4), (900, 8), (350, 6)]
    assert sum(r["is_best"] for r in out.values()) == 1


def test_search_with_trained_models_scores_as_the_models_do(spark, ids):
    rng = random.Random(2)
    data = [([k], [rng.randrange(1, 4) for _ in range(5)]) for k in range(150)]
    rows = spark.createDataFrame([(k, c, float(c[0] - c[1]), float(c[0]), float(c[1])) for k, c in data],
                                 "layer_key array<int>, counts array<int>, balanced_score double, math_delta double, eq_delta double")
    result = S.train(S.holdout_split(rows, "balanced_score", "layer_key", 0.2, 1), retries=1, rounds_scale=0.02)
    options = {"max_extra": 4, "max_repeat": 3}
    found = K.search(ids, 5, K.model_predictor(result.models), 20, 0.5, -9.0, -9.0, **options).orderBy("rank").collect()
    best = {}
    for r in K.generate(ids, 5, **options).collect():
        x = np.array([r["counts"]], dtype=float)
        score = float(result.models["method"].predict(x)[0]) - 0.5 * r["relative_overhead"]
        key = (-score, r["candidate_id"])
        best[r["counts_csv"]] = min(best.get(r["counts_csv"], key), key)
    want = sorted(best.items(), key=lambda kv: kv[1])[:20]
    assert [(r["counts_csv"], r["candidate_id"]) for r in found] == [(c, key[1]) for c, key in want]
    assert [r["pred_final"] for r in found] == pytest.approx([-key[0] for _, key in want])


def test_search_walks_the_floor_models_only_above_the_probe(spark, ids):
    """The method score drops rows before the other two models are asked."""
    rng = random.Random(2)
    data = [([k], [rng.randrange(1, 4) for _ in range(5)]) for k in range(150)]
    rows = spark.createDataFrame([(k, c, float(c[0] - c[1]), float(c[0]), float(c[1])) for k, c in data],
                                 "layer_key array<int>, counts array<int>, balanced_score double, math_delta double, eq_delta double")
    models = S.train(S.holdout_split(rows, "balanced_score", "layer_key", 0.2, 1), retries=1, rounds_scale=0.02).models
    found = K.search(ids, 5, K.model_predictor(models), 2, 0.5, -9.0, -9.0, probe_share=0.5, max_extra=4, max_repeat=3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and plan.index("ArrowEvalPython") < plan.rindex("Filter") < plan.rindex("ArrowEvalPython")
