"""Balanced analysis, grids and beam search against plain Python."""

import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweeplens.functions import layers as L
from sweeplens.operators import analysis as A
from sweeplens.operators import beam as B

N = 5


def expand(i, j, n=N):
    return list(range(n)) if (i, j) == (0, 0) else list(range(j)) + list(range(i, n))


PAIRS = [(0, 0)] + [(i, j) for j in range(1, N + 1) for i in range(j)]
MATH = {p: ((p[0] * 7 + p[1] * 3) % 11) / 10 for p in PAIRS}
EQ = {p: ((p[0] * 5 + p[1] * 2) % 13) * 10.0 for p in PAIRS}


@pytest.fixture(scope="module")
def tables(spark):
    make = lambda m: spark.createDataFrame([(expand(*p), float(v)) for p, v in m.items()], "layer_key array<int>, score double")
    return make(MATH), make(EQ)


def z(values):
    std = statistics.pstdev(values)
    return statistics.mean(values), std if std >= 1e-12 else 1.0


def by_hand(math, eq):
    keys = [p for p in PAIRS if p != (0, 0) and p in math and p in eq]
    dm, dq = {p: math[p] - math[0, 0] for p in keys}, {p: eq[p] - eq[0, 0] for p in keys}
    (mm, ms), (qm, qs) = z(dm.values()), z(dq.values())
    return {p: ((dm[p] - mm) / ms + (dq[p] - qm) / qs, dq[p], dm[p]) for p in keys}


def test_balanced_ranking(tables):
    result = A.balance(*tables, N)
    assert result.scale["applied"] and result.scale["factor"] == 0.01 and result.baseline["source"] == "canonical"
    want = by_hand(MATH, {p: v * 0.01 for p, v in EQ.items()})
    order = sorted(want, key=lambda p: tuple(-v for v in want[p]) + (expand(*p),))
    got = A.ranked_balanced(result).orderBy("rank").collect()
    assert [r["layer_key"] for r in got] == [expand(*p) for p in order]
    assert [r["balanced_score"] for r in got] == pytest.approx([want[p][0] for p in order])
    top = A.top_balanced(result, 3).orderBy("rank").collect()
    assert [r["layer_key"] for r in top] == [expand(*p) for p in order[:3]]
    scores = [r["balanced_score"] for r in got]
    assert abs(statistics.mean(scores)) < 1e-9


def test_missing_baseline_uses_shortest(tables):
    math, eq = tables
    cut = math.filter(F.size("layer_key") > N)
    result = A.balance(cut, eq, N, eq_scale="none")
    assert result.baseline["source"] == "fallback_proxy" and result.baseline["layer_key"] == expand(0, 1)
    assert A.run_summary(result).first()["warnings"] == ["missing canonical baseline"]
    with pytest.raises(Exception, match="no unmodified layer order"):
        A.balance(cut, eq, N, baseline_policy="canonical_only")


def test_flat_metric_counts_as_one(tables, spark):
    math, eq = tables
    result = A.balance(math.withColumn("score", F.lit(0.5)), eq, N)
    assert result.stats["math_std"] == 1.0 and result.stats["math_flat"] and not result.stats["eq_flat"]


def test_percentile_is_exact(tables):
    plain = A.one_row(A.scale_info(A.pin(tables[1])))
    assert f"p95={np.percentile(list(EQ.values()), 95):.4f}" in plain["reason"]


def test_last_score_wins_and_rejects(spark):
    rows = spark.createDataFrame([("(0,1)", "1", 1), ("0,1", "2", 2), ("0,1", '"x"', 3), ("bad", "1", 4), ("layers:0,0,1,2,3,4", '{"score": 9}', 0)],
                                 "raw_key string, p string, seq bigint").withColumn("payload", F.parse_json("p"))
    kept, bad = A.score_table(rows, N)
    assert [tuple(r) for r in kept.collect()] == [(expand(0, 1), 2.0)]
    assert sorted((r["seq"], r["reason"]) for r in bad.collect()) == [(3, "bad_score"), (4, "bad_key")]
    first, _ = A.score_table(rows, N, last_wins=False)
    assert first.first()["score"] == 9.0


def test_grid_fill_and_bounds(spark):
    rows = spark.createDataFrame([("r", 0, 0, 1.0), ("r", 0, 2, 3.0), ("r", 1, 2, 3.0)], "run string, i int, j int, score double")
    cells = {(r["i"], r["j"]): r["value"] for r in A.score_grid(rows, 2, ["run"]).collect()}
    assert len(cells) == 9 and cells[0, 0] == 1.0 and cells[1, 1] == 0.8 and cells[0, 2] == 3.0
    diff = {(r["i"], r["j"]): r["value"] for r in A.score_grid(rows, 2, ["run"], diff=True).collect()}
    assert diff[0, 2] == 2.0 and diff[1, 1] is None
    s = A.diff_summary(rows, ["run"]).first()
    assert (s["best_i"], s["best_j"], s["best_gain"], s["bound"]) == (0, 2, 2.0, 2.0)
    edge = A.clip_bounds(spark.createDataFrame([("r", -1.0), ("r", 0.5)], "run string, value double"), ["run"]).first()
    # spread 0.75 over both values (one positive only), tail ratio 1 / 0.5
    assert edge["vmax"] == pytest.approx(3 * 0.75) and edge["vmin"] == pytest.approx(-2 * 0.75 * 2)


# --- beam ------------------------------------------------------------------

WEIGHTS = [0.3, -0.2, 0.5, 0.1, -0.4]


def scorer(df):
    table = F.create_map(*[F.lit(x) for k, w in enumerate(WEIGHTS) for x in (k, w)])
    total = F.aggregate("layer_key", F.lit(0.0), lambda acc, l: acc + table[l])
    return df.select("layer_key", total.alias("score")), df.select("layer_key", (total * 0.5 + F.size("layer_key") * 0.01).alias("score"))


def insert(seq, i, j):
    at = max(k for k, layer in enumerate(seq) if layer == j - 1) + 1
    return seq[:at] + list(range(i, j)) + seq[at:]


def plain_beam(max_depth, seed_top, pool_size, width, limit, penalty):
    m = lambda s: sum(WEIGHTS[x] for x in s)
    q = lambda s: m(s) * 0.5 + len(s) * 0.01
    seqs = {p: expand(*p) for p in PAIRS}
    bm, bq = m(seqs[0, 0]), q(seqs[0, 0])
    dm, dq = z([m(s) - bm for p, s in seqs.items() if p != (0, 0)]), z([q(s) - bq for p, s in seqs.items() if p != (0, 0)])
    score = lambda s: ((m(s) - bm - dm[0]) / dm[1] + (q(s) - bq - dq[0]) / dq[1])
    rank = lambda s: (-round(score(s), 9), -round(q(s), 9), -round(m(s), 9), s)
    done = {tuple(s): ([p] if p != (0, 0) else []) for p, s in seqs.items()}
    singles = sorted((s for p, s in seqs.items() if p != (0, 0)), key=rank)
    pool = [(done[tuple(s)][0], score(s)) for s in singles[:pool_size]]
    frontier = [(done[tuple(s)], s) for s in singles[:min(seed_top, pool_size)]]
    for _ in range(2, max_depth + 1):
        props = {}
        for a, (blocks, s) in enumerate(frontier):
            for b, (block, bs) in enumerate(pool):
                new = insert(s, *block)
                key = (-(score(s) + bs), a, b)
                if tuple(new) not in done and (tuple(new) not in props or key < props[tuple(new)][0]):
                    props[tuple(new)] = (key, blocks + [block])
        picked = sorted(props.items(), key=lambda kv: kv[1][0])[:limit]
        for seq, (_, blocks) in picked:
            done[seq] = blocks
        frontier = [(done[tuple(s)], s) for s in sorted((list(k) for k, _ in picked), key=rank)[:width]]
    return {k: (v, score(list(k)) - penalty * (len(k) - N) / N) for k, v in done.items()}


def test_beam_search_matches_plain_python_and_resumes(spark, tmp_path):
    keys = spark.createDataFrame([(i, j, expand(i, j)) for i, j in PAIRS], "i int, j int, layer_key array<int>")
    math, eq = scorer(keys)
    pairs = keys.join(math.withColumnRenamed("score", "math_score"), "layer_key").join(eq.withColumnRenamed("score", "eq_score"), "layer_key")
    calls = []

    def counted(df):
        calls.append(1)
        return scorer(df)

    run = lambda: B.beam_search(pairs, counted, N, str(tmp_path / "beam"), max_depth=3, seed_top=3, pool_size=4, width=3, max_candidates=6, penalty=0.5)
    result = run()
    want = plain_beam(3, 3, 4, 3, 6, 0.5)
    got = {tuple(r["layer_key"]): ([tuple(b) for b in r["blocks"]], r["final_score"]) for r in result.entries.collect()}
    assert set(got) == set(want)
    for k in want:
        assert got[k][1] == pytest.approx(want[k][1])
    assert result.depths == [2, 3] and result.stop_reason == "max_depth_reached"
    reg = B.registry(result.events)
    states = {r["last_status"]: r["n"] for r in B.status_counts(reg).collect()}
    assert states == {"evaluated": len(want)}
    again = run()
    assert again.entries.count() == len(want) == again.saved.count()


def test_resumed_search_equals_a_fresh_one(spark, tmp_path):
    """Late scores, other seeds and other parameters in between do not change what a search finds."""
    keys = spark.createDataFrame([(i, j, expand(i, j)) for i, j in PAIRS], "i int, j int, layer_key array<int>")
    math, eq = scorer(keys)
    pairs = keys.join(math.withColumnRenamed("score", "math_score"), "layer_key").join(eq.withColumnRenamed("score", "eq_score"), "layer_key")
    changed = pairs.withColumn("math_score", -F.col("math_score"))
    late = lambda df: (scorer(df)[0], scorer(df)[1].limit(2))
    silent = lambda df: tuple(t.limit(0) for t in scorer(df))

    def run(seeds, score, folder, **other):
        return B.beam_search(seeds, score, N, str(tmp_path / folder), **{"max_depth": 3, "seed_top": 3, "pool_size": 4, "width": 3, "max_candidates": 6, "penalty": 0.5, **other})

    def found(result):
        return sorted((r["block_spec"], r["layer_key"], round(r["method_score"], 9), round(r["final_score"], 9)) for r in result.entries.collect())

    first = run(pairs, late, "a", max_depth=2)
    assert {r["last_status"] for r in B.status_counts(B.registry(first.events)).collect()} == {"evaluated", "missing_scores"}
    other = run(changed, scorer, "a")
    late_ones, fresh = run(pairs, scorer, "a"), run(pairs, scorer, "b")
    resumed = run(pairs, silent, "a")
    known = {tuple(r["layer_key"]) for r in first.events.sparkSession.read.parquet(str(tmp_path / "a" / f"scores-{N}")).where("math_score is not null").collect()}
    assert {tuple(r["layer_key"]) for r in resumed.entries.where("depth > 1").collect()} <= known
    assert found(resumed) == found(late_ones) == found(fresh)
    present = {r["block_spec"]: r["method_score"] for r in resumed.saved.collect()}
    assert set(present) >= {r["block_spec"] for r in other.entries.collect()}
    assert all(present[r["block_spec"]] == r["method_score"] for r in resumed.entries.collect())


def test_missing_scores_leave_the_frontier(spark, tmp_path):
    keys = spark.createDataFrame([(i, j, expand(i, j)) for i, j in PAIRS], "i int, j int, layer_key array<int>")
    math, eq = scorer(keys)
    pairs = keys.join(math.withColumnRenamed("score", "math_score"), "layer_key").join(eq.withColumnRenamed("score", "eq_score"), "layer_key")
    none = lambda df: tuple(t.limit(0) for t in scorer(df))
    result = B.beam_search(pairs, none, N, str(tmp_path / "beam"), max_depth=4, seed_top=2, pool_size=2)
    assert result.stop_reason == "frontier_empty"
    assert {r["last_status"] for r in B.status_counts(B.registry(result.events)).collect()} == {"evaluated", "missing_scores"}


def test_stop_rule():
    rule = B.StopRule(min_improvement=0.1, streak=2, no_replace_streak=2, started=0.0)
    rule.start(1.0, "a")
    assert rule.update(1.05, "b", 10.0) is None and rule.kept == 0 and rule.low == 1
    assert rule.update(1.05, "b", 10.0) is None
    assert rule.update(1.05, "b", 10.0).startswith("plateau")
    off = B.StopRule(streak=1, no_replace_streak=1, max_hours=1.0, started=0.0)
    off.start(1.0, "a")
    assert off.update(1.0, "a", 10.0) is None and off.update(1.0, "a", 4000.0) == "max_hours_reached_1.00h"


def test_seed_needs_baseline(spark):
    rows = spark.createDataFrame([(0, 1, 1.0, 1.0)], "i int, j int, math_score double, eq_score double")
    with pytest.raises(ValueError):
        B.seed_entries(rows, N)


def test_rescored_specs(spark):
    specs = spark.createDataFrame([([], 0), ([(0, 1)], 1), ([(1, 2)], 2)], f"blocks {L.BLOCK_ARRAY}, seq bigint")
    scores = spark.createDataFrame([(expand(0, 0), 1.0, 1.0), (expand(0, 1), 2.0, 3.0)], "layer_key array<int>, math_score double, eq_score double")
    entries, stats, missing = B.seed_from_specs(specs, scores, N)
    assert entries.count() == 2 and missing.first()["seq"] == 2 and stats.baseline["math_score"] == 1.0
    with pytest.raises(ValueError):
        B.seed_from_specs(specs.filter("seq > 0"), scores, N)
    proxy, stats, _ = B.seed_from_specs(specs.filter("seq > 0"), scores, N, require_baseline=False)
    assert stats.baseline["layer_key"] == expand(0, 1)
