"""Boosted trees against a plain-Python booster, other numbers of tasks, and odd inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweeplens.operators import boosting as B

SCHEMA = "key bigint, x array<int>, a double, b double"


def table(n, width=4, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        x = [rng.randrange(1, 5) for _ in range(width)]
        rows.append((k, x, x[0] * 2.0 - x[1] + rng.random(), float(x[2] * x[3]) - 4 + rng.random()))
    return rows


def plain(xs, ys, hashes, spec):
    """Trees as nested tuples, one row, feature and cut at a time."""
    n, width = len(xs), len(xs[0])
    values = [sorted({x[f] for x in xs}) for f in range(width)]
    base = sum(ys) / n
    predicted, trees = [base] * n, []

    def leaf(rows, g):
        return -spec.eta * sum(g[r] for r in rows) / (len(rows) + 1.0)

    def grow(rows, g, columns, depth):
        best = (1e-6, None)
        total, count = sum(g[r] for r in rows), len(rows)
        for f in columns if depth else []:
            for low, high in zip(values[f], values[f][1:]):
                cut = (low + high) / 2
                left = [r for r in rows if xs[r][f] < cut]
                if not left or len(left) == count:
                    continue
                s, m = sum(g[r] for r in left), len(left)
                gain = s * s / (m + 1.0) + (total - s) ** 2 / (count - m + 1.0) - total * total / (count + 1.0)
                if gain > best[0] + 1e-9:
                    best = (gain, (f, cut))
        if best[1] is None:
            return leaf(rows, g)
        f, cut = best[1]
        return (f, cut, grow([r for r in rows if xs[r][f] < cut], g, columns, depth - 1),
                grow([r for r in rows if xs[r][f] >= cut], g, columns, depth - 1))

    for turn in range(spec.rounds):
        sampled = B.drawn(hashes, spec.seed, turn) < spec.subsample
        columns = B.drawn_columns(width, spec.colsample, spec.seed, turn).tolist()
        g = [p - y for p, y in zip(predicted, ys)]
        trees.append(grow([r for r in range(n) if sampled[r]], g, columns, spec.depth))
        predicted = [p + walk(trees[-1], x) for p, x in zip(predicted, xs)]
    return base, trees


def walk(tree, x):
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] < tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("spec", [B.Spec(12, 3, 0.3), B.Spec(25, 4, 0.1, 0.8, 0.5, 7), B.Spec(3, 1, 1.0, 0.9, 1.0, 3)])
def test_equals_a_plain_booster(spark, spec):
    rows = table(70)
    frame = spark.createDataFrame(rows, SCHEMA)
    nodes = B.fit(frame, "x", {"first": "a", "second": "b"}, "key", spec)
    hashes = np.array([r[0] for r in frame.select(F.xxhash64("key")).collect()])
    for target, place in (("first", 2), ("second", 3)):
        base, trees = plain([r[1] for r in rows], [r[place] for r in rows], hashes, spec)
        model = B.Ensemble.of(nodes, target, spec)
        want = [base + sum(walk(t, r[1]) for t in trees) for r in rows]
        assert model.predict(np.array([r[1] for r in rows], dtype=float)) == pytest.approx(want, abs=1e-9)
        assert nodes.where((F.col("target") == target) & (F.col("tree") >= 0)).agg(F.count_distinct("tree")).first()[0] == spec.rounds


def test_any_number_of_tasks_gives_the_same_trees(spark, monkeypatch):
    frame = spark.createDataFrame(table(60), SCHEMA)
    spec = B.Spec(3, 2, 0.2, 0.7, 0.75)
    found = []
    for cells in (1 << 20, 80):
        monkeypatch.setattr(B, "CELLS_PER_TASK", cells)
        found.append(sorted(map(str, B.fit(frame.repartition(3), "x", {"t": "a"}, "key", spec).collect())))
    assert found[0] == found[1] and len(found[0]) > 10


def test_predictions_and_importance(spark):
    frame = spark.createDataFrame(table(80), SCHEMA)
    spec = B.Spec(20, 3, 0.3)
    nodes = B.fit(frame, "x", {"t": "a"}, "key", spec)
    model = B.Ensemble.of(nodes, "t", spec)
    odd = frame.select("key", F.when(F.col("key") % 5 > 0, F.col("x")).alias("counts"), F.lit(1).alias("pred_u"))
    for r in B.predicted(odd, {"t": model}).collect():
        want = None if r["counts"] is None else model.predict(np.array([r["counts"]], dtype=float))[0]
        assert r["pred_t"] == (want if want is None else pytest.approx(want))
    used = {r["layer_idx"]: r for r in B.importance(nodes, "t", 6).collect()}
    assert set(used) == set(range(6)) and used[0]["gain"] > used[2]["gain"] and used[5]["weight"] == 0.0
    assert sum(r["weight"] for r in used.values()) == nodes.where("feature is not null").count()


def test_many_values_are_binned(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 2))
    codes, cuts = B.binned(x, [np.unique(x[:, 0]), np.unique(x[:, 1])])
    assert codes.max() == B.MAX_BINS - 1 and all(c.size == B.MAX_BINS - 1 for c in cuts)
    assert np.bincount(codes[:, 0]).max() < 40


def test_edges(spark):
    frame = spark.createDataFrame(table(5), SCHEMA)
    for bad in (frame.limit(0), frame.withColumn("a", F.lit(None).cast("double")), frame.withColumn("x", F.array(F.lit(1), F.lit(None)))):
        with pytest.raises(ValueError, match="every row"):
            B.fit(bad, "x", {"t": "a"}, "key", B.Spec(1, 1, 0.1))
    same = frame.withColumn("a", F.lit(0.0))
    model = B.Ensemble.of(B.fit(same, "x", {"t": "a"}, "key", B.Spec(2, 2, 0.1)), "t", B.Spec(2, 2, 0.1))
    assert model.predict(np.ones((2, 4))).tolist() == [0.0, 0.0]
    one = B.fit(frame.limit(1), "x", {"t": "a"}, "key", B.Spec(2, 2, 0.1))
    first = frame.limit(1).first()
    assert math.isclose(B.Ensemble.of(one, "t", B.Spec(2, 2, 0.1)).predict(np.array([first["x"]], dtype=float))[0], first["a"])
