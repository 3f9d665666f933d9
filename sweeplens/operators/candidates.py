"""Candidate generation, scoring and selection at pool scale.

Generation is one map over candidate ids: all randomness is a hash of seed, id
and step, so the pool is the same for any number of partitions and a retried
task repeats its rows exactly.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweeplens.functions import layers as L
from sweeplens.operators.analysis import one_row
from sweeplens.operators.boosting import Ensemble, predicted
from sweeplens.operators.ordering import global_rank, top_n
from sweeplens.session import pin

POOL_SCHEMA = "candidate_id bigint, source string, counts array<int>, extra_layers int"
ADD_SHARE = 0.65  # fixed value: share of mutation steps that add a repeat
BROADCAST_ANCHORS = 10_000  # up to so many are sent to all tasks, more are joined by their number

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _uniform(seed: int, ids: np.ndarray, draw: int) -> np.ndarray:
    """Uniform [0, 1) per id from a 64-bit mix of (seed, id, draw)."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x += np.uint64(seed % 2**63) * np.uint64(0xD1B54A32D192ED03) + np.uint64(draw) * np.uint64(0x8CB92BA72F3D8DD7)
        for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(mul)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)) * (1.0 / (1 << 53))


def _pick(mask: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A uniform True column per row, and whether the row has one."""
    run = np.cumsum(mask, axis=1, dtype=np.int32)
    size = run[:, -1]
    nth = np.minimum((u * size).astype(np.int32), np.maximum(size - 1, 0))
    return (run > nth[:, None]).argmax(axis=1), size > 0


def _shift(counts: np.ndarray, rows: np.ndarray, u: np.ndarray, add: bool, cap: int) -> None:
    """Add or remove one repeat on a uniform eligible layer of each row in place."""
    if rows.size == 0:
        return
    part = counts[rows]
    layer, ok = _pick(part < cap if add else part > 1, u[rows])
    counts[rows[ok], layer[ok]] += 1 if add else -1


def _make(ids: np.ndarray, counts: np.ndarray, mutate: np.ndarray, n: int, max_extra: int, cap: int, steps: int, seed: int) -> np.ndarray:
    """Count vectors of candidates from their first vectors, changed in place."""
    u = _uniform(seed, ids, 2)
    grown = np.minimum((u * (max_extra + 1)).astype(np.int64), n * (cap - 1))
    moves = np.where(mutate, 1 + (u * steps).astype(np.int64), grown)
    for step in range(int(moves.max(initial=0))):
        u, v = _uniform(seed, ids, 3 + 2 * step), _uniform(seed, ids, 4 + 2 * step)
        live = moves > step
        add = live & (~mutate | (v < ADD_SHARE))
        _shift(counts, np.flatnonzero(add), u, True, cap)
        _shift(counts, np.flatnonzero(live & ~add), u, False, cap)
    draw = 1 << 20
    while True:  # trim to the extra-layer limit
        over = np.flatnonzero((counts.sum(axis=1) - n > max_extra) & (counts > 1).any(axis=1))
        if over.size == 0:
            return counts
        _shift(counts, over, _uniform(seed, ids, draw), False, cap)
        draw += 1


def _drawn(seed: int, draw: int) -> Column:
    """Uniform [0, 1) per candidate id."""
    return F.shiftrightunsigned(F.xxhash64(F.col("candidate_id"), F.lit(seed).cast("long"), F.lit(draw).cast("long")), 11) * (1.0 / (1 << 53))


def anchor_table(rows: DataFrame, n: int, column: str = "counts_csv") -> DataFrame:
    """Usable anchors; rows with a bad vector are skipped."""
    counts = L.counts_from_csv(F.col(column), n)
    return rows.select(counts.alias("counts")).filter("counts is not null")


def generate(ids: DataFrame, n: int, max_extra: int = 24, max_repeat: int = 8, anchors: DataFrame | None = None,
             anchor_share: float = 0.45, mutation_steps: int = 8, seed: int = 42, rows_per_batch: int = 8192) -> DataFrame:
    """One candidate per ``candidate_id``.

    A share of the candidates begins at an anchor, which it draws by its number in
    the anchors' order; the all-ones vector is number 0.  Anchors may be any
    number: only a table counted to be small is sent to all tasks.
    """
    if not 0 <= anchor_share <= 1 or max_extra < 0 or max_repeat < 0:
        raise ValueError("anchor_share must be in [0, 1], limits must not be negative")
    cap, steps = 1 + max_repeat, max(1, mutation_steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(["random", "anchor_mutation"])
        for batch in batches:
            for at in range(0, batch.num_rows, rows_per_batch):
                part = batch.slice(at, rows_per_batch)
                ids, mutated = part["candidate_id"].to_numpy(), part["mutate"].to_numpy(zero_copy_only=False)
                counts = np.ones((ids.size, n), dtype=np.int32)
                given = part["base"].is_valid().to_numpy(zero_copy_only=False)
                if given.any():
                    counts[given] = part["base"].flatten().to_numpy().reshape(-1, n)
                _make(ids, counts, mutated, n, max_extra, cap, steps, seed)
                offsets = pa.array(np.arange(ids.size + 1, dtype=np.int32) * n)
                yield pa.RecordBatch.from_arrays(
                    [part["candidate_id"], names.take(pa.array(mutated.astype(np.int8))),
                     pa.ListArray.from_arrays(offsets, pa.array(counts.ravel())),
                     pa.array((counts.sum(axis=1) - n).astype(np.int32))],
                    names=["candidate_id", "source", "counts", "extra_layers"])

    drawn = ids.select(F.col("candidate_id").cast("long")).withColumn("mutate", _drawn(seed, 0) < anchor_share)
    if anchors is None:
        begun = drawn.withColumn("base", F.lit(None).cast("array<int>"))
    else:
        numbered = pin(global_rank(anchors.select(F.col("counts").cast("array<int>").alias("base")), ["base"], "_number"))
        size = numbered.count()
        table = F.broadcast(numbered) if size <= BROADCAST_ANCHORS else numbered
        number = F.when(F.col("mutate"), F.floor(_drawn(seed, 1) * (size + 1)))
        wanted = F.when(number > 0, number).otherwise(-F.col("candidate_id") - 1)  # others match nothing, and do not meet at one key
        begun = drawn.withColumn("_wanted", wanted).join(table, F.col("_wanted") == F.col("_number"), "left").select("candidate_id", "mutate", "base")
    return describe(begun.mapInArrow(run, POOL_SCHEMA), n)


def describe(candidates: DataFrame, n: int) -> DataFrame:
    """Extra layers, overhead and CSV form of count vectors."""
    if "extra_layers" not in candidates.columns:
        total = F.aggregate("counts", F.lit(0), lambda a, x: a + x)
        candidates = candidates.withColumn("extra_layers", total - n)
    # The CSV form stays a plain projection: filters move below it, so only kept rows pay for it.
    return candidates.withColumn("relative_overhead", F.col("extra_layers") / n).withColumn(
        "counts_csv", L.counts_to_csv(F.col("counts")))


# --- scoring ---------------------------------------------------------------

def linear_predictor(weights: dict[str, list[float]]) -> Callable[[DataFrame], DataFrame]:
    """Weighted sums of counts as predictions.

    A loop over the array: one term per layer in generated code would make a
    method too long for the JVM to compile.
    """
    def total(w: list[float]) -> Column:
        table = F.array(*[F.lit(float(x)) for x in w])
        products = F.zip_with("counts", table, lambda c, x: c * x)
        return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)

    return lambda df: df.select("*", *[total(w).alias(f"pred_{name}") for name, w in weights.items()])


def model_predictor(models: dict[str, Ensemble]) -> Callable[[DataFrame], DataFrame]:
    """Trained tree ensembles (``boosting.Ensemble`` by target) as predictions."""
    def predict(df: DataFrame) -> DataFrame:
        return predicted(df, models)

    predict.method = lambda df: predicted(df, {"method": models["method"]})
    predict.floors = lambda df: predicted(df, {name: m for name, m in models.items() if name != "method"})
    return predict


def score(candidates: DataFrame, predictor: Callable[[DataFrame], DataFrame], penalty: float = 0.5,
          min_math: float = -0.02, min_eq: float = -0.02) -> DataFrame:
    """Three predictions, both floors as ``accepted`` and the penalised score."""
    out = predictor(candidates)
    ok = (F.col("pred_math") >= min_math) & (F.col("pred_eq") >= min_eq)
    return out.withColumn("accepted", ok).withColumn(
        "pred_final", F.col("pred_method") - F.col("relative_overhead") * float(penalty))


def _best_per_vector(rows: DataFrame) -> DataFrame:
    """Best row per count vector; ties go to the smaller id."""
    rest = [c for c in rows.columns if c != "counts_csv"]
    best = F.max_by(F.struct(*rest), F.struct("pred_final", -F.col("candidate_id")))
    return rows.groupBy("counts_csv").agg(best.alias("_b")).select("counts_csv", "_b.*")


def _floor(probe: DataFrame, k: int) -> float | None:
    """The ``k``-th best distinct score of accepted probe rows, or None where there are fewer."""
    seen = _best_per_vector(probe.filter("accepted").select("counts_csv", "candidate_id", "pred_final"))
    best = seen.orderBy(F.desc("pred_final"), F.asc("candidate_id")).limit(k)
    found = one_row(best.agg(F.count("*").alias("n"), F.min("pred_final").alias("low")))
    return found["low"] if found["n"] == k else None


def distinct_top_k(scored: DataFrame, k: int, probe: DataFrame | None = None) -> DataFrame:
    """Exactly the ``k`` best distinct count vectors.

    Deduplicating the whole pool would shuffle every vector.  ``probe`` is any
    subset of the scored rows: if it has k distinct vectors, their lowest score
    is a floor the true top k cannot fall below, and only rows above it are
    shuffled.  A probe with fewer vectors sets no floor.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    rows = scored.filter("accepted")
    order = [F.desc("pred_final"), F.asc("candidate_id")]
    if probe is not None:
        floor = _floor(probe, k)
        if floor is not None:
            rows = rows.filter(F.col("pred_final") >= floor)
    return top_n(_best_per_vector(rows), order, k)


def search(ids: DataFrame, n: int, predictor: Callable[[DataFrame], DataFrame], k: int = 100, penalty: float = 0.5,
           min_math: float = -0.02, min_eq: float = -0.02, probe_share: float = 0.02, **options) -> DataFrame:
    """Generate, score and select in one job; nothing is written in between.

    The probe generates and scores only its own share of the ids.  Models that cost
    a walk are asked in turn: a row whose method score lies below the probe's floor
    cannot be chosen, whatever the other two say of it.
    """
    if k < 1:
        raise ValueError("k must be >= 1")

    def scored(part: DataFrame) -> DataFrame:
        return score(generate(part, n, **options), predictor, penalty, min_math, min_eq)

    probe = scored(ids.sample(probe_share, 7))
    if not hasattr(predictor, "method"):
        return distinct_top_k(scored(ids), k, probe)
    floor = _floor(probe, k)
    if floor is None:
        return distinct_top_k(scored(ids), k)
    final = F.col("pred_method") - F.col("relative_overhead") * float(penalty)
    high = predictor.method(generate(ids, n, **options)).filter(final >= floor)
    return distinct_top_k(score(high, predictor.floors, penalty, min_math, min_eq), k)


def score_summary(scored: DataFrame, k: int) -> DataFrame:
    return scored.agg(
        F.count("*").alias("rows_scanned"), F.count_if("accepted").alias("rows_accepted")).withColumn("top_k_requested", F.lit(k))


def topk_config(top: DataFrame, n: int, include_baseline: bool = True) -> DataFrame:
    """Worker lines and manifest rows of a top-k list, baseline first when asked."""
    counts = L.counts_from_csv(F.col("counts_csv"), n)
    preds = ["pred_method", "pred_math", "pred_eq", "pred_final"]
    rows = top.withColumn("layer_key", L.decode_counts(counts, n)).select(
        F.col("rank").cast("int").alias("rank"), L.layer_spec(F.col("layer_key")).alias("config_line"), "layer_key",
        L.extra_layers(F.col("layer_key"), n).alias("extra_layers"), "relative_overhead", *preds, "source",
        F.col("candidate_id").cast("string").alias("candidate_id"), "counts_csv")
    if not include_baseline:
        return rows
    zero = [F.lit(0.0).alias(p) for p in preds]
    base = top.sparkSession.range(1).select(
        F.lit(0).alias("rank"), F.lit("0,0").alias("config_line"), L.baseline_layers(n).alias("layer_key"),
        F.lit(0).alias("extra_layers"), F.lit(0.0).alias("relative_overhead"), *zero, F.lit("forced_baseline").alias("source"),
        F.lit("baseline").alias("candidate_id"), F.lit(None).cast("string").alias("counts_csv"))
    return base.unionByName(rows)
