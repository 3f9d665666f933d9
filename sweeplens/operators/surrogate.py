"""Training data, regressors and diagnostics of the score surrogate."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweeplens.functions import layers as L
from sweeplens.functions.text import path_stamp, stable_hash
from sweeplens.operators import boosting
from sweeplens.operators.analysis import KEY, Balanced, one_row, with_baseline
from sweeplens.operators.boosting import Ensemble, Spec
from sweeplens.operators.ordering import global_rank, grouped_rank, latest
from sweeplens.session import pin

# Source ranks, boosting presets (rounds are scaled by the caller), bin limits.
SOURCE_RANKS = {"beam": 3, "single_block": 2}
PRESETS = (
    {"rounds": 500, "depth": 6, "eta": 0.05, "subsample": 0.9, "colsample": 0.9},
    {"rounds": 700, "depth": 4, "eta": 0.08, "subsample": 0.85, "colsample": 0.85},
    {"rounds": 900, "depth": 8, "eta": 0.03, "subsample": 0.9, "colsample": 0.8},
    {"rounds": 350, "depth": 6, "eta": 0.1, "subsample": 0.95, "colsample": 0.95},
)
TARGETS = {"method": "balanced_score", "math": "math_delta", "eq": "eq_delta"}
GATE_SPEARMAN = 0.60


def source_rank(source: Column) -> Column:
    out = F.lit(1)
    for name, rank in SOURCE_RANKS.items():
        out = F.when(source == name, rank).otherwise(out)
    return out


def merge_sources(records: DataFrame) -> DataFrame:
    """One record per layer key by (source rank, run stamp, file time); ties keep the first.

    ``records`` has ``layer_key, score, source, source_path, mtime, seq``.
    """
    stamped = records.withColumn("stamp", path_stamp(F.col("source_path")))
    order = [source_rank(F.col("source")), F.col("stamp"), F.col("mtime"), -F.col("seq")]
    return latest(stamped, [KEY], order).drop("seq")


def feature_table(result: Balanced) -> DataFrame:
    """Count vectors with three targets, the baseline included with zeros."""
    counts = L.encode_counts(F.col(KEY), result.n)
    return with_baseline(result).withColumn("counts", counts)


def label_summary(features: DataFrame) -> DataFrame:
    aggs = [F.count("*").alias("n_rows")]
    for name, column in TARGETS.items():
        aggs += [F.avg(column).alias(f"{name}_mean"), F.stddev_pop(column).alias(f"{name}_std")]
    return features.agg(*aggs)


# --- order statistics ------------------------------------------------------

def quantile_bins(df: DataFrame, value: str, bins: int, tie: list, name: str = "bin", total: int | None = None) -> DataFrame:
    """Equal-count bins by rank: ``floor((rank + 0.5) / n * bins)``, rank from 0."""
    if bins < 1:
        raise ValueError("bins must be >= 1")
    ranked = global_rank(df, [F.col(value), *tie], "_rk", start=0)
    n = F.lit(float(total if total is not None else df.count()))
    raw = F.floor((F.col("_rk") + 0.5) / n * bins)
    return ranked.withColumn(name, F.least(F.lit(bins - 1), raw).cast("int")).drop("_rk")


def spearman(df: DataFrame, a: str, b: str, tie: list, groups: list[str] | None = None) -> DataFrame:
    """Rank correlation with ordinal ranks, ties in ``tie`` order, over the table or inside groups.

    Ordinal ranks are a permutation, so the closed form in rank differences is
    exact and no variance can vanish; fewer than two rows give 0.
    """
    groups = groups or []
    for column, name in ((a, "_ra"), (b, "_rb")):
        order = [F.col(column), *tie]
        df = grouped_rank(df, groups, order, name) if groups else global_rank(df, order, name)
    gap = (F.col("_ra") - F.col("_rb")).cast("double")
    s = df.groupBy(*groups).agg(F.count("*").alias("n"), F.sum(gap * gap).alias("d2"))
    n = F.col("n").cast("double")
    return s.select(*groups, "n", F.when(F.col("n") >= 2, 1.0 - 6.0 * F.col("d2") / (n * (n * n - 1.0))).otherwise(0.0).alias("spearman"))


def mae(df: DataFrame, a: str, b: str, groups: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(groups or [])).agg(F.avg(F.abs(F.col(a) - F.col(b))).alias("mae"))


# --- hold-out --------------------------------------------------------------

def allocate(sizes: dict[int, int], frac: float) -> dict[int, int]:
    """Hold-out rows per bin: floors first, then largest remainders in turn.

    Each bin keeps a training row.  The input has at most ten bins.
    """
    total = sum(sizes.values())
    target = min(max(1, round(total * frac)), total - 1)
    room = {b: size - 1 for b, size in sizes.items()}
    taken = {b: min(int(frac * size), room[b]) for b, size in sizes.items()}
    turn = sorted(sizes, key=lambda b: (frac * sizes[b] - taken[b], b), reverse=True)
    while (left := target - sum(taken.values())) > 0:
        open_bins = [b for b in turn if taken[b] < room[b]][:left]
        if not open_bins:
            break
        for b in open_bins:
            taken[b] += 1
    return taken


def holdout_split(df: DataFrame, value: str, key: str, frac: float, seed: int, text: Column | None = None) -> DataFrame:
    """Stratified split column ``split``: ``train`` or ``holdout``.

    Rows are drawn per value bin in seeded hash order; ``text`` is what is
    hashed (the key as text).
    """
    df = pin(df)
    n = df.count()
    if n < 3:
        ranked = global_rank(df, [F.col(key)], "_rk")
        return ranked.withColumn("split", F.when(F.col("_rk") == n, "holdout").otherwise("train")).drop("_rk") if n > 1 else \
            df.withColumn("split", F.lit("train"))
    binned = pin(quantile_bins(df, value, min(10, max(2, n // 20)), [F.col(key)], total=n))
    sizes = {r["bin"]: r["n"] for r in binned.groupBy("bin").agg(F.count("*").alias("n")).collect()}  # at most 10 rows
    plan = F.create_map(*[F.lit(x) for kv in allocate(sizes, frac).items() for x in kv])
    hashed = stable_hash(seed, text if text is not None else F.array_join(key, ","))
    ranked = grouped_rank(binned, ["bin"], [hashed, F.col(key)], "_rk")
    return ranked.withColumn("split", F.when(F.col("_rk") <= plan[F.col("bin")], "holdout").otherwise("train")).drop("_rk")


# --- training --------------------------------------------------------------

@dataclass
class Surrogate:
    """The best trial's models, their node table, and the report of every trial."""

    models: dict[str, Ensemble]
    nodes: DataFrame
    trials: list[dict]
    best: int
    gate_passed: bool


def predict(df: DataFrame, models: dict[str, Ensemble]) -> DataFrame:
    return boosting.predicted(df, models)


def train(split: DataFrame, retries: int = 3, rounds_scale: float = 1.0, seed: int = 42,
          gate: float = GATE_SPEARMAN) -> Surrogate:
    """Three regressors per preset; the trial with the best hold-out rank wins.

    A preset is one barrier job that grows its three regressors in step; presets
    run side by side as far as the cluster has slots.
    """
    data = pin(split.select(KEY, "counts", "split", *TARGETS.values()))
    fit_rows, hold = data.filter("split = 'train'"), data.filter("split = 'holdout'")
    spark = split.sparkSession
    specs = [Spec(max(1, round(p["rounds"] * rounds_scale)), p["depth"], p["eta"], p["subsample"], p["colsample"], seed + index)
             for index, p in enumerate(PRESETS[: 1 + max(0, retries)])]
    with ThreadPoolExecutor(len(specs)) as pool:
        fit = inheritable_thread_target(spark)(boosting.fit)
        tables = list(pool.map(lambda spec: fit(fit_rows, "counts", TARGETS, KEY, spec), specs))
    found = [{t: Ensemble.of(nodes, t, spec) for t in TARGETS} for spec, nodes in zip(specs, tables)]
    everything = {f"{index}_{t}": model for index, models in enumerate(found) for t, model in models.items()}
    pair = [F.struct(F.lit(name).alias("model"), F.col(TARGETS[name.split("_")[1]]).alias("label"), F.col(f"pred_{name}").alias("pred")) for name in everything]
    scored = pin(predict(hold, everything).select(KEY, F.inline(F.array(*pair))))
    ranks = {r["model"]: r["spearman"] for r in spearman(scored, "label", "pred", [F.col(KEY)], ["model"]).collect()}  # a row for each model
    errors = {r["model"]: r["mae"] for r in mae(scored, "label", "pred", ["model"]).collect()}
    trials = []
    for index, spec in enumerate(specs):
        report = {"trial": index + 1, "rounds": spec.rounds, "depth": spec.depth, "eta": spec.eta, "subsample": spec.subsample, "colsample": spec.colsample}
        for t in TARGETS:
            report[f"spearman_{t}"], report[f"mae_{t}"] = ranks.get(f"{index}_{t}", 0.0), errors.get(f"{index}_{t}")
        trials.append(report)
    best = max(range(len(trials)), key=lambda k: (trials[k]["spearman_method"], -k))
    return Surrogate(found[best], tables[best], trials, best + 1, trials[best]["spearman_method"] >= gate)


def trial_table(spark, result: Surrogate, gate: float = GATE_SPEARMAN) -> DataFrame:
    rows = spark.createDataFrame(result.trials)
    return rows.withColumn("is_best", F.col("trial") == result.best).withColumn(
        "gate_passed", F.col("spearman_method") >= gate)


def feature_importance(result: Surrogate, n: int, target: str = "method") -> DataFrame:
    """Mean gain, mean cover and split count per layer."""
    return boosting.importance(result.nodes, target, n)


def predicted_vs_true(split: DataFrame, models: dict[str, Ensemble]) -> DataFrame:
    return predict(split, models).select(KEY, "split", *TARGETS.values(), *[f"pred_{t}" for t in TARGETS])


def training_table(features: DataFrame, math: DataFrame, eq: DataFrame, n: int) -> DataFrame:
    """Features with the provenance of both metrics."""
    def origin(records: DataFrame, metric: str) -> DataFrame:
        return records.select(KEY, F.col("source").alias(f"{metric}_source"), F.col("source_path").alias(f"{metric}_source_path"))

    key = F.col(KEY)
    out = features.join(origin(math, "math"), KEY, "left").join(origin(eq, "eq"), KEY, "left")
    blank = F.lit("")
    named = ("math_source", "eq_source", "math_source_path", "eq_source_path")
    return out.select(
        KEY, "math_score", "eq_score", "math_delta", "eq_delta", "balanced_score",
        *[F.coalesce(c, blank).alias(c) for c in named], L.is_baseline(key, n).alias("is_baseline"),
        is_single_block(key, n).alias("is_single_block"), L.extra_layers(key, n).alias("extra_layers"),
        L.relative_overhead(key, n).alias("relative_overhead"), L.counts_to_csv(F.col("counts")).alias("counts_csv"))


def is_single_block(layers: Column, n: int) -> Column:
    """True when the sequence is exactly one block run twice.

    The first step that does not go up by one marks the block: it jumps from
    ``j - 1`` back to ``i``.
    """
    def check(cut: Column) -> Column:
        j, i = F.get(layers, cut - 1) + 1, F.get(layers, cut)
        return F.coalesce((cut > 0) & (layers == L.expand_block(n, i, j)), F.lit(False))

    steps = F.zip_with(F.slice(layers, F.lit(2), F.size(layers)), layers, lambda b, a: b.isNotNull() & (b != a + 1))
    return L.let(F.array_position(steps, F.lit(True)).cast("int"), check)
