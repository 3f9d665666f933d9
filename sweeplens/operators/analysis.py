"""Balanced two-metric analysis, grids and plot bounds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweeplens.functions import layers as L
from sweeplens.functions.payload import payload_score
from sweeplens.operators.config_space import split_rejects
from sweeplens.operators.ordering import global_rank, latest, quantile_value, top_n
from sweeplens.operators.stage import computed
from sweeplens.session import pin

KEY = "layer_key"
MIN_STD = 1e-12
PERCENT_LIMIT = 1.5  # fixed value: above it a unit-scale score must be a percentage
RANKING = ["balanced_score", "eq_delta", "math_delta"]


# --- score tables ----------------------------------------------------------

def score_table(raw: DataFrame, n: int, seq: str = "seq", last_wins: bool = True) -> tuple[DataFrame, DataFrame]:
    """Raw keys and payloads to one score per layer key, plus the rejected rows.

    ``raw`` has ``raw_key`` text, ``payload`` VARIANT and an arrival number.
    Unusable rows are set aside before duplicates are resolved, so a bad late
    row does not hide a good earlier one.
    """
    parsed = computed(raw, **{KEY: L.parse_spec(n, F.col("raw_key")), "score": payload_score(F.col("payload"))})
    parsed = parsed.withColumn("_ok", F.when(F.col(KEY).isNotNull() & F.col("score").isNotNull(), True))
    good, bad = split_rejects(parsed, "_ok")
    reason = F.when(F.col(KEY).isNull(), "bad_key").otherwise("bad_score")
    kept = latest(good.select(KEY, "score", seq), [KEY], [seq], highest=last_wins)
    return kept.select(KEY, "score"), bad.select("raw_key", seq, reason.alias("reason"))


def infer_layers(keys: DataFrame) -> DataFrame:
    """Layer count from layer lists: longest unmodified order, else largest id + 1."""
    canonical = F.max(F.when(L.is_baseline(F.col(KEY), F.size(KEY)), F.size(KEY)))
    return keys.agg(F.coalesce(canonical, F.max(F.array_max(KEY)) + 1).alias("num_layers"),
                    F.when(canonical.isNotNull(), "canonical").otherwise("max_id").alias("source"))


def infer_layers_from_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.max("j").alias("num_layers"), F.lit("max_j").alias("source"))


def scale_info(eq: DataFrame, policy: str = "auto_to_unit", score: str = "score") -> DataFrame:
    """One row: factor that brings a percent-scaled metric to 0..1, and why."""
    spark = eq.sparkSession
    if policy == "none":
        return spark.range(1).select(F.lit(1.0).alias("factor"), F.lit(False).alias("applied"), F.lit("disabled").alias("reason"))
    canonical = L.is_baseline(F.col(KEY), F.size(KEY))
    baseline = F.max_by(F.when(canonical, F.col(score)), F.when(canonical, F.size(KEY)))
    stats = eq.agg(baseline.alias("baseline"), F.count("*").alias("n")).withColumn("p95", quantile_value(eq, score, 0.95))
    percent = F.coalesce(F.col("baseline") > PERCENT_LIMIT, F.lit(False)) | F.coalesce(F.col("p95") > PERCENT_LIMIT, F.lit(False))
    p95 = F.format_string("p95=%.4f", "p95")
    seen = F.when(F.col("baseline").isNotNull(), F.concat(F.format_string(" baseline=%.4f ", "baseline"), p95)).otherwise(F.concat(F.lit(" "), p95))
    reason = (
        F.when(F.col("n") == 0, "empty_scores").when(percent, F.concat(F.lit("converted_from_percent_scale"), seen))
        .otherwise(F.concat(F.lit("already_unit_scale "), p95)))
    return stats.select(F.when(percent, 0.01).otherwise(1.0).alias("factor"), percent.alias("applied"), reason.alias("reason"))


def choose_baseline(common: DataFrame, n: int, policy: str = "canonical_or_proxy") -> DataFrame:
    """One row: baseline key, its scores and how it was found.

    The unmodified order wins; otherwise the shortest, then smallest key stands
    in, or the job fails under ``canonical_only``.
    """
    canonical = L.is_baseline(F.col(KEY), n)
    pick = F.struct(F.when(canonical, 0).otherwise(1).alias("c"), F.size(KEY).alias("s"), F.col(KEY).alias("k"))
    row = common.agg(F.min_by(F.struct(KEY, "math_score", "eq_score", canonical.alias("canonical")), pick).alias("b")).select("b.*")
    source = F.when(F.col("canonical"), "canonical")
    if policy == "canonical_only":
        source = source.otherwise(F.raise_error(F.lit("no unmodified layer order in the common keys")).cast("string"))
    else:
        source = source.otherwise("fallback_proxy")
    return row.select(KEY, "math_score", "eq_score", source.alias("source"))


# --- balanced score --------------------------------------------------------

@dataclass
class Balanced:
    """Balanced analysis of two metrics.

    ``common`` and ``rows`` are lazy frames over one pinned copy; the rest are
    single rows of statistics, read on the driver and used as literals.
    """

    common: DataFrame  # layer_key, math_score, eq_score (rescaled)
    rows: DataFrame    # non-baseline rows with deltas and balanced_score
    baseline: dict
    scale: dict
    stats: dict
    n: int


def _packed(single: DataFrame) -> Column:
    return single.select(F.struct(*single.columns)).scalar()


def one_row(df: DataFrame) -> dict:
    """The single row of an aggregate, as Python values for literals."""
    return df.first().asDict(recursive=True)


def delta_stats(rows: DataFrame) -> DataFrame:
    """Mean and population deviation of both deltas; tiny deviations count as 1."""
    aggs = []
    for m in ("math", "eq"):
        std = F.stddev_pop(f"{m}_delta")
        aggs += [
            F.coalesce(F.avg(f"{m}_delta"), F.lit(0.0)).alias(f"{m}_mean"),
            F.when(std >= MIN_STD, std).otherwise(1.0).alias(f"{m}_std"),
            F.coalesce(std < MIN_STD, F.lit(False)).alias(f"{m}_flat"),
        ]
    return rows.agg(*aggs, F.count("*").alias("n"))


def with_deltas(scores: DataFrame, baseline: dict) -> DataFrame:
    return scores.withColumn("math_delta", F.col("math_score") - baseline["math_score"]).withColumn(
        "eq_delta", F.col("eq_score") - baseline["eq_score"])


def balanced_score(stats: dict) -> Column:
    return (F.col("math_delta") - stats["math_mean"]) / stats["math_std"] + (
        F.col("eq_delta") - stats["eq_mean"]) / stats["eq_std"]


def key_literal(key: list[int]) -> Column:
    return F.array(*[F.lit(k) for k in key])


def balance(math: DataFrame, eq: DataFrame, n: int, eq_scale: str = "auto_to_unit",
            baseline_policy: str = "canonical_or_proxy") -> Balanced:
    """Join two score tables, rescale, subtract the baseline, z-score and sum.

    The outer join is pinned: scale inference needs all rows of one metric,
    everything else the common keys.  The inputs are read a single time, and the
    three one-row statistics read the pinned copy.
    """
    both = math.select(KEY, F.col("score").alias("math_score")).join(
        eq.select(KEY, F.col("score").alias("eq_score")), KEY, "full")
    return balance_table(both, n, eq_scale, baseline_policy)


def balance_table(both: DataFrame, n: int, eq_scale: str = "auto_to_unit",
                  baseline_policy: str = "canonical_or_proxy") -> Balanced:
    """:func:`balance` for one table that already holds both metrics per key."""
    both = pin(both.select(KEY, "math_score", "eq_score"))
    in_both = both.filter("math_score is not null and eq_score is not null")
    # Two one-row subqueries of a single job; scaling does not change the baseline key.
    found = both.sparkSession.range(1).select(
        _packed(scale_info(both.filter("eq_score is not null"), eq_scale, "eq_score")).alias("scale"),
        _packed(choose_baseline(in_both, n, baseline_policy)).alias("baseline")).first().asDict(recursive=True)
    scale, baseline = found["scale"], found["baseline"]
    if baseline[KEY] is None:
        raise ValueError("the two score tables have no key in common")
    baseline["eq_score"] *= scale["factor"]
    common = in_both.withColumn("eq_score", F.col("eq_score") * scale["factor"])
    rows = with_deltas(common.filter(F.col(KEY) != key_literal(baseline[KEY])), baseline)
    stats = one_row(delta_stats(rows))
    return Balanced(common, rows.withColumn("balanced_score", balanced_score(stats)), baseline, scale, stats, n)


def ranking_order(first: str = "balanced_score", key: str = KEY) -> list[Column]:
    return [F.desc(first), F.desc("eq_delta"), F.desc("math_delta"), F.asc(key)]


def top_balanced(result: Balanced, n: int) -> DataFrame:
    return labelled(top_n(result.rows, ranking_order(), n))


def ranked_balanced(result: Balanced) -> DataFrame:
    """Full ranking without a single-task sort."""
    return global_rank(result.rows, ranking_order())


def labelled(rows: DataFrame) -> DataFrame:
    """Output columns with the readable configuration label."""
    return rows.withColumn("relayer", L.layer_spec(F.col(KEY))).withColumn("method", F.lit("balanced_z_delta"))


def baseline_row(result: Balanced) -> DataFrame:
    b = result.baseline
    zero = F.lit(0.0)
    return result.common.sparkSession.range(1).select(
        key_literal(b[KEY]).alias(KEY), F.lit(b["math_score"]).alias("math_score"), F.lit(b["eq_score"]).alias("eq_score"),
        zero.alias("math_delta"), zero.alias("eq_delta"), zero.alias("balanced_score"))


def with_baseline(result: Balanced) -> DataFrame:
    """All rows plus the baseline itself with zero deltas and score."""
    return result.rows.unionByName(baseline_row(result))


def run_summary(result: Balanced) -> DataFrame:
    """One row that describes the run: counts, sources, warnings and the winner."""
    base, scale, stats = result.baseline, result.scale, result.stats
    notes = [
        ("missing canonical baseline", base["source"] == "fallback_proxy"),
        ("math deltas have near-zero variance", stats["math_flat"]),
        ("eq deltas have near-zero variance", stats["eq_flat"]),
    ]
    warnings = F.array(*[F.lit(text) for text, on in notes if on]).cast("array<string>")
    best = F.max_by(F.struct(KEY, *RANKING), F.struct(*RANKING)).alias("t")
    return result.rows.agg(best).select(
        F.lit(stats["n"] + 1).cast("long").alias("common_config_count"),
        F.lit(stats["n"]).cast("long").alias("nonbaseline_config_count"), F.lit(result.n).alias("num_layers"),
        F.lit(scale["factor"]).alias("eq_scale_factor"), F.lit(scale["applied"]).alias("eq_scale_applied"),
        F.lit(scale["reason"]).alias("eq_scale_reason"), F.lit(base["source"]).alias("baseline_source"),
        key_literal(base[KEY]).alias("baseline_key"), warnings.alias("warnings"),
        F.col(f"t.{KEY}").alias("top_key"), F.col("t.balanced_score").alias("top_score"))


# --- grids -----------------------------------------------------------------

def _baseline(score: str) -> Column:
    return F.max(F.when((F.col("i") == 0) & (F.col("j") == 0), F.col(score)))


def score_grid(scores: DataFrame, n: int, keys: list[str], score: str = "score", mask_missing: bool = False,
               diff: bool = False) -> DataFrame:
    """Dense ``(i, j)`` grid per run as a long table.

    Missing cells are 0.8 of the baseline, (0,0) or else the mean, or NULL when
    masked; in a difference grid they are always NULL.  One aggregate: a run's
    cells, at most ``(n + 1)^2`` places, are put together and filled up there.
    """
    side = n + 1
    place = (F.col("i") * side + F.col("j")).cast("int")
    inside = F.col("i").between(0, n) & F.col("j").between(0, n)
    cell = F.struct(place.alias("place"), F.col(score).cast("double").alias("v"))
    runs = scores.groupBy(*keys).agg(
        F.coalesce(_baseline(score), F.avg(score)).alias("baseline"), F.collect_list(F.when(inside, cell)).alias("_cells"))
    every = F.sequence(F.lit(0), F.lit(side * side - 1))
    missing = F.transform(F.array_except(every, F.transform("_cells", lambda c: c["place"])), lambda p: F.struct(
        p.alias("place"), F.lit(None).cast("double").alias("v")))
    out = runs.select(*keys, "baseline", F.inline(F.concat("_cells", missing)))
    if diff:
        shown = F.col("v") - F.col("baseline")
    else:
        shown = F.col("v") if mask_missing else F.coalesce("v", F.col("baseline") * 0.8)
    return out.select(*keys, F.floor(F.col("place") / side).cast("int").alias("i"), (F.col("place") % side).alias("j"), shown.alias("value"))


def diff_summary(scores: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Best cell (first by j, i on ties), its gain and the symmetric colour bound per run, in one aggregate."""
    best = F.max_by(F.struct("i", "j", F.col(score).alias("score")), F.struct(score, -F.col("j"), -F.col("i")))
    runs = scores.groupBy(*keys).agg(
        F.coalesce(_baseline(score), F.avg(score)).alias("baseline"), best.alias("best"), F.max(score).alias("_high"), F.min(score).alias("_low"))
    bound = F.greatest(F.col("_high") - F.col("baseline"), F.col("baseline") - F.col("_low"))
    return runs.select(
        *keys, "baseline", F.col("best.i").alias("best_i"), F.col("best.j").alias("best_j"),
        F.col("best.score").alias("best_score"), (F.col("best.score") - F.col("baseline")).alias("best_gain"), bound.alias("bound"))


def score_summary(scores: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Baseline (NULL when absent), range, mean, deviation and best cell per run."""
    base = F.max(F.when((F.col("i") == 0) & (F.col("j") == 0), F.col(score)))
    best = F.max_by(F.struct("i", "j"), F.struct(score, -F.col("j"), -F.col("i")))
    return scores.groupBy(*keys).agg(
        base.alias("baseline"), base.isNotNull().alias("has_baseline"), F.min(score).alias("min_score"),
        F.max(score).alias("max_score"), F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"),
        best.alias("_b")).select("*", F.col("_b.i").alias("best_i"), F.col("_b.j").alias("best_j")).drop("_b")


def wide_grid(grid: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Long grid to one row per (run, i) with a column per j."""
    return grid.groupBy(*keys, "i").pivot("j", list(range(n + 1))).agg(F.first("value"))


def repeat_grid(manifest: DataFrame, scores: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Repeat-sweep cells (extra, layer) with the run's baseline or grid mean.

    One aggregate per run holds its cells, as many as its manifest has, beside
    the baseline.
    """
    hit = manifest.join(scores, [*keys, "layer_indices_key"], "left")
    is_cell = (F.col("extra_repeats") > 0) & F.col("layer").isNotNull()
    cell = F.struct(F.col("extra_repeats").alias("extra"), "layer", F.col(score).alias("value"))
    runs = hit.groupBy(*keys).agg(
        F.max(F.when((F.col("extra_repeats") == 0) | F.col("layer").isNull(), F.col(score))).alias("_base"),
        F.avg(F.when(is_cell, F.col(score))).alias("_mean"), F.collect_list(F.when(is_cell, cell)).alias("_cells"))
    return runs.select(*keys, F.coalesce("_base", "_mean").alias("baseline"), F.inline("_cells")).select(*keys, "extra", "layer", "value", "baseline")


def best_cell(grid: DataFrame, keys: list[str], row: str = "extra", col: str = "layer") -> DataFrame:
    """Largest cell per run, first in row-major order on ties."""
    pick = F.struct("value", -F.col(row), -F.col(col))
    return grid.filter("value is not null").groupBy(*keys).agg(
        F.max_by(F.struct(row, col, "value"), pick).alias("_b")).select(*keys, "_b.*")


def clip_bounds(diffs: DataFrame, keys: list[str], value: str = "value", k_pos: float = 3.0, k_neg: float = 2.0,
                tail_q: float = 0.95, a_min: float = 1.0, a_max: float = 6.0) -> DataFrame:
    """Asymmetric colour bounds per run from tail quantiles and positive spread.

    A run is one grid of at most (layers x repeats) cells, so the exact
    percentile aggregate is bounded per group.  A run without any cell gets (-1, 1).
    """
    eps = 1e-9
    d = F.col(value)
    pos, nonneg, neg = F.when(d > 0, d), F.when(d >= 0, d), F.when(d < 0, -d)
    q = min(1.0, max(0.0, tail_q))
    s = diffs.groupBy(*keys).agg(
        F.count(d).alias("cells"), F.max(d).alias("best"), F.count(pos).alias("np"), F.stddev_pop(pos).alias("sp"),
        F.count(nonneg).alias("nn"), F.stddev_pop(nonneg).alias("sn"), F.stddev_pop(d).alias("sa"),
        F.percentile(pos, q).alias("qp"), F.percentile(neg, q).alias("qn"))
    sigma = (
        F.when((F.col("np") >= 2) & (F.col("sp") > 0), F.col("sp"))
        .when((F.col("nn") >= 2) & (F.col("sn") > 0), F.col("sn"))
        .when(F.col("sa") > 0, F.col("sa")).otherwise(eps))
    s = s.withColumn("sigma", sigma).withColumn("q_pos", F.coalesce("qp", F.greatest("best", F.lit(0.0))))
    s = s.withColumn("q_neg", F.coalesce("qn", "q_pos"))
    raw = F.when(F.col("q_pos") > 0, F.col("q_neg") / F.greatest("q_pos", F.lit(eps))).otherwise(1.0)
    s = s.withColumn("ratio", F.least(F.greatest(raw, F.lit(a_min)), F.lit(a_max)))
    s = s.withColumn("vmax", F.greatest(F.col("sigma") * k_pos, F.col("q_pos"), F.col("best") + eps, F.lit(eps)))
    span = F.greatest(F.col("sigma") * k_neg * F.col("ratio"), F.col("q_neg"), F.lit(eps))
    low = -F.least(span, F.greatest(F.col("vmax") * a_max, F.lit(eps)))
    some = F.col("cells") > 0
    return s.select(*keys, F.when(some, low).otherwise(-1.0).alias("vmin"), F.when(some, F.col("vmax")).otherwise(1.0).alias("vmax"))


def centered_range(vmin: Column, vmax: Column, center: float = 0.0) -> Column:
    """Range with ``center`` strictly inside, as ``struct<vmin, vmax>``."""
    low = F.when(vmin >= center, F.lit(center - 1e-6)).otherwise(vmin)
    high = F.when(vmax <= center, F.lit(center + 1e-6)).otherwise(vmax)
    return F.struct(low.alias("vmin"), high.alias("vmax"))
