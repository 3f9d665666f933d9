"""Resumable beam search over block sequences with measured scores.

Entries have ``blocks, block_spec, layer_key, depth, math_score, eq_score,
math_delta, eq_delta, method_score, source, extra_layers, relative_overhead,
final_score``.  Every depth is written to its own Parquet folder, so a lost
executor re-reads it; measured scores outlive the search, so a restarted driver
plans again but measures nothing twice.
"""

from __future__ import annotations

import functools
import hashlib
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sweeplens.functions import layers as L
from sweeplens.operators.analysis import KEY, balanced_score, delta_stats, key_literal, one_row, with_deltas
from sweeplens.operators.grid import grid
from sweeplens.operators.ordering import latest, top_n



def method_order() -> list[Column]:
    return [F.desc("method_score"), F.desc("eq_delta"), F.desc("math_delta"), F.asc(KEY)]


@dataclass
class FrozenStats:
    """Statistics of the seed table; later depths are scored with the same ones."""

    baseline: dict
    deltas: dict

    def score(self, df: DataFrame) -> DataFrame:
        """Deltas and method score; unlike the balanced table the baseline is not 0."""
        return with_deltas(df, self.baseline).withColumn("method_score", balanced_score(self.deltas))


def with_efficiency(df: DataFrame, n: int, penalty: float) -> DataFrame:
    extra, rel = L.extra_layers(F.col(KEY), n), L.relative_overhead(F.col(KEY), n)
    return df.withColumn("extra_layers", extra).withColumn("relative_overhead", rel).withColumn(
        "final_score", F.col("method_score") - F.col("relative_overhead") * float(penalty))


def _entries(df: DataFrame, stats: FrozenStats, n: int, penalty: float, source: str) -> DataFrame:
    return with_efficiency(stats.score(df).withColumn("source", F.lit(source)), n, penalty).withColumn(
        "block_spec", L.block_spec(F.col("blocks")))


def _stats(rows: DataFrame, baseline: dict) -> FrozenStats:
    others = with_deltas(rows.filter(F.col(KEY) != key_literal(baseline[KEY])), baseline)
    return FrozenStats(baseline, one_row(delta_stats(others)))


def seed_entries(pairs: DataFrame, n: int, penalty: float = 0.0) -> tuple[DataFrame, FrozenStats]:
    """Baseline and single blocks that have both scores; a missing (0,0) is an error."""
    block = F.struct(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"))
    base = (F.col("i") == 0) & (F.col("j") == 0)
    both = F.col("math_score").isNotNull() & F.col("eq_score").isNotNull()
    rows = pairs.filter(both).select(
        F.when(base, F.array().cast(L.BLOCK_ARRAY)).otherwise(F.array(block)).alias("blocks"),
        L.expand_block(n, F.col("i"), F.col("j")).alias(KEY), F.when(base, 0).otherwise(1).alias("depth"),
        "math_score", "eq_score")
    found = rows.filter("depth = 0").select(KEY, "math_score", "eq_score").first()
    if found is None:
        raise ValueError("seed scores have no baseline (0,0)")
    stats = _stats(rows, found.asDict())
    return _entries(rows, stats, n, penalty, "seed"), stats


def seed_from_specs(specs: DataFrame, scores: DataFrame, n: int, penalty: float = 0.0,
                    require_baseline: bool = True) -> tuple[DataFrame, FrozenStats, DataFrame]:
    """Entries of re-scored specs, their statistics, and the specs without scores.

    ``specs`` has ``blocks`` and ``seq`` (the later spec of one key wins);
    ``scores`` has the layer key with both metrics.
    """
    keyed = specs.withColumn(KEY, L.expand_blocks(n, F.col("blocks"))).withColumn("depth", F.size("blocks"))
    joined = keyed.join(scores.select(KEY, "math_score", "eq_score"), KEY, "left")
    has_both = F.col("math_score").isNotNull() & F.col("eq_score").isNotNull()
    rows = latest(joined.filter(has_both), [KEY], ["seq"]).drop("seq")
    canonical = F.when(L.is_baseline(F.col(KEY), n), 0).otherwise(1)
    pick = F.struct(canonical.alias("c"), F.size(KEY).alias("s"), F.col(KEY).alias("k"))
    best = rows.agg(F.min_by(F.struct(KEY, "math_score", "eq_score", canonical.alias("proxy")), pick).alias("b")).first()["b"]
    if best is None:
        raise ValueError("no spec has scores in both metrics")
    if require_baseline and best["proxy"]:
        raise ValueError("re-scored specs have no baseline")
    stats = _stats(rows, best.asDict())
    return _entries(rows, stats, n, penalty, "seed_rescore"), stats, joined.filter(~has_both).select("blocks", KEY, "seq")


def coverage_gap(expected: DataFrame, *available: DataFrame) -> DataFrame:
    """Expected keys that lack a score in at least one table."""
    keys = expected.select(KEY).dropDuplicates()
    have = keys
    for table in available:
        have = have.join(table.select(KEY), KEY, "left_semi")
    return keys.join(have, KEY, "left_anti")


def pool_of(entries: DataFrame, size: int) -> DataFrame:
    """The best single blocks with their rank, block and seed score."""
    best = top_n(entries.filter("depth = 1"), method_order(), size, "pool_rank")
    return best.select("pool_rank", F.get("blocks", F.lit(0)).alias("block"), F.col("method_score").alias("block_score"))


def frontier_of(entries: DataFrame, depth: int, width: int) -> DataFrame:
    return top_n(entries.filter(F.col("depth") == depth), method_order(), width, "parent_rank")


def expand(frontier: DataFrame, pool: DataFrame, n: int, max_extra: int | None = None) -> DataFrame:
    """Append every pool block to every frontier entry.

    Both sides are top-k lists, so the pairs are bounded by the beam settings.
    """
    parents = frontier.select(F.col("blocks").alias("_parent"), "parent_rank", F.col("method_score").alias("parent_score"))
    out = grid(parents, pool.select("pool_rank", "block", "block_score")).select(
        F.concat("_parent", F.array("block")).alias("blocks"), "parent_rank", "pool_rank",
        (F.col("parent_score") + F.col("block_score")).alias("heuristic"))
    out = out.withColumn(KEY, L.expand_blocks(n, F.col("blocks")))
    return out if max_extra is None else out.filter(L.extra_layers(F.col(KEY), n) <= max_extra)


def select_candidates(proposals: DataFrame, evaluated: DataFrame, limit: int) -> DataFrame:
    """Best proposal per layer key, not evaluated before, ``limit`` by heuristic."""
    best = latest(proposals, [KEY], [F.col("heuristic"), -F.col("parent_rank"), -F.col("pool_rank")])
    fresh = best.join(evaluated.select(KEY), KEY, "left_anti")
    return top_n(fresh, [F.desc("heuristic"), "parent_rank", "pool_rank"], limit, "candidate_rank")


def unscored(candidates: DataFrame, metric: DataFrame) -> DataFrame:
    """Candidates one metric still has to measure, as queue entries."""
    todo = candidates.join(metric.select(KEY), KEY, "left_anti")
    return todo.select((F.col("candidate_rank") - 1).alias("idx"), L.block_spec(F.col("blocks")).alias("spec"), F.col(KEY).alias("layers"))


def attach_scores(candidates: DataFrame, math: DataFrame, eq: DataFrame, stats: FrozenStats, n: int,
                  penalty: float, depth: int) -> tuple[DataFrame, DataFrame]:
    """Entries for candidates with both scores, and those still missing one."""
    joined = (
        candidates.select("blocks", KEY, "heuristic", F.lit(depth).alias("depth"))
        .join(math.select(KEY, F.col("score").alias("math_score")), KEY, "left")
        .join(eq.select(KEY, F.col("score").alias("eq_score")), KEY, "left"))
    both = F.col("math_score").isNotNull() & F.col("eq_score").isNotNull()
    done = _entries(joined.filter(both).drop("heuristic"), stats, n, penalty, "beam_eval")
    return done, joined.filter(~both).select("blocks", KEY, "depth", "heuristic", F.lit("missing_scores").alias("status"))


def rescore(saved: DataFrame, present: DataFrame, stats: FrozenStats, n: int, penalty: float) -> DataFrame:
    """Saved entries with the present ones over them, all under the current statistics."""
    cols = ["blocks", KEY, "depth", "math_score", "eq_score", "source"]
    both = saved.select(*cols, F.lit(0).alias("_p")).unionByName(present.select(*cols, F.lit(1).alias("_p")))
    rows = latest(both, [KEY], ["_p", "source", "math_score", "eq_score"]).drop("_p")
    return with_efficiency(stats.score(rows), n, penalty).withColumn("block_spec", L.block_spec(F.col("blocks")))


def registry(events: DataFrame) -> DataFrame:
    """One row per block spec from the event log: counters, last state, best score.

    Planned candidates only have a heuristic; it never competes with measured
    scores.
    """
    planned = F.col("status").isin("proposed", "planned")
    return events.groupBy("block_spec").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.max_by("depth", "seq").alias("depth"), F.max_by("status", "seq").alias("last_status"),
        F.max_by("source", "seq").alias("source"),
        F.count_if(planned & F.col("counted")).alias("proposed_count"),
        F.count_if((F.col("status") == "evaluated") & F.col("counted")).alias("evaluated_count"),
        F.max("method_score").alias("best_method_score"), F.max("heuristic").alias("best_heuristic"))


def status_counts(reg: DataFrame) -> DataFrame:
    return reg.groupBy("last_status").agg(F.count("*").alias("n"))


def final_ranking(entries: DataFrame, penalty: float, n: int = 50) -> DataFrame:
    """Best entries overall; the overhead penalty decides only when it is positive."""
    primary = "final_score" if penalty > 0 else "method_score"
    return top_n(entries, [F.desc(primary), *method_order()], n)


@dataclass
class StopRule:
    """Plateau and time limits, updated once per depth with the best entry so far."""

    min_improvement: float = 0.0
    streak: int = 0
    no_replace_streak: int = 0
    min_hours: float = 0.0
    max_hours: float | None = None
    started: float = field(default_factory=time.time)
    best_score: float | None = None
    best_spec: str | None = None
    low: int = 0
    kept: int = 0

    def start(self, score: float, spec: str) -> None:
        self.best_score, self.best_spec = score, spec

    def update(self, score: float, spec: str, now: float | None = None) -> str | None:
        gain = score - self.best_score
        replaced = spec != self.best_spec and gain > 1e-12
        self.low = self.low + 1 if 0 < self.min_improvement and gain < self.min_improvement else 0
        self.kept = 0 if replaced else self.kept + 1
        if replaced:
            self.best_spec = spec
        self.best_score = max(self.best_score, score)
        hours = ((now or time.time()) - self.started) / 3600
        if self.max_hours is not None and hours >= self.max_hours:
            return f"max_hours_reached_{self.max_hours:.2f}h"
        enabled = min(self.min_improvement, self.streak, self.no_replace_streak) > 0
        if enabled and hours >= self.min_hours and self.low >= self.streak and self.kept >= self.no_replace_streak:
            return f"plateau:low_improve={self.low}/{self.streak},no_replace={self.kept}/{self.no_replace_streak}"
        return None


ENTRY_COLUMNS = [
    "blocks", "block_spec", KEY, "depth", "math_score", "eq_score", "math_delta", "eq_delta", "method_score",
    "source", "extra_layers", "relative_overhead", "final_score",
]
Scorer = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


@dataclass
class BeamResult:
    """What a search found.

    ``entries`` are those of this search, ``saved`` all entries of it and of
    earlier ones in the same folder, scored under the present statistics;
    ``events`` is the log of all of them.
    """

    entries: DataFrame
    events: DataFrame
    stop_reason: str
    depths: list[int]
    saved: DataFrame


_SCORES = T.StructType([
    T.StructField(KEY, T.ArrayType(T.IntegerType())), T.StructField("math_score", T.DoubleType()),
    T.StructField("eq_score", T.DoubleType()), T.StructField("turn", T.LongType()),
])


class SearchState:
    """The folder of a search, one subfolder for each set of parameters that shape it.

    A call works in a new folder ``run=<turn>`` below it and never writes into
    another's.  Measured scores belong to the number of layers alone and are
    shared by all parameters.  Only folders that were finished are read.
    """

    def __init__(self, spark: SparkSession, root: str, n: int, **parameters):
        text = ",".join(f"{k}={v}" for k, v in sorted({"n": n, **parameters}.items()))
        self.spark, self.folder, self.scores = spark, f"{root}/{hashlib.sha256(text.encode()).hexdigest()[:16]}", f"{root}/scores-{n}"
        self.turn = 1 + max(self._turns(self.folder) + self._turns(self.scores), default=0)
        self.number = 0

    def _names(self, folder: str, only: str | None = None) -> list[str]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in system.listStatus(path)] if system.exists(path) else []
        return [name for name in names if only in (None, name)]

    def _turns(self, folder: str) -> list[int]:
        return sorted(int(name[4:]) for name in self._names(folder) if name.startswith("run="))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/run={self.turn}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def known(self) -> DataFrame:
        """The latest score of each layer key and metric."""
        turns = self._turns(self.scores)
        if not turns:
            return self.spark.createDataFrame([], _SCORES).drop("turn")
        rows = self.spark.read.schema(_SCORES).option("recursiveFileLookup", True).parquet(*[f"{self.scores}/run={t}" for t in turns])
        newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("turn"))).alias(c)
        return rows.groupBy(KEY).agg(newest("math_score"), newest("eq_score"))

    def remember(self, scores: DataFrame) -> None:
        self.number += 1
        scores.select(KEY, "math_score", "eq_score", F.lit(self.turn).cast("long").alias("turn")).write.parquet(
            f"{self.scores}/run={self.turn}/part{self.number}")

    def earlier(self, name: str, columns: list[str]) -> list[DataFrame]:
        """The finished tables of earlier runs whose name begins so, the seeds left out."""
        out = []
        for turn in self._turns(self.folder):
            names = [f for f in self._names(f"{self.folder}/run={turn}") if f.startswith(name) and f != "depth=1"]
            paths = [f"{self.folder}/run={turn}/{f}" for f in names if turn < self.turn]
            out += [self.spark.read.parquet(path).select(*columns) for path in paths if self._names(path, "_SUCCESS")]
        return out


_EVENT = T.StructType([
    T.StructField("block_spec", T.StringType()), T.StructField("depth", T.IntegerType()),
    T.StructField("status", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("counted", T.BooleanType()), T.StructField("method_score", T.DoubleType()),
    T.StructField("heuristic", T.DoubleType()), T.StructField("seq", T.LongType()), T.StructField("ts", T.TimestampType()),
])


def _event(df: DataFrame, status: str, source: str, step: int, counted: bool, score: str | None, heuristic: str | None) -> DataFrame:
    values = {
        "block_spec": L.block_spec(F.col("blocks")), "depth": F.col("depth").cast("int"), "status": F.lit(status),
        "source": F.lit(source), "counted": F.lit(counted), "method_score": F.col(score) if score else F.lit(None),
        "heuristic": F.col(heuristic) if heuristic else F.lit(None), "seq": F.lit(step), "ts": F.current_timestamp(),
    }
    return df.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in _EVENT.fields])


def beam_search(pairs: DataFrame, score: Scorer, n: int, work_dir: str, max_depth: int = 4, seed_top: int = 8,
                pool_size: int = 32, width: int = 8, max_candidates: int = 256, max_extra: int | None = None,
                penalty: float = 0.0, rule: StopRule | None = None) -> BeamResult:
    """Search from single blocks to deeper sequences.

    ``score`` returns the two metric tables for a candidate frame: a lookup of
    measured results or a surrogate.  What it has measured is kept in
    ``work_dir`` and stands in where a later call finds no score.  A call plans
    every depth anew under the statistics of its own seeds, so a search resumed
    after an interruption, after scores came late or after seeds changed gives
    what a fresh one would; candidates without scores are tried again.
    """
    spark = pairs.sparkSession
    rule = rule or StopRule()
    state = SearchState(spark, work_dir, n, seed_top=seed_top, pool_size=pool_size, width=width, max_candidates=max_candidates, max_extra=max_extra)
    seeds, stats = seed_entries(pairs, n, penalty)
    entries = state.write(seeds.select(*ENTRY_COLUMNS), "depth=1")
    logged = [_event(entries, "evaluated", "seed", 1, False, "method_score", None)]
    pool = pool_of(entries, pool_size)
    best = entries.orderBy(*method_order()).first()
    rule.start(best["method_score"], best["block_spec"])
    reason, depths = "max_depth_reached", []
    frontier = frontier_of(entries, 1, min(seed_top, pool_size))
    for depth in range(2, max_depth + 1):
        if frontier.isEmpty():
            reason = "frontier_empty"
            break
        picked = select_candidates(expand(frontier, pool, n, max_extra), entries, max_candidates)
        picked = state.write(picked.withColumn("depth", F.lit(depth)), f"candidates/depth={depth}")
        if picked.isEmpty():
            reason = f"candidate_exhausted_depth_{depth}"
            break
        measured = state.write(_measured(picked, *score(picked), state.known()), f"scores/depth={depth}")
        state.remember(measured)
        done, missing = attach_scores(picked, *[measured.select(KEY, F.col(m).alias("score")) for m in ("math_score", "eq_score")],
                                      stats, n, penalty, depth)
        done = state.write(done.select(*ENTRY_COLUMNS), f"depth={depth}")
        missing = state.write(missing, f"missing/depth={depth}")
        logged += [_event(picked, "planned", "beam_candidate", 2 * depth, True, None, "heuristic"),
                   _event(done, "evaluated", "beam_eval", 2 * depth + 1, True, "method_score", None),
                   _event(missing, "missing_scores", "beam_eval", 2 * depth + 1, True, None, "heuristic")]
        entries = entries.unionByName(done)
        depths.append(depth)
        frontier = frontier_of(done, depth, width)
        best = entries.orderBy(*method_order()).first()
        stop = rule.update(best["method_score"], best["block_spec"])
        if stop:
            reason = stop
            break
    step = F.col("seq") + F.lit(state.turn * 1_000_000)  # events of a later call come later
    events = state.write(functools.reduce(DataFrame.unionByName, logged).withColumn("seq", step), "events")
    saved = functools.reduce(DataFrame.unionByName, state.earlier("depth=", ENTRY_COLUMNS), entries.limit(0))
    return BeamResult(entries, functools.reduce(DataFrame.unionByName, state.earlier("events", events.columns), events), reason, depths,
                      rescore(saved, entries, stats, n, penalty))


def _measured(picked: DataFrame, math: DataFrame, eq: DataFrame, known: DataFrame) -> DataFrame:
    """Both scores of the candidates; a score not found now may be known from before."""
    out = picked.select(KEY)
    for name, table in (("math_score", math), ("eq_score", eq)):
        out = out.join(table.select(KEY, F.col("score").cast("double").alias(name)), KEY, "left")
    before = known.select(KEY, F.col("math_score").alias("_math"), F.col("eq_score").alias("_eq"))
    return out.join(before, KEY, "left").select(KEY, F.coalesce("math_score", "_math").alias("math_score"),
                                                F.coalesce("eq_score", "_eq").alias("eq_score"))
