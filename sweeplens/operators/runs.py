"""Agent-run records, summaries, deltas and pending work."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweeplens.functions.text import stable_hash
from sweeplens.operators.grid import grid, only_row, unfinished
from sweeplens.operators.ordering import global_rank, latest
from sweeplens.session import pin

# Evaluation buckets from strongest to weakest, names of known task sets.
BUCKET_PRIORITY = ("resolved", "unresolved", "empty_patch", "incomplete", "error")
FAILED_BUCKETS = ("error", "incomplete")
DATASET_ALIASES = {
    "full": "princeton-nlp/SWE-Bench",
    "verified": "princeton-nlp/SWE-Bench_Verified",
    "lite": "princeton-nlp/SWE-Bench_Lite",
    "multimodal": "princeton-nlp/SWE-Bench_Multimodal",
    "multilingual": "swe-bench/SWE-Bench_Multilingual",
    "smith": "SWE-bench/SWE-smith",
    "_test": "klieret/swe-bench-dummy-test-dataset",
    "rebench": "nebius/SWE-rebench",
}
METRICS = ("steps", "execution_errors", "runtime_seconds", "extra_layers", "overhead_fraction")


def alias_names(df: DataFrame, column: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """Short names to full ones; unknown names pass through."""
    pairs = [F.lit(x) for kv in (aliases or DATASET_ALIASES).items() for x in kv]
    return df.withColumn(column, F.coalesce(F.create_map(*pairs)[F.col(column)], F.col(column)))


def manifest_slice(ids: DataFrame, column: str = "instance_id", pattern: str = "", seed: int | None = None,
                   spec: str = "", order: str | None = None) -> DataFrame:
    """Anchored regex filter, seeded shuffle, then a Python slice ``start:stop:step``.

    Bounds may be negative; they resolve against the row count.  Without a seed
    the given ``order`` column (or the id) decides positions.
    """
    rows = ids.filter(F.col(column).rlike(f"^(?:{pattern})")) if pattern else ids
    keys = [stable_hash(seed, F.col(column))] if seed is not None else [F.col(order)] if order else []
    ranked = global_rank(rows, [*keys, F.col(column)], "position", start=0)
    if not spec:
        return ranked
    parts = [int(p) if p else None for p in (spec.split(":") + ["", ""])[:3]]
    start, stop, step = slice(*parts).indices(ranked.count())
    pos = F.col("position")
    inside = (pos >= start) & (pos < stop) if step > 0 else (pos <= start) & (pos > stop)
    hit = ranked.filter(inside & ((pos - start) % step == 0))
    return hit.withColumn("position", ((pos - start) / step).cast("long"))


def bucket_rows(reports: DataFrame, keys: list[str]) -> DataFrame:
    """Reports with one id list per bucket to ``(keys, instance_id, bucket)`` rows."""
    lists = F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(f"{b}_ids").alias("ids")) for b in BUCKET_PRIORITY])
    return reports.select(*keys, F.inline(lists)).select(*keys, F.explode("ids").alias("instance_id"), "bucket")


def resolve_status(buckets: DataFrame, keys: list[str]) -> DataFrame:
    """Strongest bucket per task, whether it is resolved, and whether it failed.

    The failure flag looks at every bucket, not only at the winning one.
    """
    known = F.array(*[F.lit(b) for b in BUCKET_PRIORITY])
    rank = F.nullif(F.array_position(known, F.col("bucket")), F.lit(0))
    best = F.min(rank)
    return buckets.groupBy(*keys).agg(
        F.get(known, (best - 1).cast("int")).alias("evaluation_status"),
        F.bool_or(F.col("bucket") == "resolved").alias("success"),
        F.bool_or(F.col("bucket").isin(*FAILED_BUCKETS)).alias("failed"))


def run_records(tasks: DataFrame, conditions: DataFrame, metadata: DataFrame, buckets: DataFrame,
                seq: str = "seq") -> DataFrame:
    """One record per condition and task, present even without metadata.

    ``tasks`` has ``task_id``; ``conditions`` has ``condition`` and optionally
    ``extra_layers`` and ``overhead_fraction``; ``metadata`` is append-only, the
    highest ``seq`` per pair wins.
    """
    keys = ["condition", "task_id"]
    defaults = {"extra_layers": F.lit(0), "overhead_fraction": F.lit(0.0)}
    given = conditions.select("condition", *[
        (F.coalesce(F.col(c), d) if c in conditions.columns else d).alias(c) for c, d in defaults.items()])
    meta = latest(metadata, keys, [seq])
    status = resolve_status(buckets.filter("bucket is not null"), keys)
    out = grid(tasks.select("task_id"), given).join(meta, keys, "left").join(status, keys, "left")

    def field(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in meta.columns else default

    bad_exit = field("returncode", F.lit(0)).cast("string") != "0"
    failed = F.coalesce(F.col("failed"), F.lit(False))
    return out.select(
        "task_id", "condition", F.coalesce("success", F.lit(False)).alias("success"),
        field("steps", F.lit(0)).cast("int").alias("steps"),
        (failed | bad_exit).cast("int").alias("execution_errors"),
        field("runtime_seconds", F.lit(0.0)).cast("double").alias("runtime_seconds"),
        "extra_layers", "overhead_fraction",
        F.coalesce("evaluation_status", F.lit("not_evaluated")).alias("evaluation_status"),
        field("submission_empty", F.lit(True)).alias("submission_empty"),
        field("instance_cost", F.lit(0.0)).cast("double").alias("instance_cost"),
        field("exit_status", F.lit("")).alias("exit_status"))


def summarize(records: DataFrame, by: str = "condition") -> DataFrame:
    """Counts, success rate and five averages per condition."""
    return records.groupBy(by).agg(
        F.count("*").alias("tasks"), F.count_if("success").alias("successes"),
        F.avg(F.col("success").cast("int")).alias("success_rate"),
        *[F.avg(m).alias(f"avg_{m}") for m in METRICS])


def compare_to_baseline(summary: DataFrame, baseline: str, by: str = "condition") -> DataFrame:
    """Differences to the baseline condition; a missing baseline fails the job."""
    measures = ("success_rate", "avg_steps", "avg_execution_errors", "avg_runtime_seconds")
    summary = pin(summary.select(by, *measures))  # one row per condition, used twice
    base = summary.filter(F.col(by) == baseline).select(*[F.col(m).alias(f"_{m}") for m in measures])
    packed = only_row(base)
    guarded = F.when(F.size(packed) > 0, packed).otherwise(
        F.raise_error(F.lit(f"baseline condition not found: {baseline}")).cast(f"array<{base.schema.simpleString()}>"))
    return summary.select(by, *measures, F.inline(guarded)).select(
        by, *[(F.col(m) - F.col(f"_{m}")).alias(f"delta_{m}") for m in measures])


def attach_attributes(runs: DataFrame, attributes: DataFrame, key: str = "condition", strict: bool = True) -> DataFrame:
    """Join condition attributes; a run without attributes is an error when strict."""
    out = runs.join(attributes.withColumn("_hit", F.lit(True)), key, "left")
    if strict:
        text = F.concat(F.lit("missing attributes for: "), F.col(key))
        checked = F.when(F.col("_hit"), F.col(key)).otherwise(F.raise_error(text).cast("string"))
        out = out.withColumn(key, checked)
    return out.drop("_hit")


def pending_runs(tasks: DataFrame, conditions: DataFrame, done: DataFrame) -> DataFrame:
    """(condition, task) pairs without a finished trajectory."""
    return unfinished(tasks.select("task_id"), conditions.select("condition"), done, "task_id", "condition")


def trajectory_totals(trajectories: DataFrame, doc: str = "doc", keys: tuple[str, ...] = ("task_id",)) -> DataFrame:
    """Steps, cost and exit status out of nested run documents (VARIANT)."""
    v = F.col(doc)

    def get(path: str, kind: str, default: object) -> Column:
        return F.coalesce(F.try_variant_get(v, f"$.info.{path}", kind), F.lit(default))

    submission = get("submission", "string", "")
    return trajectories.select(
        *keys, get("exit_status", "string", "").alias("exit_status"), submission.alias("submission"),
        get("model_stats.api_calls", "int", 0).alias("steps"),
        get("model_stats.instance_cost", "double", 0.0).alias("instance_cost"),
        (submission == "").alias("submission_empty"))


LEVELS = 6  # levels opened in one pass


def flatten_json(df: DataFrame, keys: list[str], doc: str = "doc") -> DataFrame:
    """Nested documents (VARIANT) to one row per leaf path, however deep; arrays are leaves.

    A pass opens several levels in one chain of generators: objects become
    their members, leaves go through unchanged.  The input is read once; only
    documents with objects left after a pass need another, on its pinned result.
    A document that is not an object has no leaves.
    """
    spark = df.sparkSession
    is_object = F.schema_of_variant("_v").startswith("OBJECT<")
    rows = df.select(*keys, F.lit(None).cast("string").alias("_path"), F.col(doc).alias("_v")).where(is_object)
    done = []
    while True:
        for _ in range(LEVELS):
            staged = rows.withColumn("_open", is_object)
            inner = F.when(F.col("_open"), F.col("_v"))
            items = staged.lateralJoin(spark.tvf.variant_explode_outer(inner.outer()))
            items = items.where("not _open or key is not null")  # an empty object has no leaves
            rows = items.select(*keys, F.when(F.col("_open"), F.concat_ws(".", "_path", "key")).otherwise(F.col("_path")).alias("_path"),
                                F.when(F.col("_open"), F.col("value")).otherwise(F.col("_v")).alias("_v"))
        rows = pin(rows.withColumn("_deeper", is_object))
        done.append(rows.where("not _deeper"))
        rows = rows.where("_deeper").drop("_deeper")
        if rows.isEmpty():
            break
    leaves = functools.reduce(DataFrame.unionByName, done)
    return leaves.select(*keys, F.col("_path").alias("path"), F.to_json("_v").alias("value")).withColumn("spec", F.concat_ws("=", "path", "value"))
