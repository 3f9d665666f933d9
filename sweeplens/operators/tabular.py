"""Grouped table functions that stay balanced when one group holds most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweeplens.functions import text as X
from sweeplens.operators.ordering import (
    carry_over, exact_quantile, grouped_copy, grouped_rank, local_window, with_carry,
)


def row_chunks(df: DataFrame, groups: list[str], order: list, size: int, values: list[str]) -> DataFrame:
    """Consecutive chunks of ``size`` rows per group; a shorter tail is kept."""
    if size <= 0:
        raise ValueError("size must be positive")
    ranked = grouped_rank(df, groups, order, "_rk")
    chunk = F.floor((F.col("_rk") - 1) / size).cast("long").alias("chunk")
    packed = F.array_sort(F.collect_list(F.struct("_rk", *values)))
    return ranked.groupBy(*groups, chunk).agg(packed.alias("_rows")).withColumn(
        "items", F.transform("_rows", lambda r: F.struct(*[r[v].alias(v) for v in values]))).drop("_rows")


def group_median(df: DataFrame, groups: list[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per group, the mean of the middle pair for even sizes."""
    return exact_quantile(df, value, 0.5, groups, name)


def merge_intervals(df: DataFrame, groups: list[str], start: str, end: str) -> DataFrame:
    """Merge overlapping and touching intervals per group.

    Intervals are sorted across all tasks; the running maximum of ``end`` and
    the island number cross partition borders through two small carry tables.
    """
    placed = grouped_copy(df.select(*groups, start, end), groups, [start, end])
    carried = carry_over(placed, groups, _top=(F.max(end), "max"))
    w = local_window(groups)
    seen = F.greatest(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_top"))
    opened = with_carry(placed, groups, carried).withColumn("_new", (seen.isNull() | (F.col(start) > seen)).cast("int"))
    opened = opened.drop("_top")
    islands = carry_over(opened, groups, _before=(F.sum("_new"), "sum"))
    running = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    numbered = with_carry(opened, groups, islands).withColumn("_island", running + F.coalesce("_before", F.lit(0)))
    return numbered.groupBy(*groups, "_island").agg(
        F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("merged")).drop("_island")


def moving_average(df: DataFrame, groups: list[str], order: list, value: str, width: int,
                   block: int = 50_000) -> DataFrame:
    """Mean over the last ``width`` rows, full windows only.

    A group is cut into blocks of positions; each block also receives the
    ``width - 1`` rows before it, so no window spans two tasks.
    """
    if width <= 0:
        raise ValueError("width must be positive")
    block = max(block, width)
    ranked = grouped_rank(df, groups, order, "position")
    own = F.floor((F.col("position") - 1) / block)
    # A row near the end of its block is also needed by the next block.
    near_end = (F.col("position") - 1) % block >= block - (width - 1)
    homes = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    spread = ranked.withColumn("_own", own).withColumn("_block", F.explode(homes))
    w = Window.partitionBy(*groups, "_block").orderBy("position").rowsBetween(-(width - 1), 0)
    full = F.count("*").over(w) == width
    return (
        spread.withColumn("moving_avg", F.avg(value).over(w)).withColumn("_full", full)
        .filter((F.col("_block") == F.col("_own")) & F.col("_full")).drop("_own", "_block", "_full"))


def slug_groups(df: DataFrame, text: str, name: str = "slug") -> DataFrame:
    return df.groupBy(X.slug(F.col(text)).alias(name)).agg(F.count("*").alias("n"))


def latest_version(df: DataFrame, groups: list[str], version: str) -> DataFrame:
    """Largest dotted version per group by numeric segments."""
    keyed = df.withColumn("_key", X.version_key(F.col(version)))
    return keyed.filter("_key is not null").groupBy(*groups).agg(
        F.max_by(F.col(version), F.struct("_key", version)).alias("latest"), F.count("*").alias("versions"))


def version_order(version: str) -> list[Column]:
    return [X.version_key(F.col(version)), F.col(version)]


def standardise_bool(df: DataFrame, column: str, name: str = "flag") -> tuple[DataFrame, DataFrame]:
    """Rows with a usable boolean, and the rejected rest."""
    parsed = df.withColumn(name, X.parse_bool(F.col(column)))
    return parsed.filter(F.col(name).isNotNull()), parsed.filter(F.col(name).isNull()).drop(name)
