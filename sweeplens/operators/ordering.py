"""Total orders and exact order statistics that never sit in one task.

A window without partition keys, or one over a hot key, sorts all of it in a
single task.  Here rows are range-partitioned by the whole order instead, the
sorted copy is pinned, and only one number per partition (or per group cut by a
partition border) travels through a broadcast.  Those tables have at most as
many rows as there are range partitions, whatever the data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweeplens.session import pin

_SEQ, _PID = "_seq", "_pid"
_INDEX_BITS = 33  # monotonically_increasing_id keeps the row index in 33 bits


def _cols(items) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in ([items] if isinstance(items, (str, Column)) else items)]


def sorted_copy(df: DataFrame, order, partitions: int | None = None) -> DataFrame:
    """Pinned copy in global order, with partition number and row index.

    Pinning matters: later passes must see the very same partition borders.
    ``order`` has to be total, so repeated runs agree.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = _cols(order)
    placed = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn(_SEQ, F.monotonically_increasing_id())
    )
    return pin(placed).withColumn(_PID, F.shiftright(_SEQ, _INDEX_BITS))


def running_offsets(sizes: DataFrame, name: str = "_off") -> DataFrame:
    """Rows before each partition, from (partition, ``_n``): one row a partition, put together in one array."""
    listed = sizes.agg(F.sort_array(F.collect_list(F.struct(F.col(_PID).alias("p"), F.col("_n").alias("n")))).alias("_l"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<struct<p:bigint,before:bigint>>").alias("out"))
    folded = F.aggregate("_l", start, lambda at, x: F.struct(
        (at["sum"] + x["n"]).alias("sum"), F.concat(at["out"], F.array(F.struct(x["p"].cast("long").alias("p"), at["sum"].alias("before")))).alias("out")))
    return listed.select(F.inline(folded["out"])).select(F.col("p").alias(_PID), F.col("before").alias(name))


def global_rank(df: DataFrame, order, name: str = "rank", start: int = 1) -> DataFrame:
    """Row number over the whole table: one range shuffle, no single-task sort."""
    placed = sorted_copy(df, order)
    offsets = running_offsets(placed.groupBy(_PID).agg(F.count("*").alias("_n")))
    index = F.col(_SEQ).bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    return (
        placed.join(F.broadcast(offsets), _PID)
        .withColumn(name, (F.col("_off") + index + start).cast("long"))
        .drop(_PID, _SEQ, "_off")
    )


def grouped_copy(df: DataFrame, groups: list[str], order) -> DataFrame:
    """Sorted copy by group then order; a hot group spreads over many partitions."""
    return sorted_copy(df, [F.col(g) for g in groups] + _cols(order))


def local_window(groups: list[str]):
    """Rows of one group inside one range partition, in order."""
    return Window.partitionBy(_PID, *groups).orderBy(_SEQ)


def carry_over(placed: DataFrame, groups: list[str], **aggs: tuple[Column, str]) -> DataFrame:
    """What a group brings along from earlier partitions.

    ``aggs`` maps a name to (per-partition aggregate, ``sum`` or ``max``).  Only
    a group that continues from the previous partition gets a row, and each
    partition has at most one such group: the result is bounded by the number of
    partitions and safe to broadcast.
    """
    parts = placed.groupBy(_PID, *groups).agg(*[agg.alias(k) for k, (agg, _) in aggs.items()])
    earlier = Window.partitionBy(*groups).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    fold = {"sum": F.sum, "max": F.max}
    carried = parts.select(
        _PID, *groups, F.count("*").over(earlier).alias("_parts"),
        *[fold[how](k).over(earlier).alias(k) for k, (_, how) in aggs.items()],
    )
    return carried.filter("_parts > 0").drop("_parts")


def with_carry(placed: DataFrame, groups: list[str], carried: DataFrame) -> DataFrame:
    renamed = carried.select(
        F.col(_PID).alias("_cp"), *[F.col(g).alias(f"_c_{g}") for g in groups],
        *[c for c in carried.columns if c != _PID and c not in groups],
    )
    on = F.col(_PID) == F.col("_cp")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_c_{g}"))
    return placed.join(F.broadcast(renamed), on, "left").drop("_cp", *[f"_c_{g}" for g in groups])


def grouped_rank(df: DataFrame, groups: list[str], order, name: str = "rank") -> DataFrame:
    """Row number inside each group, safe for a group that holds most rows."""
    placed = grouped_copy(df, groups, order)
    carried = carry_over(placed, groups, _before=(F.count("*"), "sum"))
    local = F.row_number().over(local_window(groups))
    return (
        with_carry(placed, groups, carried)
        .withColumn(name, (local + F.coalesce("_before", F.lit(0))).cast("long"))
        .drop(_PID, _SEQ, "_before")
    )


def top_n(df: DataFrame, order, n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows with their rank; the sort keeps only ``n`` rows per task."""
    order = _cols(order)
    return df.orderBy(*order).limit(n).withColumn(name, F.row_number().over(Window.orderBy(*order)))


def latest(df: DataFrame, keys: list[str], order, highest: bool = True) -> DataFrame:
    """One row per key by order column(s), combined map-side before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if highest else F.min_by
    by = F.struct(*_cols(order))
    return df.groupBy(*keys).agg(pick(F.struct(*rest), by).alias("_row")).select(*keys, "_row.*")


def exact_quantile(df: DataFrame, value: str, q: float, groups: list[str] | None = None,
                   name: str = "quantile") -> DataFrame:
    """Linear-interpolated quantile per group from exact ranks.

    Ranks come from the range sort, so no task holds a whole group.  The join
    back is on (group, rank), at most two rows per group.
    """
    groups = groups or []
    clean = df.select(*groups, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    ranked = grouped_rank(clean, groups, ["_v"], "_rk") if groups else global_rank(clean, ["_v"], "_rk")
    sizes = ranked.groupBy(*groups).agg(F.max("_rk").alias("_n"))
    spot = (F.col("_n") - 1) * F.lit(float(q))
    wanted = sizes.select(
        *groups, (spot - F.floor(spot)).alias("_w"),
        F.explode(F.array(F.struct((F.floor(spot) + 1).alias("_rk"), F.lit(0).alias("_hi")),
                          F.struct((F.ceil(spot) + 1).alias("_rk"), F.lit(1).alias("_hi")))).alias("_t"),
    ).select(*groups, "_w", "_t.*")
    hit = wanted.join(ranked, [*groups, "_rk"])
    low, high = F.max(F.when(F.col("_hi") == 0, F.col("_v"))), F.max(F.when(F.col("_hi") == 1, F.col("_v")))
    return hit.groupBy(*groups).agg((low + (high - low) * F.max("_w")).alias(name))


def quantile_value(df: DataFrame, value: str, q: float) -> Column:
    """Exact quantile as a scalar, by ranks: the built-in aggregate would gather all distinct values in one task."""
    return exact_quantile(df, value, q).select("quantile").scalar()
