"""What the operators of this package share: written tables, sorted groups, connected components."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sweeplens.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])


BATCH_BYTES = 4 << 20  # of an Arrow batch, where the session leaves it unbounded


def bounded_batches(spark: SparkSession) -> None:
    """Bound what a task hands to Python at once: a batch of long texts counts by bytes, not by rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, "67108864").rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` into the shared scratch folder and read it back.

    Cuts the lineage with files every executor can reach, keeps column pruning,
    and makes later steps see the same rows whatever is recomputed.
    """
    bounded_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores at its end until no column has it (names are compared without case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def key_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys, of ``least`` rows or more, from batches sorted by the keys."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.concat_tables(held).combine_chunks()
        last = int(bounds(table, keys)[-2])
        if last:
            yield table.slice(0, last)
        held, rows = [table.slice(last)], table.num_rows - last
    if held:
        yield pa.concat_tables(held).combine_chunks()


def bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where runs of equal keys begin; the last entry is the number of rows."""
    n = table.num_rows
    change = np.zeros(n, dtype=bool)
    if n:
        change[0] = True
    for key in keys:
        column = table[key].to_numpy()
        change[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(change), n)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the edges (a, b) as (node, smallest node of its component)."""
    nodes, codes = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = codes[: a.size], codes[a.size:]
    label = np.arange(nodes.size)
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        label = label[label]
        label = label[label]
        if np.array_equal(before, label):
            break
    other = np.flatnonzero(label != np.arange(nodes.size))
    return nodes[other], nodes[label[other]]


FOREST = 1 << 18  # edges (16 bytes each) that are held together when edges are contracted inside a task


def local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task as a forest, some at a time: what is left of the earlier ones meets the next.

    Python that makes edges gives them to this itself: another ``mapInArrow`` on
    top would take a second worker a task, and idle workers keep their memory.
    """
    a = b = np.empty(0, dtype=np.int64)
    held = 0
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def contract() -> tuple[np.ndarray, np.ndarray]:
        return forest(*(np.concatenate([x[i] for x in [(a, b), *parts]]) for i in (0, 1)))

    for batch in batches:
        parts.append((batch["a"].to_numpy(), batch["b"].to_numpy()))
        held += batch.num_rows
        if held >= FOREST:
            a, b = contract()
            parts, held = [], 0
            if a.size >= FOREST:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a = b = np.empty(0, dtype=np.int64)
    a, b = contract()
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def contracted(edges: DataFrame) -> DataFrame:
    """Replace the edges of each task by spanning forests (node a, root b) of as many edges as fit in memory."""
    return edges.select("a", "b").mapInArrow(local_forest, "a bigint, b bigint")


def components(edges: DataFrame, forests: bool = False) -> DataFrame:
    """Smallest reachable node for every node of ``edges`` (a, b): columns node, root.

    Edges are contracted inside tasks (with ``forests`` they come so from the
    tasks that make them), as many tasks as they need at ``FOREST`` edges each.
    While that is more than one, the two star operations of Kiveris et al. (2014)
    alternate: neighbours above a node hang onto its smallest neighbour, then
    those below.  Each is one minimum per node and a join, so the
    number of rounds grows with the logarithm of the size, for chains and hubs
    alike.  Each round is a written table.  Nodes without an edge are not in the
    result.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    now = written(edges.select("a", "b") if forests else contracted(edges), "edges")
    seen = _sum(now)
    while seen[0] > FOREST:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = (both.where("b > a").join(low, both["a"] == low["u"])
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(low.withColumnRenamed("a", "u"), F.col("a") == F.col("u"))
        small = (down.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
                 .union(low.select("a", F.col("m").alias("b"))).distinct())
        now = written(contracted(small), "edges")
        before, seen = seen, _sum(now)
        if seen == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return written(contracted(now.coalesce(1)), "edges").select(F.col("a").alias("node"), F.col("b").alias("root"))


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def kth_smallest(df: DataFrame, key: Column, k: int) -> int | None:
    """The k-th smallest value of a bigint column without bringing its rows together.

    Counts values by their upper bits, 12 at a time; each count is combined
    before the shuffle.  None if there are fewer than ``k`` rows.
    """
    low, high, width, left = -(2**63), 2**63 - 1, 64, k
    rows = df.select(key.alias("v")).where("v is not null")
    while width:
        width = max(0, width - 12)
        piece = rows.where(F.col("v").between(low, high))
        found = piece.groupBy(F.shiftright(F.col("v"), width).alias("bin")).count().orderBy("bin").collect()
        for row in found:
            if left <= row["count"]:
                low, high = row["bin"] << width, (row["bin"] << width) + (1 << width) - 1
                break
            left -= row["count"]
        else:
            return None
    return low


class IdFilter:
    """A Bloom filter of ids with a fixed number of bits, for leaving rows out before a shuffle.

    It lets every id of the set pass, and others by chance: more of them as the
    set outgrows the bits, so a join must follow.  The bits are a table of at most
    ``bits / 64`` rows that is broadcast, whatever the number of ids.
    """

    def __init__(self, ids: DataFrame, bits: int = 1 << 23):
        """``ids`` has a column id (bigint)."""
        self.bits = bits
        word, mask = self._at(F.col("id"))
        self.words = written(ids.where("id is not null").select(word.alias("_word"), mask.alias("mask"))
                             .groupBy("_word").agg(F.bit_or("mask").alias("_mask")), "idbits")

    def _at(self, column: Column) -> tuple[Column, Column]:
        bit = F.pmod(F.xxhash64(column), F.lit(self.bits))
        return F.floor(bit / 64), F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 64).cast("int"))

    def _split(self, df: DataFrame, column: str, how: str) -> DataFrame:
        word, mask = self._at(F.col(column))
        hit = F.col(column).isNotNull() & (word == F.col("_word")) & (F.col("_mask").bitwiseAND(mask) != 0)
        return df.join(F.broadcast(self.words), hit, how)

    def passing(self, df: DataFrame, column: str) -> DataFrame:
        """Rows whose id may be in the set; without those whose id is null."""
        return self._split(df, column, "left_semi")

    def failing(self, df: DataFrame, column: str) -> DataFrame:
        """Rows whose id is not in the set, or null."""
        return self._split(df, column, "left_anti")
