"""Pairing rows with a numbered list in blocks, without a cross join.

The list is numbered and cut into blocks of 64; a row meets each block once, by
an equi-join on the block number, and its entries come out of the block's array.
No task and no array holds the whole list, and the list may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweeplens.operators.ordering import global_rank
from sweeplens.session import pin

BITS = 64  # entries of a block: finished ones are the bits of one long
BROADCAST_BLOCKS = 1024  # lists of up to so many blocks are sent to all tasks, longer ones are shuffled


def only_row(df: DataFrame) -> Column:
    """The rows of a table that has one at most, as an array from a scalar subquery; a second row fails the job."""
    packed = df.limit(2).agg(F.collect_list(F.struct(*df.columns))).scalar()
    return F.when(F.size(packed) <= 1, packed).otherwise(
        F.raise_error(F.lit("more than one row")).cast(f"array<{df.schema.simpleString()}>"))


class Blocks:
    """A list in blocks: ``table`` has ``_block`` and ``_list``, an array of (_bit, entry)."""

    def __init__(self, entries: DataFrame):
        columns = entries.columns
        place = F.col("_place")
        numbered = global_rank(entries, columns, "_place", start=0).select(
            F.floor(place / BITS).alias("_block"), (place % BITS).cast("int").alias("_bit"), *columns)
        self.numbered = pin(numbered)
        packed = F.sort_array(F.collect_list(F.struct("_bit", F.struct(*columns).alias("_entry"))))
        self.table = self.numbered.groupBy("_block").agg(packed.alias("_list"))
        self.columns, self.count = columns, self.numbered.agg(F.count_distinct("_block")).first()[0]

    def beside(self, rows: DataFrame) -> DataFrame:
        """Every row once with each block's number."""
        if not self.count:
            return rows.limit(0).withColumn("_block", F.lit(0).cast("long"))
        return rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.count - 1).cast("long"))).alias("_block"))

    def opened(self, rows: DataFrame, finished: Column | None = None) -> DataFrame:
        """Entries beside the rows' other columns; ``finished`` has the bits of those to leave out."""
        table = F.broadcast(self.table) if self.count <= BROADCAST_BLOCKS else self.table
        left = F.col("_list")
        if finished is not None:
            done = F.coalesce(finished, F.lit(0).cast("long"))
            left = F.filter(left, lambda e: F.getbit(done, e["_bit"]) == 0)
        joined = rows.join(table, "_block").withColumn("_left", left)
        kept = [c for c in rows.columns if c != "_block" and not c.startswith("_done")]
        return joined.select(*kept, F.explode("_left").alias("_e")).select(*kept, *[F.col(f"_e._entry.{c}").alias(c) for c in self.columns])


def grid(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Every row with every entry of a list."""
    blocks = Blocks(entries)
    return blocks.opened(blocks.beside(rows))


def unfinished(rows: DataFrame, entries: DataFrame, done: DataFrame, row_key: str, entry_key: str) -> DataFrame:
    """Pairs of a row and an entry that ``done`` (both keys) does not have.

    What is finished becomes one long of bits for each row key and block, and
    only unset bits become pairs: finished pairs never exist as rows.  A null
    key is never finished.
    """
    blocks = Blocks(entries)
    places = blocks.numbered.select(F.col(entry_key).alias("_entry_key"), "_block", "_bit")
    known = done.select(F.col(row_key).alias("_done_row"), F.col(entry_key).alias("_entry_key"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit"))
    bits = known.join(places, "_entry_key").groupBy("_done_row", F.col("_block").alias("_done_block")).agg(F.bit_or(bit).alias("_done_bits"))
    beside = blocks.beside(rows)
    met = beside.join(bits, (F.col(row_key) == F.col("_done_row")) & (F.col("_block") == F.col("_done_block")), "left")
    return blocks.opened(met, F.col("_done_bits"))
