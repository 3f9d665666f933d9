"""Incremental results, progress, run summaries and response scoring.

Batch and stream share their column functions.  Every query checkpoints into
the shared folder and writes each micro-batch to a folder of its own, so a
replayed batch overwrites itself instead of adding rows twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sweeplens.functions.text import eta_text
from sweeplens.operators.ordering import latest
from sweeplens.operators.scoring import score_emotions, score_math
from sweeplens.sources.writers import append_results


def file_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 64,
                partitions: int | None = None) -> DataFrame:
    """Stream of the files called ``name`` in a folder; the schema comes from the files.

    ``partitions`` deals each micro-batch over that many tasks, for costly
    per-row work on few big files.
    """
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    stream = (
        spark.readStream.schema(schema).option("pathGlobFilter", name)
        .option("maxFilesPerTrigger", files_per_batch).parquet(folder))
    return stream.repartition(partitions) if partitions else stream


def _start(stream: DataFrame, write, checkpoint: str, mode: str) -> StreamingQuery:
    return (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(write).start())


def ingest(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append every micro-batch to ``table``; read it through ``latest_results``."""
    return _start(stream, lambda df, batch: append_results(df, table, batch), checkpoint, "append")


def changes(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append the rows of an aggregate that a micro-batch changed (update mode); read them through ``current``.

    Only changed keys leave the state store, and keys behind the watermark are
    dropped from it: neither the output of a batch nor the state grows with what
    was finished before.
    """
    return _start(stream, lambda df, batch: append_results(df, table, batch), checkpoint, "update")


def current(spark: SparkSession, table: str, keys: list[str]) -> DataFrame:
    """The newest row of each key among the changes."""
    return latest(spark.read.parquet(table), keys, ["batch"]).drop("batch")


def progress(stream: DataFrame, ts: str, worker: str, window: str = "5 minutes", delay: str = "1 hour") -> DataFrame:
    """Finished results per time window and worker; a window's state is dropped once ``delay`` has passed."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    return timed.groupBy(F.window("_ts", window), worker).agg(F.count("*").alias("completed")).select(
        F.col("window.start").alias("window_start"), worker, "completed")


def queue_status(expected: DataFrame, done: DataFrame, key: str, worker: str, ts: str) -> DataFrame:
    """Completed, remaining, rate and ETA per worker from a plain result table."""
    total = expected.agg(F.count_distinct(key)).scalar()
    per = done.groupBy(worker).agg(
        F.count_distinct(key).alias("completed"),
        (F.unix_timestamp(F.max(ts)) - F.unix_timestamp(F.min(ts))).alias("elapsed"))
    out = per.withColumn("remaining", total - F.col("completed"))
    rate = F.when(F.col("elapsed") > 0, F.col("completed") / F.col("elapsed")).otherwise(0.0)
    return with_eta(out.withColumn("rate", rate))


def with_eta(df: DataFrame, remaining: str = "remaining", rate: str = "rate") -> DataFrame:
    left: Column = F.col(remaining) / F.nullif(F.col(rate), F.lit(0.0))
    return df.withColumn("eta", F.when((F.col(remaining) > 0) & (F.col(rate) > 0), eta_text(left)).otherwise("N/A"))


def run_summary(stream: DataFrame, ts: str, keys: list[str], delay: str = "1 day") -> DataFrame:
    """Per-condition summary of run records, repeated records dropped.

    The keys seen are forgotten behind the watermark; what stays is one row for
    each condition.
    """
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    return timed.dropDuplicatesWithinWatermark(keys).groupBy("condition").agg(
        F.count("*").alias("tasks"), F.count_if("success").alias("successes"), F.sum("steps").alias("steps"))


def scored_math(stream: DataFrame) -> DataFrame:
    return score_math(stream)


def scored_emotions(stream: DataFrame, mode: str = "blend") -> DataFrame:
    return score_emotions(stream, mode=mode)
