"""Quality by importance resampling of hashed n-grams.

Two generative models count hashed words and word pairs: one of target texts,
one of all raw texts.  The logarithm of their ratio, summed over a text, is its
importance weight.  Adding Gumbel noise and keeping the k largest sums draws k
texts without replacement, each with a chance in proportion to its weight.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweeplens.llm import textarrays
from sweeplens.llm.shared import kth_smallest, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 1 << 16  # hashed n-grams
TARGETS = 20_000  # target texts at most
SMOOTH = 0.5
_BLOCK = 1 << 12  # counts of a row on the way to their sum


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of each word and of each pair of neighbours."""
    w = textarrays.words(column, split_punctuation=True)
    same = w.doc[1:] == w.doc[:-1]
    pairs = textarrays.mix(w.hash[:-1][same] * np.uint64(3) + w.hash[1:][same])
    return (np.concatenate((w.doc, w.doc[:-1][same])),
            (np.concatenate((w.hash, pairs)) >> np.uint64(40)).astype(np.int64) % BUCKETS)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of one task's n-grams, cut into blocks."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for a, b in textarrays.slices(batch.column(0)):
            total += np.bincount(_grams(batch.column(0).slice(a, b - a))[1], minlength=BUCKETS)
    blocks = np.arange(BUCKETS // _BLOCK)
    yield pa.RecordBatch.from_arrays(
        [pa.array(blocks, pa.int32()), pa.array(list(total.reshape(-1, _BLOCK)), pa.list_(pa.int64()))], names=["block", "counts"])


def gram_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of all hashed n-grams of all texts: one array of fixed size from each task, summed by block."""
    rows = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_counts, "block int, counts array<bigint>")
    summed = (rows.select("block", F.posexplode("counts").alias("i", "n")).groupBy("block", "i").agg(F.sum("n").alias("n"))
              .where("n > 0").collect())  # BUCKETS rows at most
    out = np.zeros(BUCKETS)
    for r in summed:
        out[r["block"] * _BLOCK + r["i"]] = r["n"]
    return out


def _weigh(ratio):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in textarrays.slices(batch.column(1)):
                doc, bucket = _grams(batch.column(1).slice(a, b - a))
                weight = np.bincount(doc, weights=ratio.value[bucket], minlength=b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(weight), batch.column(2).slice(a, b - a)],
                                                 names=["doc_id", "log_weight", "tie"])

    return run


def resample(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
             share: float | None = None, targets: int = TARGETS, seed: int = 0) -> DataFrame:
    """doc_id, log_weight, gumbel_key and keep of every document; ``keep`` marks the k drawn ones.

    k is ``share`` of all documents, by default the share of label 1 among the
    labels.  Target texts are at most ``targets`` labelled 1, those with the
    smallest hashes of their id; raw counts cover all texts.  Noise is drawn by
    hash of seed, id and text, so the draw does not depend on partitions and
    retries.  Null and empty texts weigh 0; null ids are kept apart by their
    texts; equal rows are drawn together, so k is passed by less than the copies
    of one row.  Without labels of 1 all weights are 0 and the draw is even.
    """
    spark = documents.sparkSession
    each = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
            .groupBy(F.col(id_col).cast("bigint").alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("label")))
    n = {r["label"]: r["n"] for r in each.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if share is None:
        share = n.get(1, 0) / sum(n.values()) if n else 1.0
    drawn = each.where("label = 1").orderBy(F.xxhash64("_id"), "_id").limit(targets)
    rows = documents.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("text"))
    raw = gram_counts(rows)
    target = gram_counts(rows.join(F.broadcast(drawn.select("_id")), "_id")) if n.get(1) else raw
    ratio = np.log((target + SMOOTH) / (target.sum() + SMOOTH * BUCKETS)) - np.log((raw + SMOOTH) / (raw.sum() + SMOOTH * BUCKETS))
    shared = spark.sparkContext.broadcast(ratio)
    keyed = rows.select(F.col("_id").alias("doc_id"), "text", F.xxhash64("_id", "text", F.lit(seed)).alias("tie"))
    weights = keyed.mapInArrow(_weigh(shared), "doc_id bigint, log_weight double, tie bigint")
    u = (F.shiftrightunsigned("tie", 12) + 0.5) / float(2**52)
    weights = written(weights.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u))), "weights")
    k = round(share * weights.count())
    order = (-F.floor(F.col("gumbel_key") * float(2**24))).cast("bigint")
    cut = kth_smallest(weights, order, k) if k else None
    keep = F.lit(False) if cut is None else order < cut
    if cut is not None:  # the rows at the border in order of their tie
        border = weights.where(order == cut)
        rest = k - weights.where(order < cut).count()
        last = kth_smallest(border, F.col("tie"), rest)
        keep = keep | ((order == cut) & (F.col("tie") <= last))
    return weights.select("doc_id", "log_weight", "gumbel_key", keep.alias("keep"))
