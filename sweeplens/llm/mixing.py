"""Mixing of sources: tempered token shares, realised as budgeted block permutations.

A source's weight is its token share to the power of an exponent, normalised.
The exponent is the one that meets a target entropy of the weights, or the
smallest (flattest) one under which no source repeats more often than a limit.
Each source then gives as many whole blocks (each a permutation of all its
documents) as its budget holds, and of one more block the beginning.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweeplens.llm.shared import free_name, written

GRID = 32  # exponents tried in a pass; each pass narrows the range that many times
PASSES = 6
BINS = 4096  # of a source's permutation, for the place where a budget ends


@dataclass
class Mix:
    exponent: float
    budget: float  # tokens of the mixture
    entropy: float  # of the weights, natural logarithm
    repetition: float  # blocks of the most repeated source


def word_count(text: Column) -> Column:
    """Tokens of a text for mixing: runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("bigint")


def source_tokens(documents: DataFrame, source_col: str, tokens: Column) -> DataFrame:
    """Documents and tokens of each source, null included: written table (source, docs, tokens)."""
    return written(documents.select(F.col(source_col).cast("string").alias("source"), tokens.alias("tokens"))
                   .groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens")), "sources")


def _measures(sources: DataFrame, exponents: list[float], total: float) -> dict[float, tuple[float, float, float]]:
    """For each exponent: entropy of the weights, largest and smallest weight per token share.

    Shares are taken relative to the largest one, so that no exponent makes all of them vanish.
    """
    top = float(sources.agg(F.max("tokens")).first()[0])
    share, ratio, t = F.col("tokens") / total, F.col("tokens") / top, F.col("t")
    rows = (sources.where("tokens > 0").select(share.alias("p"), ratio.alias("q"), F.explode(F.array(*[F.lit(float(t)) for t in exponents])).alias("t"))
            .groupBy("t").agg(F.sum(F.pow("q", t)).alias("z"), F.sum(F.pow("q", t) * F.log("q")).alias("l"),
                              F.max(F.pow("q", t) / F.col("p")).alias("most"), F.min(F.pow("q", t) / F.col("p")).alias("least")).collect())
    return {r["t"]: (math.log(r["z"]) - r["t"] * r["l"] / r["z"], r["most"] / r["z"], r["least"] / r["z"]) for r in rows}


def solve(sources: DataFrame, max_repetition: float | None = None, entropy: float | None = None,
          budget: float | None = None) -> Mix:
    """The exponent for a repetition limit (in [0, 1]) or a target entropy (from 0 on).

    Without ``budget`` the mixture is just large enough for every source to
    appear whole once.  Entropy falls and so does repetition when the exponent
    grows, so both are found by narrowing a range; a target out of reach gives
    the nearest end.  No source's numbers reach the driver, only sums.
    """
    if (max_repetition is None) == (entropy is None):
        raise ValueError("give either max_repetition or entropy")
    total = float(sources.agg(F.sum("tokens")).first()[0] or 0)
    if not total:
        return Mix(1.0, 0.0, 0.0, 0.0)

    def tokens(m: tuple) -> float:
        return total / m[2] if budget is None else float(budget)

    def enough(m: tuple) -> bool:
        """The exponent is large enough."""
        if entropy is not None:
            return m[0] <= entropy
        return m[1] * tokens(m) / total <= max_repetition * (1 + 1e-12)

    low, high = 0.0, 1.0
    if entropy is not None:
        here = _measures(sources, [high], total)[high]
        while not enough(here):  # until the target is bracketed, or the largest sources alone are left
            after = _measures(sources, [2 * high], total)[2 * high]
            if here[0] - after[0] < 1e-12 or after[2] < 1e-280:
                break
            low, high, here = high, 2 * high, after
    for _ in range(PASSES):
        tried = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        found = _measures(sources, tried, total)
        above = [t for t in tried if enough(found[t])]
        high = min(above, default=high)
        low = max((t for t in tried if t < high), default=high)
        if high == low or not above:
            break
    m = _measures(sources, [high], total)[high]
    return Mix(high, tokens(m), m[0], m[1] * tokens(m) / total)


def _fraction(*parts: Column) -> Column:
    """A number in [0, 1) drawn by hash, 52 bits."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 12) / float(2**52)


def mix(documents: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id",
        max_repetition: float | None = 1.5, entropy: float | None = None, budget: float | None = None,
        tokens: Column | None = None, seed: int = 0) -> DataFrame:
    """Documents in the mixture: all columns, and ``epoch`` (block, from 1) and ``mix_key`` in [0, 1).

    Sorted by ``mix_key`` the sources run evenly through the mixture.  A new
    column whose name is taken gets underscores at its end.  A null source is a
    source.  A source without tokens has weight 0 and appears once.  Places in
    a block are drawn by hash of seed, block, id and text, so they do not depend
    on partitions and retries; equal rows share a place and come and go together.
    A budget's end falls between documents, so a source stays within it by less
    than one document.  An empty table gives an empty result.
    """
    count = word_count(F.col(text_col)) if tokens is None else tokens
    sources = source_tokens(documents, source_col, count)
    found = solve(sources, max_repetition, entropy, budget)
    top = float(sources.agg(F.max("tokens")).first()[0] or 0) or 1.0  # relative to it, no exponent makes all shares vanish
    power = F.pow(F.col("tokens") / top, F.lit(found.exponent))
    z = float(sources.where("tokens > 0").agg(F.sum(power)).first()[0] or 1.0)
    share = F.when(F.col("tokens") > 0, power / z).otherwise(0.0)
    blocks = F.when(F.col("tokens") > 0, share * found.budget / F.col("tokens")).otherwise(1.0)
    near = F.round(blocks)  # a source meant to appear whole does not lose a document to rounding
    blocks = F.when(F.abs(blocks - near) < 1e-6, near).otherwise(blocks)
    plans = sources.withColumn("weight", share).withColumn("blocks", blocks)
    plans = plans.withColumn("whole", F.floor("blocks").cast("int")).withColumn("rest", (F.col("blocks") - F.floor("blocks")) * F.col("tokens"))
    draw = lambda block: _fraction(F.lit(seed), block, F.col("_id"), F.xxhash64("_text"))

    base = documents.select(F.struct("*").alias("_row"), F.col(source_col).cast("string").alias("_source"),
                            F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), count.alias("_tokens"))
    joined = base.join(plans, F.col("_source").eqNullSafe(F.col("source")))
    last = joined.where("rest > 0").select("source", "rest", "_tokens", draw(F.col("whole") + 1).alias("u"))
    last = written(last.withColumn("bin", F.floor(F.col("u") * BINS).cast("int")), "lastblock")
    by_bin = last.groupBy("source", "bin").agg(F.sum("_tokens").alias("n"), F.first("rest").alias("rest"))
    order = Window.partitionBy("source").orderBy("bin")
    by_bin = by_bin.withColumn("until", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cut_bin = by_bin.where("until > rest").groupBy("source").agg(F.min(F.struct("bin", (F.col("until") - F.col("n")).alias("before"), "rest")).alias("c"))
    inner = (last.alias("l").join(cut_bin.alias("b"), F.col("l.source").eqNullSafe(F.col("b.source")) & (F.col("l.bin") == F.col("b.c.bin")))
             .groupBy("l.source", "l.bin", "l.u").agg(F.sum("_tokens").alias("n"), F.first("b.c").alias("c")))
    running = F.sum("n").over(Window.partitionBy("source", "bin").orderBy("u"))
    cut = (inner.withColumn("over", F.col("c.before") + running > F.col("c.rest")).where("over")
           .groupBy("source").agg(F.min("u").alias("cut")).withColumnRenamed("source", "_cut_source"))
    plans = written(plans.join(cut, F.col("source").eqNullSafe(F.col("_cut_source")), "left").drop("_cut_source")
                    .withColumn("cut", F.coalesce("cut", F.when(F.col("rest") > 0, 1.0).otherwise(0.0))), "plans")

    columns = documents.columns
    epoch, key = free_name("epoch", columns), free_name("mix_key", [*columns, "epoch"])
    out = base.join(plans, F.col("_source").eqNullSafe(F.col("source")))
    blocks_of = F.col("whole") + F.when(draw(F.col("whole") + 1) < F.col("cut"), 1).otherwise(0)
    out = out.withColumn("_epoch", F.explode(F.when(blocks_of > 0, F.sequence(F.lit(1), blocks_of)).otherwise(F.array().cast("array<int>"))))
    drawn = draw(F.col("_epoch"))
    place = F.when(F.col("_epoch") > F.col("whole"), drawn / F.col("cut") * (F.col("blocks") - F.col("whole"))).otherwise(drawn)
    return out.select("_row.*", F.col("_epoch").alias(epoch), ((F.col("_epoch") - 1 + place) / F.col("blocks")).alias(key))
