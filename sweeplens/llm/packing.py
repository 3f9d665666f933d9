"""Packing of tokenised documents into few sequences: exact complements first, best fit for the rest.

Only the number of pieces of each length matters for a packing, so the plan is
made from at most ``size`` counts, whatever the input holds.  Sums of one, two
and three lengths are indexed; a combination that fills a sequence exactly is
taken as often as its pieces are available.  What is left is packed by best
fit, longest first, again by count.  The plan is a list of patterns (lengths of
a sequence) with multiplicities.  Pieces then find their places by their rank
among those of their length, which is counted in two steps: per written part,
and within it.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sweeplens.llm import textarrays, tokens
from sweeplens.llm.shared import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIZE = 2048
END_ID = 0
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, place bigint"


def plan(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """The shortest of the plans whose long pieces are filled exactly by up to 3, 2, 1 or no others.

    Filling long pieces' gaps with many short ones can leave none for the rest,
    so the number of parts is tried out; a plan takes a fraction of a second.
    """
    return min((filled(counts, size, parts) for parts in (3, 2, 1, 0)), key=lambda p: sum(t for _, t in p))


def filled(counts: dict[int, int], size: int, most_parts: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used; every piece is in one, no pattern exceeds ``size``.

    A gap is what the longest piece leaves of a sequence.  It is filled by
    lengths whose sum it is, the split with the longest parts first, as often as
    counts allow: single lengths for all gaps, then pairs, then triples, so that
    short pieces last.  Lengths without an exact filling go to best fit, those
    over half a sequence before shorter ones fill each other's gaps.
    """
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] += n
    out: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...]) -> None:
        need = {x: pattern.count(x) for x in pattern}
        times = min(int(left[x]) // n for x, n in need.items())
        if times:
            for x, n in need.items():
                left[x] -= n * times
            out.append((pattern, times))

    def exact(longest_first: range, most: int) -> None:
        for parts in range(1, most + 1):
            for longest in longest_first:
                while left[longest]:
                    before = int(left[longest])
                    for pattern in _fillings(longest, left, size, parts):
                        take(pattern)
                        if not left[longest]:
                            break
                    if left[longest] == before:
                        break

    take((size,))
    half = size // 2
    exact(range(size - 1, half, -1), most_parts)
    if left[half + 1:].any():
        # a piece over half needs a sequence of its own: it gets what fits best before shorter ones use that up
        with_long = [(p, t) for p, t in _best_fit(left, size) if p[0] > half]
        for pattern, times in with_long:
            for x in pattern:
                left[x] -= times
        out += with_long
    exact(range(half, 0, -1), 3)
    out += _best_fit(left, size)
    return out


def _fillings(longest: int, left: np.ndarray, size: int, parts: int) -> Iterator[tuple[int, ...]]:
    """Exact fillings by ``parts`` lengths of a sequence that starts with ``longest``, from lengths that are left."""
    gap = size - longest
    if parts == 1:
        if gap <= longest and left[gap]:
            yield longest, gap
        return
    have = left > 0
    a = np.arange(min(gap - parts + 1, longest), (gap - 1) // parts, -1)
    if parts == 2:
        for x in a[have[a] & have[gap - a]].tolist():
            if left[x] and left[gap - x]:
                yield longest, x, gap - x
        return
    if a.size == 0:
        return
    # the sums of two lengths up to the gap are indexed by convolution, then split
    short = have[: gap + 1].astype(float)
    width = 1 << int(2 * gap + 2).bit_length()
    sums = np.fft.irfft(np.fft.rfft(short, width) ** 2, width)[: gap + 1] > 0.5
    for x in a[have[a] & sums[gap - a]].tolist():
        rest = gap - x
        y = np.arange(min(rest - 1, x), (rest - 1) // 2, -1)
        for v in y[have[y] & have[rest - y]].tolist():
            if left[x] and left[v] and left[rest - v]:
                yield longest, x, v, rest - v


def _best_fit(left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, of what is left: sequences with equal contents are one entry with a count."""
    open_by_gap: dict[int, list[list]] = {}
    gaps = np.zeros(size + 1, dtype=bool)
    done: list[tuple[tuple[int, ...], int]] = []

    def put(pattern: tuple[int, ...], times: int) -> None:
        gap = size - sum(pattern)
        if gap == 0:
            done.append((pattern, times))
        else:
            open_by_gap.setdefault(gap, []).append([pattern, times])
            gaps[gap] = True

    for length in range(size, 0, -1):
        n = int(left[length])
        while n:
            fitting = np.flatnonzero(gaps[length:])
            if not fitting.size:
                each = size // length
                if n // each:
                    put((length,) * each, n // each)
                if n % each:
                    put((length,) * (n % each), 1)
                n = 0
                break
            gap = int(fitting[0]) + length
            entry = open_by_gap[gap].pop()
            if not open_by_gap[gap]:
                gaps[gap] = False
            each = gap // length
            full = min(entry[1], n // each)
            if full:
                put(entry[0] + (length,) * each, full)
                n -= full * each
            rest = entry[1] - full
            if rest and n and n < each:
                put(entry[0] + (length,) * n, 1)
                n, rest = 0, rest - 1
            if rest:
                put(entry[0], rest)
    return done + [(p, t) for entries in open_by_gap.values() for p, t in entries]


def _pieces(model, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(size + 1, dtype=np.int64)  # pieces of each length so far in this part
        encoder = tokens.encoder(model.value)
        for batch in batches:
            for a, b in textarrays.slices(batch.column(1), tokens.SLICE):
                ids, first = encoder.encode(batch.column(1).slice(a, b - a))
                docs = batch.column(0).slice(a, b - a)
                n_ids = np.diff(first) + 1
                n = -(-n_ids // size)
                doc = np.repeat(np.arange(len(n)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * size
                length = np.minimum(n_ids[doc] - start, size)
                # ids with the end id after each document
                whole = np.insert(ids, first[1:], np.uint32(END_ID)).astype("<u4")
                begin = (first[:-1] + np.arange(len(n)))[doc] + start
                raw = memoryview(whole.tobytes())
                crc = [zlib.crc32(raw[4 * s: 4 * (s + m)]) for s, m in zip(begin.tolist(), length.tolist())]
                order = np.argsort(length, kind="stable")
                sizes, at, counts = np.unique(length[order], return_index=True, return_counts=True)
                place = np.empty(len(doc), dtype=np.int64)
                place[order] = np.arange(len(doc)) - np.repeat(at, counts) + np.repeat(seen[sizes], counts)
                seen[sizes] += counts
                yield pa.RecordBatch.from_arrays(
                    [docs.take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                     pa.array(np.full(len(doc), part), pa.int32()), pa.array(place)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"])
        encoder.rest()

    return run


def pieces(documents: DataFrame, tokenizer: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of whole texts, each text with the end id 0; written once, so that places stay as they are."""
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(tokens.tokenizer_json(tokenizer))
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(_pieces(model, size), PIECES), "pieces")


def _places(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks, sequences, offsets, copies = table.value
        bounds = np.searchsorted(lengths, np.arange(lengths[-1] + 2 if lengths.size else 1))
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            at = np.empty(len(length), dtype=np.int64)
            for x in np.unique(length):
                own = np.flatnonzero(length == x)
                low, high = bounds[x], bounds[x + 1]
                at[own] = low + np.searchsorted(ranks[low:high], rank[own], side="right") - 1
            nth = rank - ranks[at]
            # the pieces of a slot are dealt to its sequences in turn
            sequence = sequences[at] + nth // copies[at]
            offset = offsets[at] + (nth % copies[at]) * length
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[np.ndarray]:
    """The plan as a table by length: first rank, first sequence, offset there, pieces of the length in a sequence."""
    rows, used, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            copies = pattern.count(length)
            rows.append((length, used.get(length, 0), sequence, offset, copies))
            used[length] = used.get(length, 0) + copies * times
            offset += copies * length
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return [table[:, i].copy() for i in range(5)]


def pack(found: DataFrame, size: int = SIZE) -> DataFrame:
    """Place every piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Offsets of a sequence are gapless from 0 and end at ``size`` or before.  The
    driver holds one count a length and the plan, which has few entries a
    length; ranks come from counts a written part and length.  Repeated and null
    document ids are packed like others; an empty table gives an empty result.
    """
    spark = found.sparkSession
    # one narrow row a part and length
    counts = found.groupBy("part", "length").count()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = written(counts.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))), "counts")
    totals = {r["length"]: r["n"] for r in based.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    table = spark.sparkContext.broadcast(slots(plan(totals, size)))
    ranked = found.join(based.select("part", "length", "base"), ["part", "length"]).withColumn("rank", F.col("place") + F.col("base"))
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_places(table), schema)
