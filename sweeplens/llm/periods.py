"""Periodic runs of words: stretches that repeat one period four times or more.

A run is a stretch of consecutive words with smallest period q, at least
max(6, 4 q) long, that no neighbouring word extends keeping q.  Periods are
sought by octaves [S, 2 S).  In an octave a text has a boundary every S words,
and a tile reaches from 4 S words before its boundary to 6 S behind it.  A run
holds at least one boundary c with the 2 S words from c and from c + q alike, so
a tile whose boundary words do not return at any distance of the octave holds
nothing and is never made.  Tiles that remain, overlapping ones in pieces of bounded
size, are dealt over the tasks whatever document they come from.  A tile is
solved by two Z-functions at its boundary: words matched forwards at every lag,
and backwards.  Fragments go to their (document, period), where those that
overlap by a period or more are stitched; equal intervals keep the smallest
period.

Words are compared by 64-bit hashes.  Null and empty texts have no words and no
runs; equal rows have equal results; rows with one id and different texts are
kept apart, as the key of a document is its id and a hash of its text; null ids
are an id of their own.  Long texts are cut into tiles like any other, only
their words are found, and their runs put together, in one task.  Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sweeplens.llm import textarrays
from sweeplens.llm.shared import bounded_batches, partitions, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST, TIMES = 6, 4  # a run has so many words, and so many periods
BOUNDARIES = 64  # of the tiles that travel in one row
CELLS = 1 << 20  # comparisons made at a time
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_TURN = np.uint64(0x9E3779B97F4A7C15)

Order = Callable[[int | None, int], np.ndarray | None]


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, first and last byte of each word, first word of each text (one entry more than texts)."""
    raw, bounds = textarrays.text_bytes(column)
    inside = np.zeros(raw.size + 2, dtype=bool)
    inside[1:-1] = ~_WHITE[raw]
    edge = np.zeros(raw.size + 1, dtype=bool)
    edge[bounds] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return raw, start, end, np.searchsorted(start, bounds)


def taken(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches ``values[start: start + length]`` one after another."""
    shift = start - (np.cumsum(length) - length)
    return values[np.repeat(shift, length) + np.arange(int(length.sum()))]


def doubled(grams: np.ndarray, size: int) -> np.ndarray:
    """Hashes of 2 ``size`` words from each place, from those of ``size``; those that reach over the end mean nothing."""
    return textarrays.mix(grams * _TURN + np.concatenate((grams[size:], np.zeros(min(size, grams.size), np.uint64))))


def boundaries(hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(octave's smallest period, text, its boundaries whose words return at a distance of the octave)."""
    n = np.diff(first)
    small, value = 1, hashes
    while n.size and n.max() >= max(LEAST, TIMES * small):
        value, gram = doubled(value, small), 2 * small
        count = np.where(n >= max(LEAST, TIMES * small), (n - small - gram) // small + 1, 0)
        text = np.repeat(np.arange(n.size), count)
        place = small * (np.arange(text.size) - np.repeat(np.cumsum(count) - count, count))
        lags = np.arange(small, 2 * small)
        hit = np.zeros(text.size, dtype=bool)
        step = max(1, CELLS // small)
        for at in range(0, text.size, step):
            t, c = text[at: at + step], place[at: at + step]
            here = first[t] + c
            there = here[:, None] + lags
            equal = value[np.minimum(there, value.size - 1)] == value[here][:, None]
            hit[at: at + step] = (equal & (there + gram <= first[t + 1][:, None])).any(axis=1)
        found = np.flatnonzero(hit)
        ends = np.flatnonzero(np.append(np.diff(text[found]) > 0, True)) + 1 if found.size else []
        for part in np.split(found, ends[:-1]) if found.size else []:
            yield small, int(text[part[0]]), place[part]
        small = gram


def spans(small: int, n: int, cuts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Stretches [low, high) of overlapping tiles, with their boundaries; long ones in pieces."""
    ends = np.concatenate((np.flatnonzero(np.diff(cuts) > 10 * small) + 1, [cuts.size]))
    at = 0
    for end in ends.tolist():
        while at < end:
            some = cuts[at: min(end, at + BOUNDARIES)]
            yield max(0, int(some[0]) - 4 * small), min(n, int(some[-1]) + 6 * small), some
            at += some.size


def z_function(x: list[int]) -> list[int]:
    """For each place, how far the list from there agrees with the whole list from its begin."""
    n = len(x)
    z = [0] * n
    z[0] = n
    left = right = 0
    for i in range(1, n):
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        else:
            k = 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z


def _primes(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return [*out, q] if q > 1 else out


def fragments(codes: list[int], cut: int, small: int) -> list[tuple[int, int, int]]:
    """(period, begin, end) of what a tile shows of runs through its boundary, with the octave's primitive periods."""
    low, high, middle = max(0, cut - 4 * small), min(len(codes), cut + 6 * small), min(len(codes), cut + 2 * small)
    ahead = z_function(codes[cut:high])
    pattern = codes[low:cut][::-1]
    behind = z_function([*pattern, -1, *codes[low:middle][::-1]])[len(pattern) + 1:]
    lags = min(2 * small, middle - cut + 1, high - cut)

    def reach(q: int) -> tuple[int, int]:
        return cut - behind[middle - cut - q], cut + q + ahead[q]

    out = []
    for q in range(small, lags):
        begin, end = reach(q)
        if end - begin < 3 * q:
            continue
        roots = [reach(q // p) for p in _primes(q)]
        if not any(b <= begin and e >= end for b, e in roots):
            out.append((q, begin, end))
    return out


def _documents(batches: Iterator[pa.RecordBatch], order: Order | None) -> Iterator[tuple]:
    """Slices of texts as (rows, bytes, word starts, word ends, first words), words in the asked order."""
    for batch in batches:
        for begin, end in textarrays.slices(batch["text"]):
            rows = batch.slice(begin, end - begin)
            raw, start, stop, first = words(rows["text"])
            if order:
                at = np.arange(start.size)
                for row, name in enumerate(rows["id"].to_pylist()):
                    n = int(first[row + 1] - first[row])
                    turned = order(name, n) if n else None
                    if turned is not None:
                        at[first[row]: first[row + 1]] = first[row] + turned
                start, stop = start[at], stop[at]
            yield rows, raw, start, stop, first


def _joined(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Words, each with a space behind it."""
    size = stop - start + 1
    out = taken(np.append(raw, np.uint8(32)), start, size)
    out[np.cumsum(size) - 1] = 32
    return out


def _texts(raw: np.ndarray, start: np.ndarray, stop: np.ndarray, first: np.ndarray, digest: bool) -> list[str]:
    joined = _joined(raw, start, stop)
    ends = np.concatenate(([0], np.cumsum(stop - start + 1)))[first].tolist()
    found = (joined[a: max(a, b - 1)].tobytes() for a, b in zip(ends[:-1], ends[1:]))
    return [hashlib.sha256(t).hexdigest() if digest else t.decode("utf-8") for t in found]


_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_FOUND = ("kind int, id bigint, key bigint, small bigint, low bigint, codes array<int>, cuts array<int>, text string")


def _tiles(batches: Iterator[pa.RecordBatch], order: Order | None, digest: bool) -> Iterator[pa.RecordBatch]:
    """Texts without tiles, finished (0); tiles (1); texts with tiles (2)."""
    schema = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("key", pa.int64()), ("small", pa.int64()), ("low", pa.int64()),
                        ("codes", pa.list_(pa.int32())), ("cuts", pa.list_(pa.int32())), ("text", pa.string())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for rows, raw, start, stop, first in _documents(batches, order):
        hashes = textarrays.part_hash(textarrays.running_hash(raw), start, stop)
        ids, keys = rows["id"].to_pylist(), rows["key"].to_pylist()
        tiled = np.zeros(rows.num_rows, dtype=bool)
        out, held = [], 0
        for small, text, cuts in boundaries(hashes, first):
            tiled[text] = True
            for low, high, some in spans(small, int(first[text + 1] - first[text]), cuts):
                _, codes = np.unique(hashes[first[text] + low: first[text] + high], return_inverse=True)
                out.append((1, ids[text], keys[text], small, low, codes.astype(np.int32), (some - low).astype(np.int32), None))
                held += codes.size
                if held > CELLS:
                    yield batch_of(out)
                    out, held = [], 0
        texts = _texts(raw, start, stop, first, digest)
        whole = rows["text"].take(pa.array(np.flatnonzero(tiled))).to_pylist()
        out += [(2, ids[r], keys[r], None, None, None, None, t) for r, t in zip(np.flatnonzero(tiled).tolist(), whole)]
        out += [(0, ids[r], keys[r], None, None, None, None, texts[r]) for r in np.flatnonzero(~tiled).tolist()]
        for at in range(0, len(out), 4096):
            yield batch_of(out[at: at + 4096])


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for name, key, small, low, codes, cuts in zip(*(batch[c].to_pylist() for c in ("id", "key", "small", "low", "codes", "cuts"))):
            out += [(name, key, q, low + b, low + e) for cut in cuts for q, b, e in fragments(codes, cut, small)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["id", "key", "period", "begin", "end"])


def _collapsed(batches: Iterator[pa.RecordBatch], order: Order | None, digest: bool) -> Iterator[pa.RecordBatch]:
    """Texts without the words that a run holds after its first period."""
    for rows, raw, start, stop, first in _documents(batches, order):
        runs = rows["runs"]
        size = pa.compute.fill_null(pa.compute.list_value_length(runs), 0).to_numpy(zero_copy_only=False)
        flat = runs.flatten()
        begin, length, period = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        base = np.repeat(first[:-1], size)
        change = np.zeros(start.size + 1, dtype=np.int64)
        np.add.at(change, base + begin + period, 1)
        np.add.at(change, base + begin + length, -1)
        keep = np.cumsum(change)[:-1] == 0
        kept = np.concatenate(([0], np.cumsum(keep)))[first]
        yield pa.RecordBatch.from_arrays([rows["id"], runs, pa.array(_texts(raw, start[keep], stop[keep], kept, digest), pa.string())],
                                         names=["id", "runs", "collapsed"])


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: Order | None = None, digest: bool = False) -> DataFrame:
    """Columns id, runs (start, length, period of each, by start, then period) and collapsed, a row for each document.

    ``collapsed`` has the words that no run holds after its first period, joined
    by one space, or with ``digest`` the SHA-256 of that text.  ``order(id, n)``
    may give other word numbers to read a text of ``n`` words by.  Ids are
    integers.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    chosen = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text"))
    keyed = chosen.withColumn("key", F.xxhash64("id", "text"))
    found = written(keyed.mapInArrow(lambda batches: _tiles(batches, order, digest), _FOUND), "tiles")
    tiles = found.where("kind = 1").select("id", "key", "small", "low", "codes", "cuts")
    dealt = tiles.repartition(partitions(spark), F.xxhash64("key", "small", "low"))
    pieces = dealt.mapInArrow(_solved, "id bigint, key bigint, period bigint, begin bigint, end bigint")
    stitched = runs_of(pieces.distinct())
    named = stitched.groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    named = named.select(F.col("id").alias("_id"), F.col("key").alias("_key"), "runs")
    texts = found.where("kind = 2").select("id", "key", "text")
    joined = texts.join(named, (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    tidy = joined.select("id", "text", F.coalesce("runs", F.array().cast(_RUNS)).alias("runs"))
    with_tiles = tidy.mapInArrow(lambda batches: _collapsed(batches, order, digest), f"id bigint, runs {_RUNS}, collapsed string")
    without = found.where("kind = 0").select("id", F.array().cast(_RUNS).alias("runs"), F.col("text").alias("collapsed"))
    return without.unionByName(with_tiles).withColumnRenamed("id", id_col)


def runs_of(pieces: DataFrame) -> DataFrame:
    """Maximal runs (id, key, start, length, period) from fragments (id, key, period, begin, end)."""
    order = Window.partitionBy("id", "key", "period").orderBy("begin", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("begin") + F.col("period") > reached, F.lit(True)).cast("int")
    islands = pieces.withColumn("apart", apart).withColumn("island", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = islands.groupBy("id", "key", "period", "island").agg(F.min("begin").alias("start"), F.max("end").alias("stop"))
    whole = whole.where(F.col("stop") - F.col("start") >= F.greatest(F.lit(LEAST), TIMES * F.col("period")))
    least = whole.groupBy("id", "key", "start", "stop").agg(F.min("period").alias("period"))
    return least.select("id", "key", "start", (F.col("stop") - F.col("start")).alias("length"), "period")
