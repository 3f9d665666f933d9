"""Passages that repeat across documents, by compact windows of min-hashed shingles.

For a hash function, every stretch of at least ``shortest`` shingles has a
smallest hash at some place.  The Cartesian tree of a text's hashes lists the
places that can be it, each with its compact window: the widest stretch in
which it is the smallest.  All stretches of a text share about two windows a
``shortest`` shingles.  Two texts that repeat a passage have windows with the
same smallest hash, for every function when the passages are equal.

A window's signatures are its smallest hash joined to the smallest hash of the
few shingles right, and left, of it, so that short common lines alone do not
bring texts together.  Texts under one signature are paired with the first of
them, never with each other.  The first may share the signature's few shingles
only, so where three texts or more meet, each also gives all its stretches of
the window, whole, and is paired with the first text of each: no equal passage is
lost, and rows stay in proportion to the texts.  Pairs that share enough signatures
are verified on their texts, which also finds where the passages begin and end.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sweeplens.llm import textarrays
from sweeplens.llm.shared import IdFilter, key_groups, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Rule:
    words: int = 5  # of a shingle
    shortest: int = 50  # words of a passage at least
    over: int = 80  # per cent of the shingles of both passages that are in both
    functions: int = 3  # hash functions
    beside: int = 12  # shingles beside the smallest that a signature looks at
    enough: int = 1  # signatures, of two a function and each of two smallest hashes, that a pair shares at least

    @property
    def stretch(self) -> int:
        return max(1, self.shortest - self.words + 1)


def windows(values: np.ndarray, shortest: int) -> tuple[list[int], list[int], list[int]]:
    """Compact windows of a sequence: first place, place of the smallest, end (exclusive); first of equals."""
    begin, middle, end = [], [], []
    stack = [(0, len(values))] if len(values) >= shortest else []
    while stack:
        a, b = stack.pop()
        c = a + int(values[a:b].argmin())
        begin.append(a)
        middle.append(c)
        end.append(b)
        if c - a >= shortest:
            stack.append((a, c))
        if b - c > shortest:
            stack.append((c + 1, b))
    return begin, middle, end


def _least_beside(h: np.ndarray, doc: np.ndarray, reach: int, step: int) -> np.ndarray:
    """Smallest of the next (step 1) or last (step -1) ``reach`` values of the same text."""
    out = np.full(h.size, 2**64 - 1, dtype=np.uint64)
    for j in range(1, min(reach, h.size - 1) + 1):
        a, b = (slice(0, -j), slice(j, None)) if step > 0 else (slice(j, None), slice(0, -j))
        near = np.where(doc[a] == doc[b], h[b], np.uint64(2**64 - 1))
        out[a] = np.minimum(out[a], near)
    return out


@dataclass
class Signatures:
    """Signatures of a slice of texts; places count the shingles of the slice."""

    key: np.ndarray
    doc: np.ndarray  # place of the text in the slice
    number: np.ndarray  # of the function and side
    begin: np.ndarray
    middle: np.ndarray
    end: np.ndarray
    shingles: np.ndarray
    of: np.ndarray  # per shingle: its text
    sides: list[np.ndarray]  # per shingle: the smallest hash right, and left, of it


def _signatures(column: pa.Array, rule: Rule) -> Signatures:
    w = textarrays.words(column)
    h, first, _ = textarrays.shingles(w.hash, w.first, rule.words)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    beside = textarrays.mix(h ^ np.uint64(0xA0761D6478BD642F))
    sides = [_least_beside(beside, doc, rule.beside, step) for step in (1, -1)]
    long = np.flatnonzero(np.diff(first) >= rule.stretch)
    keys, docs, numbers, places = [], [], [], []
    for j in range(rule.functions):
        value = textarrays.mix(h + np.uint64(0xE7037ED1A0B428DB * (j + 1) & (2**64 - 1)))
        begin, middle, end = [], [], []
        for d in long.tolist():
            at = int(first[d])
            a, c, b = windows(value[at: int(first[d + 1])], rule.stretch)
            begin += [at + x for x in a]
            middle += [at + x for x in c]
            end += [at + x for x in b]
        begin, middle, end = (np.array(x, dtype=np.int64) for x in (begin, middle, end))
        for side, room in enumerate((end - 1 - middle, middle - begin)):
            # the half of a passage that is at least half as long holds all of the neighbours
            wide = room >= rule.beside
            own = middle[wide]
            number = 2 * j + side
            keys.append(textarrays.mix(value[own] + textarrays.mix(sides[side][own] + np.uint64(number + 1))))
            docs.append(doc[own])
            numbers.append(np.full(len(own), number))
            places.append(np.stack((begin[wide], own, end[wide])))
    return Signatures(*(np.concatenate(x) for x in (keys, docs, numbers)), *np.concatenate(places, axis=1), h, doc, sides)


def _packed(key: np.ndarray, doc: np.ndarray, mask: np.ndarray) -> pa.RecordBatch:
    """One row a key: all its documents, and its signature's bit."""
    order = np.lexsort((doc, key))
    key, doc, mask = key[order], doc[order], mask[order]
    if key.size:
        own = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))
        key, doc, mask = key[own], doc[own], mask[own]
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if key.size else np.empty(0, np.int64)
    docs = pa.ListArray.from_arrays(pa.array(np.append(head, key.size), pa.int32()), pa.array(doc, pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(key[head].view(np.int64)), pa.array(mask[head], pa.int32()), docs], names=["key", "mask", "docs"])


_PACKED_TYPE = "key bigint, mask int, docs array<bigint>"


def _spread(rule: Rule):
    """Signatures of a batch of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            found = []
            for a, b in textarrays.slices(batch.column(1)):
                s = _signatures(batch.column(1).slice(a, b - a), rule)
                found.append((s.key, ids[a + s.doc], np.left_shift(1, s.number)))
            if found:
                yield _packed(*(np.concatenate(x) for x in zip(*found)))

    return run


def _stretches(rule: Rule):
    """Of texts with ``keys``: all stretches of the windows that have these signatures, by their hash.

    A signature joined to a smallest hash farther off is a key too, for passages that are alike and not equal.
    """
    everything = (1 << 2 * rule.functions) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["id"].to_numpy()
            for a, b in textarrays.slices(batch["text"]):
                s = _signatures(batch["text"].slice(a, b - a), rule)
                lists = batch["keys"].slice(a, b - a)
                owner = np.repeat(np.arange(b - a), lists.value_lengths().to_numpy())
                wanted = lists.flatten().to_numpy().view(np.uint64) + textarrays.mix(owner.astype(np.uint64))
                at = np.flatnonzero(np.isin(s.key + textarrays.mix(s.doc.astype(np.uint64)), wanted))
                key, doc, middle = s.key[at], s.doc[at], s.middle[at]
                change = np.zeros(s.shingles.size + 1, dtype=np.int64)
                np.add.at(change, np.maximum(s.begin[at], middle - rule.stretch + 1), 1)
                np.add.at(change, np.minimum(middle, s.end[at] - rule.stretch) + 1, -1)
                start = np.flatnonzero(np.cumsum(change)[:-1])
                found = [(_stretch_hashes(s.shingles, rule.stretch)[start], ids[a + s.of[start]], np.full(start.size, everything))]
                for zone, step in enumerate((1, 2, -1, -2)):
                    far = middle + step * rule.beside
                    inside = (far >= 0) & (far < s.of.size)
                    inside[inside] = s.of[far[inside]] == doc[inside]
                    least = s.sides[step < 0][far[inside]]
                    joined = textarrays.mix(key[inside] + textarrays.mix(least + np.uint64(zone + 101)))
                    some = least != np.uint64(2**64 - 1)
                    found.append((joined[some], ids[a + doc[inside][some]], np.left_shift(1, s.number[at][inside][some])))
                yield _packed(*(np.concatenate(x) for x in zip(*found)))  # slice by slice: a batch has millions

    return run


_PAIR = ["key", "a", "b", "mask"]
_PAIR_TYPE = "key bigint, a bigint, b bigint, mask int"


def _merged(a: np.ndarray, b: np.ndarray, mask: np.ndarray) -> pa.RecordBatch:
    """Pairs once each, their bits together."""
    order = np.lexsort((b, a))
    a, b, mask = a[order], b[order], mask[order]
    new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if a.size else np.empty(0, np.int64)
    mask = np.bitwise_or.reduceat(mask, new) if a.size else mask
    n = len(new)
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(a[new], pa.int64()), pa.array(b[new], pa.int64()), pa.array(mask, pa.int32())], names=_PAIR)


def _gathered(open_too: bool):
    """Pairs (a, b) of rows sorted by key: each later document of a key with the first.

    With ``open_too`` also (key, a) for every document of a key that three or more have.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_groups(batches, ["key"]):
            lists = table["docs"].combine_chunks()
            size = lists.value_lengths().to_numpy()
            key, mask = (np.repeat(table[c].to_numpy(), size) for c in ("key", "mask"))
            doc = lists.flatten().to_numpy()
            order = np.lexsort((doc, key))
            key, doc, mask = key[order], doc[order], mask[order]
            own = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))
            key, doc, mask = key[own], doc[own], mask[own]
            head = np.append(True, key[1:] != key[:-1])
            group = np.cumsum(head) - 1
            yield _merged(doc[head][group][~head], doc[~head], mask[~head])
            if open_too:
                many = np.bincount(group)[group] > 2
                n = int(many.sum())
                yield pa.RecordBatch.from_arrays([pa.array(key[many]), pa.array(doc[many]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], names=_PAIR)

    return run


def _stretch_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` values, equal for equal runs wherever they stand."""
    up, _ = textarrays._powers(h.size + 1)
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: h.size], dtype=np.uint64)))
    at = np.arange(max(0, h.size - size + 1))
    return textarrays.part_hash(running, at, at + size)


def _length(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sequences have in common from their first on."""
    n, at, step = min(a.size, b.size), 0, 64
    while at < n:
        differ = np.flatnonzero(a[at: min(n, at + step)] != b[at: min(n, at + step)])
        if differ.size:
            return at + int(differ[0])
        at, step = at + step, 2 * step
    return n


def _maximal(a: np.ndarray, b: np.ndarray, i: int, j: int) -> tuple[int, int, int]:
    """The longest run through a place: where it begins in ``a`` and ``b``, and its size."""
    back = _length(a[:i][::-1], b[:j][::-1])
    return i - back, j - back, back + _length(a[i:], b[j:])


def _runs(a: np.ndarray, b: np.ndarray, rule: Rule) -> np.ndarray:
    """Maximal runs of equal values on all diagonals: rows (begin in ``a``, begin in ``b``, size), by place in ``b``.

    Where values repeat so often that their places pair up beyond a multiple of
    both lengths, the most frequent ones no longer begin runs at each place, but
    runs still go on through them, and every stretch that ``a`` has begins one.
    """
    order = np.argsort(a, kind="stable")
    ranked = a[order]
    left, right = (np.searchsorted(ranked, b, side) for side in ("left", "right"))
    count = right - left
    hits = np.flatnonzero(count)
    if 100 * hits.size < rule.over * rule.stretch:
        return np.empty((0, 3), np.int64)
    rare = hits[np.argsort(count[hits], kind="stable")]
    taken = int(np.searchsorted(np.cumsum(count[rare]), 2 * (a.size + b.size) + 1024, side="right"))
    whole = taken == hits.size
    often, rare = rare[taken:], rare[:taken]
    each = count[rare]
    j = np.repeat(rare, each)
    i = order[np.repeat(left[rare], each) + np.arange(j.size) - np.repeat(np.cumsum(each) - each, each)]
    sort = np.lexsort((j, i - j))
    i, j = i[sort], j[sort]
    new = np.flatnonzero(np.append(True, (np.diff(i - j) != 0) | (np.diff(j) != 1)))
    runs = np.column_stack((i[new], j[new], np.diff(np.append(new, i.size))))
    if not whole:
        found, last = [], None
        for x, y, _ in runs.tolist():
            if last is None or x - y != last[0] - last[1] or y >= last[1] + last[2]:
                last = _maximal(a, b, x, y)
                found.append(last)
        to = 0
        often.sort()
        while (k := np.searchsorted(often, to)) < often.size:
            y = int(often[k])
            found.append(_maximal(a, b, int(order[left[y]]), y))
            to = found[-1][1] + found[-1][2]
        own, other = _stretch_hashes(a, rule.stretch), _stretch_hashes(b, rule.stretch)
        values, first = np.unique(own, return_index=True)
        at = np.minimum(np.searchsorted(values, other), max(values.size - 1, 0))
        here = np.flatnonzero(values[at] == other) if values.size else np.empty(0, np.int64)
        to = 0
        while (k := np.searchsorted(here, to)) < here.size:
            y = int(here[k])
            last = _maximal(a, b, int(first[at[y]]), y)
            found.append(last)
            to = max(y + 1, last[1] + last[2] - rule.stretch + 1)
        runs = np.unique(np.array(found, dtype=np.int64), axis=0)
    return runs[np.lexsort((runs[:, 0], runs[:, 1]))]


def matches(a: np.ndarray, b: np.ndarray, rule: Rule) -> list[tuple[int, int, int, int]]:
    """Repeated stretches of two shingle sequences: first and end place in ``a``, then in ``b``.

    Runs of equal shingles are put together in order, each with the one before
    that gives the most in both, while what is in both stays ``over`` per cent of
    what is in either.  A run on another diagonal, such as an earlier place of a
    common line, takes nothing from the others.  Stretches of ``b`` inside another
    one are left out.
    """
    if not a.size or not b.size:
        return []
    if np.array_equal(a, b):
        return [(0, a.size, 0, b.size)] if a.size >= rule.stretch else []
    runs = _runs(a, b, rule)
    n = len(runs)
    i_end, j_end = runs[:, 0] + runs[:, 2], runs[:, 1] + runs[:, 2]
    reach = np.maximum.accumulate(j_end) if n else j_end
    first_i, first_j, both = runs[:, 0].copy(), runs[:, 1].copy(), runs[:, 2].copy()
    most = 0
    for r, (i, j, size) in enumerate(runs.tolist()):
        # what lies between is at most this part of what is in both
        low = int(np.searchsorted(reach[:r], j - (most + size) * (100 / max(rule.over, 1) - 1)))
        if low < r:
            before = slice(low, r)
            added = size - np.maximum(np.maximum(i_end[before] - i, j_end[before] - j), 0)
            total = both[before] + added
            fits = (added > 0) & (100 * total >= rule.over * ((i + size - first_i[before]) + (j + size - first_j[before]) - total))
            k = int(np.where(fits, total, -1).argmax())
            if fits[k] and total[k] > size:
                first_i[r], first_j[r], both[r] = first_i[low + k], first_j[low + k], total[k]
        most = max(most, int(both[r]))
    long = np.flatnonzero(np.minimum(i_end - first_i, j_end - first_j) >= rule.stretch)
    out, to = [], -1
    for r in long[np.lexsort((-j_end[long], first_j[long]))].tolist():
        if j_end[r] > to:
            to = int(j_end[r])
            out.append((int(first_i[r]), int(i_end[r]), int(first_j[r]), to))
    return out


_SPAN = ["a", "b", "hash_b", "begin", "end", "words", "begin_a", "end_a"]
_SPAN_TYPE = "a bigint, b bigint, hash_b bigint, begin bigint, end bigint, words bigint, begin_a bigint, end_a bigint"


@dataclass
class _Side:
    """Shingles of some texts, and the characters before each byte."""

    words: textarrays.Words
    hash: np.ndarray
    first: np.ndarray
    chars: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array, rule: Rule) -> _Side:
        w = textarrays.words(texts)
        h, first, _ = textarrays.shingles(w.hash, w.first, rule.words)
        return cls(w, h, first, np.concatenate(([0], np.cumsum((w.raw & 0xC0) != 0x80))))

    def shingles(self, i: int, rule: Rule) -> np.ndarray:
        """Of text ``i``; none when it has fewer words than a shingle."""
        enough = self.words.first[i + 1] - self.words.first[i] >= rule.words
        return self.hash[self.first[i]: self.first[i + 1]] if enough else self.hash[:0]

    def span(self, i: int, begin: int, end: int, rule: Rule) -> tuple[int, int]:
        """First character and end of a stretch of shingles."""
        w, at = self.words, self.words.first[i]
        base = self.chars[w.text_start[i]]
        return self.chars[w.start[at + begin]] - base, self.chars[w.end[at + end + rule.words - 2]] - base


def _verified(rule: Rule):
    """Passages of pairs of texts; rows of one first text stand together.

    A first text is hashed once for all of a batch's, and equal partners of it are
    compared once: their passages are remembered by the hash of the text while the
    first text stays the same.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[tuple]] = {}
        last = None
        for batch in batches:
            ids, hashes = batch["a"].to_numpy(), batch["hash_b"].to_numpy()
            ends = np.append(np.flatnonzero(ids[1:] != ids[:-1]) + 1, ids.size) if ids.size else []
            begin = 0
            for end in ends:
                if ids[begin] != last:
                    known, last = {}, ids[begin]
                group = batch.slice(begin, end - begin)
                distinct, first = np.unique(hashes[begin:end], return_index=True)
                fresh = group.take(pa.array(first[[h not in known for h in distinct.tolist()]]))
                lead = _Side.of(group["text_a"].slice(0, 1), rule) if fresh.num_rows else None
                for at, to in textarrays.slices(fresh["text_b"]):
                    others = _Side.of(fresh["text_b"].slice(at, to - at), rule)
                    for i, name in enumerate(fresh["hash_b"].slice(at, to - at).to_pylist()):
                        found = matches(lead.shingles(0, rule), others.shingles(i, rule), rule)
                        known[name] = [(*others.span(i, b0, b1, rule), b1 - b0 + rule.words - 1, *lead.span(0, a0, a1, rule)) for a0, a1, b0, b1 in found]
                rows = [(i, *span) for i, name in enumerate(hashes[begin:end].tolist()) for span in known[name]]
                for at in range(0, len(rows), 1 << 16):
                    columns = [pa.array(np.array(c, dtype=np.int64)) for c in zip(*rows[at: at + (1 << 16)])]
                    of = columns[0]
                    yield pa.RecordBatch.from_arrays([group["a"].take(of), group["b"].take(of), group["hash_b"].take(of), *columns[1:]], names=_SPAN)
                begin = end

    return run


PARTNERS = 256  # about so many pairs of one first text are verified by one task


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Both texts beside each pair, the pairs of a first text in portions that may go to different tasks.

    Merge joins at every size: rows of one first text come out beside each other,
    and no text is sent to all tasks.
    """
    portions = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("portions"))
    leads = texts.hint("merge").join(portions, F.col("id") == F.col("a")).select(
        "a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("portions") - 1)).alias("portion"), F.col("text").alias("text_a"))
    others = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"), F.xxhash64("text").alias("hash_b"))
    portion = F.pmod(F.col("hash_b"), F.col("portions")).alias("portion")  # equal partners stay together
    dealt = pairs.join(portions, "a").join(others.hint("merge"), "b").select("a", "b", "hash_b", "text_b", portion)
    return dealt.join(leads.hint("merge"), ["a", "portion"]).select("a", "b", "hash_b", "text_a", "text_b")


def repeated(documents: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of a document that an earlier one (smaller id) has too: a written table.

    Columns doc_id, text_hash (xxhash64 of the text, for repeated ids), begin and
    end (characters), words, first_doc_id, first_begin, first_end.  A passage has at
    least ``shortest`` words; ``over`` per cent of the shingles of both are in
    both.  Equal passages share every signature; similar ones share enough with a
    probability that grows with likeness, functions and length.  Texts are paired
    with the first text under a signature, and where three or more share it with the
    first that has each whole stretch, so a passage that a third of all texts share
    makes about as many pairs as texts.  Null and short
    texts have no passages.  Rows without an id go by a hash of their text; rows
    that repeat an id are not compared with each other.
    """
    text = F.col(text_col).cast("string")
    rows = documents.where(text.isNotNull()).select(F.coalesce(F.col(id_col).cast("bigint"), F.xxhash64(text)).alias("id"), text.alias("text"))
    def dealt(packed: DataFrame, open_too: bool) -> DataFrame:
        return packed.repartition("key").sortWithinPartitions("key").mapInArrow(_gathered(open_too), _PAIR_TYPE)

    stars = written(dealt(rows.mapInArrow(_spread(rule), _PACKED_TYPE), True), "stars")
    opened = written(stars.where("b is null").groupBy(F.col("a").alias("id")).agg(F.collect_set("key").alias("keys")), "open")
    again = IdFilter(opened.select("id")).passing(rows, "id").join(opened, "id").select("id", "text", "keys")
    both = stars.where("b is not null").union(dealt(again.mapInArrow(_stretches(rule), _PACKED_TYPE), False))
    pairs = written(both.groupBy("a", "b").agg(F.bit_or("mask").alias("mask")).where(F.bit_count("mask") >= rule.enough).select("a", "b"), "pairs")
    named = IdFilter(pairs.select(F.col("a").alias("id")).union(pairs.select("b")))
    texts = named.passing(rows, "id")
    both = _with_texts(pairs, texts)
    spans = both.mapInArrow(_verified(rule), _SPAN_TYPE)
    return written(spans.select(F.col("b").alias("doc_id"), F.col("hash_b").alias("text_hash"), "begin", "end", "words",
                                F.col("a").alias("first_doc_id"), F.col("begin_a").alias("first_begin"), F.col("end_a").alias("first_end")), "spans")


def merged(spans: DataFrame) -> DataFrame:
    """Overlapping passages of a text as one: doc_id, text_hash, begin, end, words of the longest, smallest first_doc_id.

    A text's passages are as many as its words allow, so its window is bounded by
    the text, not by how many others share it: equal ones are put together first.
    """
    each = (spans.groupBy("doc_id", "text_hash", "begin", "end").agg(F.max("words").alias("words"), F.min("first_doc_id").alias("first_doc_id")))
    of = Window.partitionBy("doc_id", "text_hash").orderBy("begin", "end")
    before = F.max("end").over(of.rowsBetween(Window.unboundedPreceding, -1))
    group = F.sum(F.when(F.col("begin") <= F.col("_before"), 0).otherwise(1)).over(of)
    return (each.withColumn("_before", before).withColumn("_group", group).groupBy("doc_id", "text_hash", "_group")
            .agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.max("words").alias("words"), F.min("first_doc_id").alias("first_doc_id"))
            .drop("_group"))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the listed stretches of characters (ascending, apart)."""
    for batch in batches:
        out = []
        for text, cuts in zip(batch["text"].to_pylist(), batch["cuts"].to_pylist()):
            parts, at = [], 0
            for cut in cuts:
                parts.append(text[at: cut["begin"]])
                at = cut["end"]
            out.append("".join([*parts, text[at:]]))
        yield pa.RecordBatch.from_arrays([batch["row"], pa.array(out, pa.string())], names=["row", "text"])


def removed(documents: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """Documents without the passages in ``spans`` (of ``repeated``); the same columns, the length counted anew.

    Each passage stays where it comes first.  Texts without a passage are left as
    they are and are not shuffled.
    """
    columns = documents.columns
    text = F.col(text_col).cast("string")
    rows = documents.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("bigint"), F.xxhash64(text)).alias("doc_id"), text.alias("text"))
    cuts = written(merged(spans).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("cuts")), "cuts")
    named = IdFilter(cuts.select(F.col("doc_id").alias("id")))
    hit = named.passing(rows, "doc_id").withColumn("text_hash", F.xxhash64("text"))
    joined = hit.join(cuts, ["doc_id", "text_hash"], "left").select("row", F.coalesce("text", F.lit("")).alias("text"), "cuts")
    whole = named.failing(rows, "doc_id").select("row").union(joined.where("cuts is null").select("row"))
    cut = joined.where("cuts is not null").mapInArrow(_without, joined.select("row", "text").schema)
    renewed = [F.col("text").alias(c) if c == text_col else F.length("text").cast(documents.schema[c].dataType).alias(c) if c == length_col
               else F.col("row").getField(c).alias(c) for c in columns]
    return whole.select("row.*").union(cut.select(*renewed))
