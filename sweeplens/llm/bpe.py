"""Byte-level BPE: whole pre-tokens through a minimal perfect hash, the others by a heap over linked bytes.

Texts are split by the tokenizer's pattern and every match is encoded on its
own.  Equal matches of a slice of texts are encoded once.  The first tier asks
a minimal perfect hash over the vocabulary for all distinct matches at once:
each level of the hash is a table in which keys that stand alone have a slot,
the others go to the next level, so n keys fill n slots.  A slot's bytes are
compared, hence a hit is exact.  The second tier merges the bytes of a miss:
parts are a linked list, a heap gives the pair of lowest rank, leftmost first.

Null texts are empty and have no ids; repeated rows are encoded like any other;
a very long text is split at white space that follows another character, where
no match can cross, and its parts share the bounded working memory.  Columns
named in ``keep`` pass through; a clash with an output column is refused.
"""

from __future__ import annotations

import base64
import heapq
import re
import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from sweeplens.llm import textarrays
from sweeplens.llm.shared import bounded_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE = 1 << 20  # characters split and encoded together
REMEMBERED = 200_000  # encoded misses in each of the two generations a task keeps
_LEVEL = 0xA24BAED4963EE407
_PLACE = (1 << 40) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank of each token's bytes, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def taken(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches ``values[start: start + length]`` one after another."""
    shift = start - (np.cumsum(length) - length)
    return values[np.repeat(shift, length) + np.arange(int(length.sum()))]


class PerfectHash:
    """Slots 0 to n - 1 for n distinct 64-bit keys; any other key gets some slot or -1."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[np.ndarray] = []
        used = 0
        while keys.size:
            size = keys.size + keys.size // 2 + 1
            at = self._place(keys, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            slots = np.where(alone, used + np.cumsum(alone) - 1, -1).astype(np.int32)
            self.levels.append(slots)
            used += int(alone.sum())
            keys = keys[~alone[at]]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        scattered = textarrays.mix(keys + np.uint64((level + 1) * _LEVEL & (2**64 - 1)))
        return (scattered % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(keys.size, -1, dtype=np.int64)
        left = np.arange(keys.size)
        for level, table in enumerate(self.levels):
            found = table[self._place(keys[left], level, table.size)]
            out[left] = found
            left = left[found < 0]
        return out


class Vocabulary:
    """The tokens of a rank file: perfect hash, bytes by slot and by id."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte needs a rank")
        tokens = sorted(ranks, key=ranks.get)
        self.ids = np.array([ranks[t] for t in tokens], dtype=np.int64)
        self.raw = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        keys = textarrays.part_hash(textarrays.running_hash(self.raw), self.start, self.start + self.length)
        if np.unique(keys).size != keys.size:
            raise ValueError("two tokens have one 64-bit hash")
        self.hash = PerfectHash(keys)
        self.token_at = np.empty(keys.size, dtype=np.int64)  # by slot
        self.token_at[self.hash.slots(keys)] = np.arange(keys.size)
        self.place = np.full(int(self.ids.max()) + 1, -1, dtype=np.int64)  # by id
        self.place[self.ids] = np.arange(self.ids.size)

    def ranks(self) -> dict[bytes, int]:
        raw = self.raw.tobytes()
        return {raw[s: s + n]: i for s, n, i in zip(self.start.tolist(), self.length.tolist(), self.ids.tolist())}

    def find(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Ids of the byte strings between ``bounds``, -1 for those that are no token."""
        start, length = bounds[:-1], np.diff(bounds)
        slot = self.hash.slots(textarrays.part_hash(textarrays.running_hash(raw), start, bounds[1:]))
        token = self.token_at[np.maximum(slot, 0)]
        same = np.flatnonzero((slot >= 0) & (self.length[token] == length) & (length > 0))
        sizes = length[same]
        equal = taken(raw, start[same], sizes) == taken(self.raw, self.start[token[same]], sizes)
        out = np.full(length.size, -1, dtype=np.int64)
        if same.size:
            whole = np.logical_and.reduceat(equal, np.cumsum(sizes) - sizes)
            out[same[whole]] = self.ids[token[same[whole]]]
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of ids one after another; an id outside the vocabulary is an error."""
        if ids.size and (ids.min() < 0 or ids.max() >= self.place.size or (self.place[ids] < 0).any()):
            raise ValueError("an id is not in the vocabulary")
        at = self.place[ids]
        return taken(self.raw, self.start[at], self.length[at])


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of lowest rank is joined, leftmost first, until none has a rank.

    ``end[i]`` is where the part that begins at byte i ends, ``before[i]`` where
    the part before it begins.  An entry of the heap counts while its rank is
    still that of the pair at its place.
    """
    n, rank_of, push = len(piece), ranks.get, heapq.heappush
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pair = [rank_of(piece[i: i + 2], -1) for i in range(n - 1)]
    pair.append(-1)
    heap = [rank << 40 | i for i, rank in enumerate(pair) if rank >= 0]
    heapq.heapify(heap)
    while heap:
        entry = heapq.heappop(heap)
        i = entry & _PLACE
        if pair[i] != entry >> 40:
            continue
        j = end[i]
        k = end[i] = end[j]
        pair[j] = rank = -1
        if k < n:
            before[k] = i
            rank = rank_of(piece[i: end[k]], -1)
            if rank >= 0:
                push(heap, rank << 40 | i)
        pair[i] = rank
        b = before[i]
        if b >= 0:
            pair[b] = rank = rank_of(piece[b: k], -1)
            if rank >= 0:
                push(heap, rank << 40 | b)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i: end[i]]])
        i = end[i]
    return out


def exact_patterns(pattern: str) -> tuple[str, str, str]:
    """``pattern`` for this library, one without letters and numbers that tiktoken does not know, and the texts that need it.

    The two libraries may follow different versions of Unicode.  Characters that
    only this one takes for letters or numbers are taken out of the classes; the
    plain pattern is right for texts without a character of the third pattern.
    """
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    narrow, odd = "(?V1)" + pattern, set()
    for kind in (r"\p{L}", r"\p{N}"):
        known = bytes(tiktoken.Encoding("one", pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary(every))
        extra = sorted(set(regex.findall(kind, every)) - set(known.decode("utf-8")))
        odd.update(extra)
        if extra:
            narrow = narrow.replace(kind, f"[{kind}--[{''.join(map(re.escape, extra))}]]")
    first = min(odd, default="\U0010ffff")
    return pattern, narrow, f"[{first}-\U0010ffff]"


class Encoder:
    """What a task needs: patterns, vocabulary, and the misses encoded so far in two generations."""

    def __init__(self, vocabulary: Vocabulary, patterns: tuple[str, str, str]):
        self.vocabulary = vocabulary
        self.plain, self.narrow, self.odd = regex.compile(patterns[0]), regex.compile(patterns[1]), re.compile(patterns[2])
        self.ranks = vocabulary.ranks()
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def split(self, text: str) -> list[str]:
        return (self.narrow if self.odd.search(text) else self.plain).findall(text)

    def miss(self, piece: str) -> tuple[int, ...]:
        ids = self.young.get(piece)
        if ids is None:
            ids = self.old.get(piece) or tuple(merged(piece.encode("utf-8"), self.ranks))
            if len(piece) > 64:
                return ids
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[piece] = ids
        return ids

    def encode(self, pieces: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in order, and how many belong to each run of ``counts`` pieces."""
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        distinct = coded.dictionary
        raw, bounds = textarrays.text_bytes(distinct)
        ids = self.vocabulary.find(raw, bounds)
        size = np.ones(ids.size, dtype=np.int64)
        missing = np.flatnonzero(ids < 0)
        lists = [self.miss(piece) for piece in distinct.take(pa.array(missing)).to_pylist()]
        size[missing] = [len(x) for x in lists]
        start = np.cumsum(size) - size
        flat = np.repeat(ids, size)
        into = taken(np.arange(flat.size), start[missing], size[missing])
        flat[into] = np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=into.size)
        codes = coded.indices.to_numpy()
        ends = np.concatenate(([0], np.cumsum(size[codes])))
        return taken(flat, start[codes], size[codes]), np.diff(ends[np.concatenate(([0], np.cumsum(counts)))])


def parts(text: str, size: int = SLICE) -> Iterator[str]:
    """Cut a text where white space follows another character: no match of the pattern goes over that."""
    cut = re.compile(r"(?<=[^\s\x1c-\x1f\x85])[ \n\t]")
    at = 0
    while len(text) - at > size:
        found = cut.search(text, at + size)
        if not found:
            break
        yield text[at: found.start()]
        at = found.start()
    yield text[at:]


def _encoded_parts(texts: list[str | None], encoder: Encoder) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids) of every part of every text, in order; texts are encoded some at a time."""
    pieces: list[str] = []
    rows: list[int] = []
    counts: list[int] = []
    held = 0

    def flush() -> Iterator[tuple[int, np.ndarray]]:
        ids, sizes = encoder.encode(pieces, np.array(counts, dtype=np.int64))
        yield from zip(rows, np.split(ids, np.cumsum(sizes)[:-1]))

    for row, text in enumerate(texts):
        for part in parts(text or ""):
            found = encoder.split(part)
            pieces += found
            rows.append(row)
            counts.append(len(found))
            held += len(part)
            if held >= SLICE:
                yield from flush()
                pieces, rows, counts, held = [], [], [], 0
    if rows:
        yield from flush()


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", keep: list[str] | None = None,
           with_bytes: bool = False) -> DataFrame:
    """Columns ``keep`` (default: doc_id) and ``ids`` (array of int); ``decoded`` (binary) from the ids if asked for.

    One row per row of ``docs``, whatever repeats; an empty or null text has no
    ids.  Nothing is shuffled; the vocabulary is the only thing broadcast.
    """
    keep = ["doc_id"] if keep is None else keep
    if {"ids", "decoded"} & {c.lower() for c in keep}:
        raise ValueError("columns ids and decoded are made here")
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((Vocabulary(ranks), exact_patterns(pattern)))
    n = len(keep)
    chosen = docs.select(*[docs[c] for c in keep], docs[text_col].cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for batch in batches:
            for begin, end in textarrays.slices(batch.column(n), 1 << 21):
                rows = batch.slice(begin, end - begin)
                found: list[list[np.ndarray]] = [[] for _ in range(rows.num_rows)]
                for row, ids in _encoded_parts(rows.column(n).to_pylist(), encoder):
                    found[row].append(ids)
                size = np.array([sum(x.size for x in f) for f in found], dtype=np.int64)
                flat = np.concatenate([x for f in found for x in f])
                columns = [*rows.columns[:n], _lists(flat, size)]
                if with_bytes:
                    columns.append(_bytes(encoder.vocabulary, flat, size))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [*keep, "ids", *(["decoded"] if with_bytes else [])]
    schema = chosen.select(*chosen.columns[:n]).schema.add("ids", ArrayType(IntegerType()))
    return chosen.mapInArrow(run, schema.add("decoded", BinaryType()) if with_bytes else schema)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: doc_id) and ``decoded``, the bytes of each row's ids; null ids give null."""
    keep = ["doc_id"] if keep is None else keep
    spark = encoded.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(Vocabulary(ranks))
    n = len(keep)
    chosen = encoded.select(*[encoded[c] for c in keep], encoded[ids_col].cast("array<bigint>").alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(n)
            size = pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            found = _bytes(shared.value, flat, size)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.compute.if_else(ids.is_valid(), found, None)], names=[*keep, "decoded"])

    return chosen.mapInArrow(run, chosen.select(*chosen.columns[:n]).schema.add("decoded", BinaryType()))


def _lists(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(flat.astype(np.int32)))


def _bytes(vocabulary: Vocabulary, flat: np.ndarray, size: np.ndarray) -> pa.Array:
    raw = vocabulary.decode(flat)
    length = np.concatenate(([0], np.cumsum(vocabulary.length[vocabulary.place[flat]])))
    ends = length[np.concatenate(([0], np.cumsum(size)))].astype(np.int64)
    buffers = [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())]
    return pa.Array.from_buffers(pa.large_binary(), size.size, buffers).cast(pa.binary())
