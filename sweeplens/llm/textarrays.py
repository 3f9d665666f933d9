"""Words and shingles of many texts at once, as numpy arrays of 64-bit hashes.

A word is a run of ``[^\\x20\\x09-\\x0D]`` after lower-casing A-Z.  Words are
hashed without building Python strings: one running polynomial over the bytes
of a slice of texts gives every word's hash as a difference of two sums.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE_BYTES = 1 << 19  # texts are hashed in slices of about this size; a longer text is a slice of its own
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD1B54A32D192ED03
_CACHE: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if _CACHE.get("up", np.empty(0)).size < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _CACHE[name] = np.cumprod(steps, dtype=np.uint64)
    return _CACHE["up"], _CACHE["down"]


def _kinds() -> np.ndarray:
    """Per byte: 0 for white space, 1 for letters, digits and all beyond ASCII, 2 for other ASCII."""
    kind = np.full(256, 2, dtype=np.uint8)
    kind[[9, 10, 11, 12, 13, 32]] = 0
    for low, high in ((48, 57), (65, 90), (97, 122), (128, 255)):
        kind[low: high + 1] = 1
    return kind


_KINDS = _kinds()


@dataclass
class Words:
    """Words of a slice of texts, in order; offsets count bytes of the slice."""

    raw: np.ndarray  # lower-cased bytes
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray  # place of the text in the slice
    first: np.ndarray  # per text: index of its first word; one more entry than texts
    running: np.ndarray  # running sums, for hashes of parts of words
    text_start: np.ndarray  # per text: its first byte; one more entry than texts

    def prefix_end(self, chars: int) -> np.ndarray:
        """Where each word's first ``chars`` characters end."""
        begins = np.flatnonzero((self.raw & 0xC0) != 0x80)
        at = np.searchsorted(begins, self.start) + chars
        return np.minimum(np.append(begins, self.raw.size)[np.minimum(at, begins.size)], self.end)

    def part_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return part_hash(self.running, start, end)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another (nulls are empty), and where each begins (one entry more than texts)."""
    column = pa.compute.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset: column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[bounds[0]: bounds[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, bounds - bounds[0]


def running_hash(raw: np.ndarray) -> np.ndarray:
    """Running sums from which ``part_hash`` takes the hash of any part; one entry more than bytes."""
    up, _ = _powers(raw.size + 1)
    running = np.zeros(raw.size + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: raw.size], out=running[1:])
    return running


def part_hash(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from ``start`` to ``end``, equal for equal bytes wherever they stand."""
    _, down = _powers(running.size)
    return mix((running[end] - running[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(_STEP))


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Cut a string column into ranges of rows with at most ``most`` bytes, one row at least."""
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, to
        at = to
    pa.default_memory_pool().release_unused()  # a worker that waits for its next task keeps little


def words(column: pa.Array, split_punctuation: bool = False) -> Words:
    """Words of the texts of a string column; a null text has none.

    With ``split_punctuation`` runs of ASCII punctuation are words of their own.
    """
    raw, bounds = text_bytes(column)
    n = raw.size
    raw = raw + (((raw >= 65) & (raw <= 90)).view(np.uint8) << 5)
    kind = _KINDS[raw] if split_punctuation else (_KINDS[raw] > 0).view(np.uint8)
    edge = np.zeros(n + 1, dtype=bool)  # a text begins here
    edge[bounds] = True
    change = np.ones(n + 1, dtype=bool)
    change[1:n] = kind[1:] != kind[:-1]
    change |= edge
    inside = kind > 0
    start = np.flatnonzero(inside & change[:-1])
    end = np.flatnonzero(inside & change[1:]) + 1
    running = running_hash(raw)
    first = np.searchsorted(start, bounds).astype(np.int64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    out = Words(raw, start, end, np.empty(0, np.uint64), doc, first, running, bounds)
    out.hash = out.part_hash(start, end)
    return out


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of runs of ``k`` words, their texts' first shingles, and their first words.

    ``first`` has one entry more than texts.  A text of 1 to ``k - 1`` words has
    one shingle, the whole sequence; a text without words has none.
    """
    n, counts = hashes.size, np.diff(first)
    size = np.maximum(counts - k + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < k))
    size[short] = 1
    out_first = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(out_first[-1]) - np.repeat(out_first[:-1] - first[:-1], size)
    run = np.zeros(at.size, dtype=np.uint64)
    factor = np.uint64(1)
    padded = np.concatenate((hashes, np.zeros(k, dtype=np.uint64)))
    with np.errstate(over="ignore"):
        for j in range(k):
            run += padded[at + j] * factor
            factor *= np.uint64(_STEP)
        for d in short:
            value = np.uint64(counts[d])
            for h in hashes[first[d]: first[d + 1]]:
                value = value * np.uint64(_BASE) + h
            run[out_first[d]] = value
    return mix(run), out_first, at
