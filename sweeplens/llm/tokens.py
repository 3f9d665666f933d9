"""Token ids of many texts, exactly as the tokenizers library gives them, with each piece encoded once.

Both supported kinds of tokenizer encode parts of a text on their own.  Texts
are cut where such a part ends for certain: at white space, and between a
letter A-Z and ASCII punctuation.  Equal pieces (found by a 64-bit hash) are
encoded once, and their ids are put together with numpy.  ``gpt`` pieces keep
the white space before them; ``clip`` pieces drop it and have letters A-Z
lower-cased, as that tokenizer does anyway.
"""

from __future__ import annotations

import json
import os
import sys
import types
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from sweeplens.llm import textarrays

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CACHED = 400_000  # pieces that a task remembers; those used most stay when there are more
JOINED = 1000  # pieces that are handed to the tokenizer as one text
SLICE = 1 << 20  # bytes of texts encoded together

KINDS = {"ByteLevel": "gpt", "Sequence": "clip"}  # by the pre-tokenizer of the file


def tokenizer_json(path: str) -> str:
    """The tokenizer file's text, to be broadcast: executors need no copy of the file."""
    return Path(path).read_text(encoding="utf-8")


def encoder(json_text: str) -> Encoder:
    """The encoder of this worker process; a task that is done with it calls ``rest``."""
    # a module of its own, as functions sent by value get new globals for each task
    store = sys.modules.setdefault("_sweeplens_encoders", types.ModuleType("_sweeplens_encoders"))
    key = f"k{hash(json_text)}"
    if not hasattr(store, key):
        setattr(store, key, Encoder(json_text))
    return getattr(store, key)


class Places:
    """The place of each known hash, by two sorted arrays: a dict of Python numbers would take seven times as much."""

    def __init__(self):
        self.key, self.at = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)

    def __len__(self) -> int:
        return self.key.size

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes, -1 for unknown ones."""
        near = np.searchsorted(self.key, hashes)
        known = near < self.key.size
        known[known] = self.key[near[known]] == hashes[known]
        out = np.full(hashes.size, -1, dtype=np.int64)
        out[known] = self.at[near[known]]
        return out

    def add(self, hashes: np.ndarray, places: np.ndarray) -> None:
        """Hashes that are not known yet."""
        order = np.argsort(hashes)
        hashes, places = hashes[order], places[order]
        into = np.searchsorted(self.key, hashes)
        self.key, self.at = np.insert(self.key, into, hashes), np.insert(self.at, into, places)

    def hashes(self) -> np.ndarray:
        """The hash at each place."""
        out = np.empty(self.key.size, dtype=np.uint64)
        out[self.at] = self.key
        return out


class Encoder:
    def __init__(self, json_text: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json_text)
        settings = json.loads(json_text)
        self.kind = KINDS[settings["pre_tokenizer"]["type"]]
        self.joint = "\n" if self.kind == "gpt" else " "
        self.letters = np.zeros(256, dtype=bool)
        self.letters[97:123] = True
        self.letters[65:91] = self.kind == "gpt"
        if self.kind == "gpt":
            self.line_end = self._run(["\n"])[0][0]
        else:
            vocabulary = settings["model"]["vocab"]
            self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.ends_word[[i for t, i in vocabulary.items() if t.endswith(settings["model"]["end_of_word_suffix"])]] = True
        self._forget()

    def _forget(self) -> None:
        self.place = Places()
        self.start, self.length, self.uses = (np.zeros(1024, dtype=np.int64) for _ in range(3))
        self.pool = np.zeros(4096, dtype=np.uint32)
        self.used = self.fill = 0

    def rest(self) -> None:
        """Forget all pieces, so that a worker which waits holds the tokenizer alone."""
        self._forget()

    def _trim(self) -> None:
        """Keep the pieces that were used again, half of the places at most, those used most."""
        kept = np.flatnonzero(self.uses[: self.used] > 1)
        kept = kept[np.argsort(-self.uses[kept], kind="stable")[: CACHED // 2]]
        kept = kept[np.cumsum(self.length[kept]) <= 8 * CACHED]
        sizes = self.length[kept]
        ends = np.cumsum(sizes)
        ids = self.pool[np.repeat(self.start[kept] - ends + sizes, sizes) + np.arange(int(sizes.sum()))]
        key, uses = self.place.hashes()[kept], self.uses[kept] // 2
        self._forget()
        self._room(kept.size, ids.size)
        self.start[: kept.size], self.length[: kept.size], self.uses[: kept.size] = ends - sizes, sizes, uses
        self.pool[: ids.size] = ids
        self.place.add(key, np.arange(kept.size))
        self.used, self.fill = kept.size, ids.size

    def _room(self, pieces: int, ids: int) -> None:
        while self.used + pieces > self.start.size:
            self.start, self.length, self.uses = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.length, self.uses))
        while self.fill + ids > self.pool.size:
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))

    def _joined(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> str:
        """ASCII pieces with the joint between them, put together without a string for each."""
        size = end - start + 1
        ends = np.cumsum(size)
        out = np.append(raw, np.uint8(0))[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]))]
        out[ends - 1] = ord(self.joint)
        return out[:-1].tobytes().decode("ascii")

    def _encode(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the pieces, all their ids in that order, and how many each has.

        Plain pieces are encoded many at a time, put together so that their ids
        can be told apart; those of ASCII letters go there without being strings.
        """
        letters = np.concatenate(([0], np.cumsum(self.letters[raw])))
        lead = int(self.kind == "gpt")  # a blank before the letters
        simple = letters[end] - letters[start + lead] == end - start - lead
        if lead:
            simple &= (raw[start] == 32) & (end - start > 1)
        text = raw.tobytes()
        other = np.flatnonzero(~simple)
        pieces = [text[s:e].decode() for s, e in zip(start[other].tolist(), end[other].tolist())]
        able = np.array([self._plain(p) for p in pieces], dtype=bool)
        ids, sizes = [], []

        def joint(joined: str, n: int) -> None:
            found = np.array(self._run([joined])[0], dtype=np.uint32)
            if self.kind == "gpt":  # a line end between pieces is one id
                between = found == self.line_end
                size = np.diff(np.concatenate(([-1], np.flatnonzero(between), [found.size]))) - 1
                found = found[~between]
            else:  # a word's last id ends it
                size = np.diff(np.append(-1, np.flatnonzero(self.ends_word[found])))
            if len(size) != n:
                raise ValueError("pieces and ids do not match")
            ids.append(found)
            sizes.append(size)

        first = np.flatnonzero(simple)
        for at in range(0, first.size, JOINED):
            some = first[at: at + JOINED]
            joint(self._joined(raw, start[some], end[some]), some.size)
        words = [p for p, a in zip(pieces, able) if a]
        for at in range(0, len(words), JOINED):
            joint(self.joint.join(words[at: at + JOINED]), len(words[at: at + JOINED]))
        lists = self._run([p for p, a in zip(pieces, able) if not a])
        sizes.append(np.fromiter(map(len, lists), np.int64, len(lists)))
        ids.append(np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes[-1].sum())))
        return np.concatenate((first, other[able], other[~able])), np.concatenate(ids), np.concatenate(sizes)

    def _run(self, texts: list[str]) -> list[list[int]]:
        run = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in run(texts, add_special_tokens=False)] if texts else []

    def _plain(self, piece: str) -> bool:
        """The piece is tokenised the same between others of its kind: a blank and letters (gpt), or one small word (clip)."""
        if self.kind == "gpt":
            return piece[0] == " " and piece[1:].isalpha()
        return piece.isalpha() and piece.islower()

    def _places(self, hashes: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places of pieces in the pool; ``start`` and ``end`` are where each stands in ``raw``."""
        if self.used and (self.used + len(hashes) > CACHED or self.fill > 16 * CACHED):
            self._trim()
        found = self.place.find(hashes)
        new = np.flatnonzero(found < 0)
        if new.size:
            order, ids, sizes = self._encode(raw, start[new], end[new])
            self._room(len(new), len(ids))
            at = slice(self.used, self.used + len(new))
            self.length[at] = sizes
            self.start[at] = self.fill + np.cumsum(sizes) - sizes
            self.pool[self.fill: self.fill + len(ids)] = ids
            found[new[order]] = np.arange(self.used, self.used + len(new))
            self.uses[at] = 0
            self.place.add(hashes[new[order]], found[new[order]])
            self.used += len(new)
            self.fill += len(ids)
        self.uses[found] += 1  # the hashes are distinct
        return found

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the first id of each text (one entry more than texts).

        Nulls are empty texts.
        """
        raw, bounds = textarrays.text_bytes(column)
        if self.kind == "clip":
            # an upper-case letter with a mark after it is left to the tokenizer, whose normal form comes first
            upper = (raw >= 65) & (raw <= 90)
            upper[:-1] &= raw[1:] < 128
            raw = raw + (upper.view(np.uint8) << 5)
        start, end = self._pieces(raw, bounds)
        coded = pa.array(textarrays.part_hash(textarrays.running_hash(raw), start, end)).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        example = np.empty(len(coded.dictionary), dtype=np.int64)
        example[codes] = np.arange(len(codes))
        at = self._places(coded.dictionary.to_numpy(), raw, start[example], end[example])[codes]
        sizes, starts = self.length[at], self.start[at]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        where = np.repeat(starts - ends[:-1], sizes)
        where += np.arange(ends[-1])
        return self.pool[where], ends[np.searchsorted(start, bounds)]

    def _pieces(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last byte (exclusive) of each piece, in order."""
        n = raw.size
        kind = _KINDS[raw]
        for lead, rest in _WIDE_SPACES:
            at = np.flatnonzero(raw == lead)
            at = at[at + len(rest) < n]
            for j, (low, high) in enumerate(rest, 1):
                at = at[(raw[at + j] >= low) & (raw[at + j] <= high)]
            for j in range(len(rest) + 1):
                kind[at + j] = 0
        edge = np.zeros(n + 1, dtype=bool)
        edge[bounds] = True
        space = kind == 0
        cut = edge.copy()  # a piece begins or ends before this byte
        cut[1:n] |= space[1:] != space[:-1]
        cut[1:n] |= (kind[1:] + kind[:-1] == 3)  # letter and punctuation, in either order
        if self.kind == "clip":
            begins = np.flatnonzero(cut[:n] & ~space)
            ends = np.flatnonzero(cut[1:] & ~space) + 1
            return begins, ends
        begins = np.flatnonzero(cut[:n])
        ends = np.append(begins[1:], n)
        blank = space[begins]
        # white space goes with what follows it in the text, but a single line end or tab stands alone
        alone = (ends - begins == 1) & (raw[begins] != 32)
        follows = blank & ~alone
        follows[:-1] &= ~edge[begins[1:]]
        if follows.size:
            follows[-1] = False
        keep = np.ones(len(begins), dtype=bool)
        keep[1:] = ~follows[:-1]
        return begins[keep], np.append(begins[keep][1:], n)


def _kinds() -> np.ndarray:
    """Per byte: 0 for ASCII white space (other is found by its bytes), 1 for letters A-Z, 2 for punctuation that never joins letters, 5 for the rest.

    The apostrophe begins contractions, and ``<|>`` occur in special tokens.
    """
    kind = np.full(256, 5, dtype=np.uint8)
    kind[[9, 10, 11, 12, 13, 32]] = 0
    kind[65:91] = kind[97:123] = 1
    kind[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'<|>"]] = 2
    return kind


_KINDS = _kinds()
# white space beyond ASCII, in UTF-8: first byte, then ranges of the next ones
_WIDE_SPACES = [
    (0xC2, [(0x85, 0x85)]), (0xC2, [(0xA0, 0xA0)]), (0xE1, [(0x9A, 0x9A), (0x80, 0x80)]), (0xE2, [(0x80, 0x80), (0x80, 0x8A)]),
    (0xE2, [(0x80, 0x80), (0xA8, 0xA9)]), (0xE2, [(0x80, 0x80), (0xAF, 0xAF)]), (0xE2, [(0x81, 0x81), (0x9F, 0x9F)]), (0xE3, [(0x80, 0x80), (0x80, 0x80)]),
]
