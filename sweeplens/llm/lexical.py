"""Best documents for each of many queries, with what the queries have in common computed once.

A document's score for an item is the sum over the item's terms of an integer
weight times an integer share that depends on term and document alone.  The
items of a block are compiled into one sharing graph: terms that stand in the
same items form a class, items are written as sequences of classes with the
commonest first, and neighbours that several items share are folded into nodes
until none is left.  Over a batch of documents every class and node is one
accumulator that is computed once and freed after its last use; an item is the
sum of what is left of its sequence.

Documents are read once per block of items into postings (the block's terms
only), written in the documents' partitions; then each task keeps the best of
its documents for each item, and a window ranks those.  Nothing else is
shuffled, and no document is ever paired with an item as a row beyond that.

Null and empty texts have no terms: as documents they do not count, as items
they find nothing.  Each row of the items is an item of its own, each row of
the documents a document.  Ties go to the smaller id, null ids last.  Memory
per task is bounded by the block of items and the batch of documents; a very
long text is hashed alone.  Extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType

from sweeplens.llm import textarrays
from sweeplens.llm.shared import bounded_batches, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_BYTES = 16 << 20  # distinct terms of the items that are ranked together
CELLS = 4 << 20  # accumulator cells of a batch of documents
SCALE = 1_000_000_000
_LETTERS = np.zeros(256, dtype=bool)
for _low, _high in ((48, 57), (65, 90), (97, 122), (128, 255)):
    _LETTERS[_low: _high + 1] = True


def weight(documents: int, df: int) -> int:
    """A term's integer weight."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def terms(column: pa.Array) -> textarrays.Words:
    """Runs of ASCII letters, digits and all characters beyond ASCII; A-Z lower-cased."""
    found = textarrays.words(column, split_punctuation=True)
    keep = _LETTERS[found.raw[found.start]] if found.start.size else np.zeros(0, dtype=bool)
    kept = np.concatenate(([0], np.cumsum(keep)))
    found.first = kept[found.first]
    found.start, found.end, found.hash, found.doc = found.start[keep], found.end[keep], found.hash[keep], found.doc[keep]
    return found


@dataclass
class Sharing:
    """How the items of a block are put together.

    ``classes`` are lists of (term, count); ``nodes`` pairs of earlier parts; an
    entry of ``items`` is the parts whose sum is that item.  Parts are numbered
    classes first, then nodes.  ``uses`` says how often each part is read.
    """

    classes: list[list[tuple[int, int]]]
    nodes: list[tuple[int, int]]
    items: list[list[int]]
    uses: list[int]

    @classmethod
    def of(cls, items: list[dict[int, int]]) -> Sharing:
        """Mine the shared term sets of ``items`` (counts by term)."""
        where: dict[tuple[int, int], list[int]] = defaultdict(list)
        for number, counts in enumerate(items):
            for term, count in counts.items():
                where[term, count].append(number)
        groups: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for atom, numbers in where.items():
            groups[tuple(numbers)].append(atom)
        order = sorted(groups, key=lambda g: (-len(g), g))
        sequences: list[list[int]] = [[] for _ in items]
        for part, numbers in enumerate(order):
            for number in numbers:
                sequences[number].append(part)
        nodes = cls._fold(sequences, len(order))
        uses = Counter(p for s in sequences for p in s)
        uses.update(p for pair in nodes for p in pair)
        return cls([sorted(groups[g]) for g in order], nodes, sequences, [uses[p] for p in range(len(order) + len(nodes))])

    @staticmethod
    def _fold(sequences: list[list[int]], classes: int) -> list[tuple[int, int]]:
        """Replace neighbours that stand in two sequences or more by nodes, the most frequent first, until none does."""
        nodes: dict[tuple[int, int], int] = {}
        while True:
            seen = Counter(pair for s in sequences for pair in zip(s, s[1:]))
            shared = {pair: n for pair, n in seen.items() if n > 1}
            if not shared:
                return list(nodes)
            for s in sequences:
                at, out = 0, []
                while at < len(s):
                    here = shared.get((s[at], s[at + 1]), 0) if at + 1 < len(s) else 0
                    after = shared.get((s[at + 1], s[at + 2]), 0) if at + 2 < len(s) else 0
                    if here and here >= after:
                        out.append(nodes.setdefault((s[at], s[at + 1]), classes + len(nodes)))
                        at += 2
                    else:
                        out.append(s[at])
                        at += 1
                s[:] = out

    def additions(self) -> tuple[int, int]:
        """Additions over a batch of documents with and without sharing, a term counting as one."""
        size = [len(c) for c in self.classes] + [1] * len(self.nodes)
        shared = sum(size[p] for p in range(len(size)) if self.uses[p])
        whole = [len(c) for c in self.classes]
        for a, b in self.nodes:
            whole.append(whole[a] + whole[b])
        return shared + sum(len(s) for s in self.items), sum(whole[p] for s in self.items for p in s)

    def accumulators(self, postings: Postings, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, score of every document of the batch); ``values`` holds weight times share of each posting."""
        left, live = list(self.uses), {}

        def part(p: int) -> np.ndarray:
            if p not in live:
                if p < len(self.classes):
                    out = np.zeros(postings.documents, dtype=np.int64)
                    for term, count in self.classes[p]:
                        at = slice(postings.first[term], postings.first[term + 1])
                        out[postings.doc[at]] += values[at] * count
                else:
                    a, b = self.nodes[p - len(self.classes)]
                    out = part(a) + part(b)
                    for child in (a, b):
                        release(child)
                live[p] = out
            return live[p]

        def release(p: int) -> None:
            left[p] -= 1
            if not left[p]:
                del live[p]

        for number, sequence in enumerate(self.items):
            total = np.zeros(postings.documents, dtype=np.int64)
            for p in sequence:
                total += part(p)
                release(p)
            yield number, total


@dataclass
class Postings:
    """Postings of a batch of documents, by term; ``first`` has one entry more than there are terms."""

    documents: int
    first: np.ndarray
    doc: np.ndarray
    tf: np.ndarray

    @classmethod
    def of(cls, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, n_terms: int, documents: int) -> Postings:
        order = np.argsort(term, kind="stable")
        first = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=n_terms))))
        return cls(documents, first, doc[order], tf[order].astype(np.int64))


def length_parts(n: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """m of documents with ``n`` terms; counts whose product leaves 64 bits are multiplied as Python integers."""
    if n.size and 75 * int(n.max()) * documents >= 1 << 63:
        return np.array([25 + 75 * int(x) * documents // all_terms for x in n], dtype=np.int64)
    return 25 + (75 * n * documents) // all_terms


class Best:
    """The k best (score, id) of each item; ties to the smaller id, null ids last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score = [np.empty(0, np.int64)] * items
        self.id = [np.empty(0, np.int64)] * items
        self.null = [np.empty(0, bool)] * items

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        least = max(1, int(self.score[item][-1]) if self.score[item].size == self.k else 1)
        at = np.flatnonzero(scores >= least)
        if at.size > self.k:
            edge = np.partition(scores[at], at.size - self.k)[at.size - self.k]
            at = at[scores[at] >= edge]
        if not at.size:
            return
        score, name, null = (np.concatenate((x[item], y[at])) for x, y in ((self.score, scores), (self.id, ids), (self.null, nulls)))
        order = np.lexsort((name, null, -score))[: self.k]
        self.score[item], self.id[item], self.null[item] = score[order], name[order], null[order]


def rank(docs: DataFrame, items: DataFrame, k: int = 10, doc_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Columns item id, rank (from 1), doc id, score: the ``k`` best documents with a score above 0 of each item.

    Document ids are integers.  Items are taken in blocks of bounded size, each
    with a pass over the documents; a block's distinct terms are the only thing
    that is collected or broadcast.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    names = (item_col, "rank", doc_col, "score")
    if len({n.lower() for n in names}) < 4:
        raise ValueError(f"the columns {names} must differ")
    chosen = docs.select(docs[doc_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text"))
    asked = written(items.select(items[item_col].alias("item"), items[item_text_col].cast("string").alias("text"))
                    .withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")), "items")
    blocks = 1 + (asked.agg(F.sum("size")).first()[0] or 0) // BLOCK_BYTES
    schema = asked.select("item").schema.add("number", IntegerType()).add("id", LongType()).add("score", LongType())
    found = []
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        counted = part.mapInArrow(_item_terms, asked.select("item").schema.add("terms", ArrayType(BinaryType())).add("counts", ArrayType(IntegerType()))).toArrow()
        found.append(_ranked(chosen, counted, k, schema))
    result = functools.reduce(DataFrame.union, found)
    return result.select(F.col("item").alias(item_col), "rank", F.col("id").alias(doc_col), "score")


def _ranked(docs: DataFrame, counted: pa.Table, k: int, schema) -> DataFrame:
    """Best documents of the items of one block."""
    spark = docs.sparkSession
    lists, numbers = counted["terms"].to_pylist(), counted["counts"].to_pylist()
    vocabulary = sorted({t for x in lists for t in x})
    code = {t: i for i, t in enumerate(vocabulary)}
    sharing = Sharing.of([{code[t]: c for t, c in zip(x, y)} for x, y in zip(lists, numbers)])
    known = spark.sparkContext.broadcast(vocabulary)
    postings = written(docs.mapInArrow(lambda batches: _postings(batches, known.value),
                                       "id bigint, n bigint, terms array<int>, tfs array<int>"), "postings")
    totals = postings.agg(F.count("*"), F.sum("n")).first()
    documents, all_terms = totals[0], totals[1] or 0
    df = dict(postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    weights = np.array([weight(documents, df.get(t, 0)) for t in range(len(vocabulary))], dtype=np.int64)
    plan = spark.sparkContext.broadcast((sharing, weights, counted["item"].combine_chunks()))
    best = postings.mapInArrow(lambda batches: _evaluated(batches, plan.value, documents, all_terms, k), schema)
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item", "rank", "id", "score")


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = terms(batch["text"])
        raw = found.raw.tobytes()
        counts = [Counter(raw[s:e] for s, e in zip(found.start[a:b].tolist(), found.end[a:b].tolist()))
                  for a, b in zip(found.first[:-1], found.first[1:])]
        yield pa.RecordBatch.from_arrays([batch["item"], pa.array([list(c) for c in counts], pa.list_(pa.binary())),
                                          pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))],
                                         names=["item", "terms", "counts"])


def _postings(batches: Iterator[pa.RecordBatch], vocabulary: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Number of terms, and the vocabulary's terms with their counts, of each document that has terms."""
    raw = np.frombuffer(b"".join(vocabulary), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in vocabulary], dtype=np.int64)
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)[: len(vocabulary)]
    keys = textarrays.part_hash(textarrays.running_hash(raw), starts, ends) if vocabulary else np.empty(0, np.uint64)
    order = np.argsort(keys)
    keys = keys[order]
    for batch in batches:
        for begin, end in textarrays.slices(batch["text"]):
            rows = batch.slice(begin, end - begin)
            found = terms(rows["text"])
            n = np.diff(found.first)
            at = np.minimum(np.searchsorted(keys, found.hash), max(keys.size - 1, 0))
            hit = np.flatnonzero(keys[at] == found.hash) if keys.size else np.empty(0, np.int64)
            term = order[at[hit]] if keys.size else hit
            distinct, first, back = np.unique(term, return_index=True, return_inverse=True)
            same = [found.raw[found.start[w]: found.end[w]].tobytes() == vocabulary[t] for t, w in zip(distinct.tolist(), hit[first].tolist())]
            right = np.array(same, dtype=bool)[back]  # equal hashes, unequal words
            pair, tf = np.unique(found.doc[hit[right]] * max(len(vocabulary), 1) + term[right], return_counts=True)
            doc = pair // max(len(vocabulary), 1)
            keep = np.flatnonzero(n)
            each = np.bincount(doc, minlength=n.size)[keep]
            offsets = pa.array(np.concatenate(([0], np.cumsum(each))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [rows["id"].take(pa.array(keep)), pa.array(n[keep], pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array((pair % max(len(vocabulary), 1)).astype(np.int32))),
                 pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))], names=["id", "n", "terms", "tfs"])


def _evaluated(batches: Iterator[pa.RecordBatch], plan: tuple, documents: int, all_terms: int, k: int) -> Iterator[pa.RecordBatch]:
    """The best documents of the task for each item."""
    sharing, weights, item_ids = plan
    best = Best(len(sharing.items), k)
    most = max(256, CELLS // max(1, len(sharing.classes) + len(sharing.nodes)))

    def score(rows: pa.Table) -> None:
        ids, lists = rows["id"].combine_chunks(), rows["terms"].combine_chunks()
        n = rows["n"].to_numpy()
        size = pa.compute.list_value_length(lists).to_numpy().astype(np.int64)
        postings = Postings.of(lists.flatten().to_numpy(), np.repeat(np.arange(n.size), size),
                               rows["tfs"].combine_chunks().flatten().to_numpy(), weights.size, n.size)
        m = length_parts(n, documents, all_terms)
        term = np.repeat(np.arange(weights.size), np.diff(postings.first))
        values = weights[term] * ((SCALE * postings.tf) // (1000 * postings.tf + 8 * m[postings.doc]))
        names, nulls = pa.compute.fill_null(ids, 0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        for item, total in sharing.accumulators(postings, values):
            best.add(item, total, names, nulls)

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            held.append(batch.slice(at, most))
            rows += held[-1].num_rows
            if rows >= most:
                score(pa.Table.from_batches(held))
                held, rows = [], 0
    if rows:
        score(pa.Table.from_batches(held))
    number = np.repeat(np.arange(len(best.score)), [x.size for x in best.score]).astype(np.int32)
    if number.size:
        yield pa.RecordBatch.from_arrays(
            [item_ids.take(pa.array(number)), pa.array(number), pa.array(np.concatenate(best.id), mask=np.concatenate(best.null)),
             pa.array(np.concatenate(best.score))], names=["item", "number", "id", "score"])
