"""Toxicity by a factorization machine over hashed terms.

Terms are words and their beginnings.  The machine adds a weight for each term
of a text and, for each pair of them, the product of two learnt vectors, so
that a pair (an insult with the mention of a group) can count more than its
parts.  It is learnt from a bounded, hash-drawn sample of labelled rows; the
terms that tell most in it take part, alone or together with another one.
"""

from __future__ import annotations

import io
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweeplens.llm import textarrays
from sweeplens.llm.shared import bounded_batches, free_name

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 1 << 20  # hashed terms
PREFIX = 4  # characters of a word's beginning
TERMS = 4096  # terms the machine knows
PAIRED = 2048  # terms among which pairs are looked for
WRONG = 0.25  # expected share of the chosen terms that tell nothing
FACTORS = 8  # length of a term's vector
SAMPLE = (4_000, 8_000)  # rows of each label (1, 0) at most that it learns from
EPOCHS, BATCH, RATE, DECAY = 20, 128, 0.1, 1e-5


def _buckets(w: textarrays.Words) -> tuple[np.ndarray, np.ndarray]:
    """Places of the texts, and the buckets of their terms; repeats are not removed."""
    begun = textarrays.mix(w.part_hash(w.start, w.prefix_end(PREFIX)) ^ np.uint64(0x5851F42D4C957F2D))
    terms = np.concatenate((w.hash, begun))
    return np.concatenate((w.doc, w.doc)), (terms % np.uint64(BUCKETS)).astype(np.int64)


def _distinct(doc: np.ndarray, term: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(doc * width + term)
    return both // width, both % width


def _term_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct buckets of each text (label, text) as a binary of int32."""
    for batch in batches:
        for a, b in textarrays.slices(batch.column(1)):
            doc, term = _distinct(*_buckets(textarrays.words(batch.column(1).slice(a, b - a), True)), BUCKETS)
            first = np.searchsorted(doc, np.arange(b - a + 1))
            term = term.astype("<i4")
            lists = [term[first[i]: first[i + 1]].tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(lists, pa.binary())], names=["label", "terms"])


def chosen_terms(doc: np.ndarray, term: np.ndarray, label: np.ndarray, most: int = TERMS) -> np.ndarray:
    """The terms, in at least three rows, whose presence tells about the label, alone or together with another one.

    A term's error probability is that of its own chi-square or of the best pair
    it is in, for as many partners as there are.  Pairs are looked for among the
    ``PAIRED`` terms that split the rows most evenly.  As many terms are taken as
    keep the expected share of wrong ones under ``WRONG``, ``most`` at most.
    """
    n = len(label)
    present = np.bincount(term, minlength=BUCKETS).astype(float)
    prior = float(label.sum()) / max(n, 1)

    def chi_square(positive: np.ndarray, rows: np.ndarray) -> np.ndarray:
        spread = rows * prior * (1 - rows / max(n, 1)) * (1 - prior) + 1e-12
        return np.where(rows >= 3, (positive - rows * prior) ** 2 / spread, 0.0)

    def by_chance(score: np.ndarray) -> np.ndarray:
        return np.array([math.erfc(math.sqrt(x / 2)) for x in score.tolist()])

    able = np.flatnonzero(present >= 3)
    if not able.size:
        return able
    error = by_chance(chi_square(np.bincount(term, weights=label[doc], minlength=BUCKETS)[able], present[able]))
    even = np.sort(np.argsort(-present[able] * (n - present[able]), kind="stable")[:PAIRED])
    if even.size > 1:
        place = np.full(BUCKETS, -1)
        place[able[even]] = np.arange(even.size)
        known = place[term] >= 0
        x = np.zeros((n, even.size), dtype=np.float32)
        x[doc[known], place[term[known]]] = 1
        together = chi_square((x * label[:, None].astype(np.float32)).T @ x, x.T @ x)
        np.fill_diagonal(together, 0)
        error[even] = np.minimum(error[even], even.size * by_chance(together.max(axis=1)))
    order = np.argsort(error, kind="stable")
    fine = np.flatnonzero(error[order] <= WRONG * (np.arange(able.size) + 1) / able.size)
    taken = int(fine[-1]) + 1 if fine.size else 0
    return np.sort(able[order[: min(taken, most)]])


def fit(x: np.ndarray, y: np.ndarray, factors: int = FACTORS, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and vectors that fit labels ``y`` to 0/1 rows ``x`` (AdaGrad on the log loss)."""
    rng = np.random.default_rng(seed)
    n, m = x.shape
    bias, w = 0.0, np.zeros(m, dtype=np.float32)
    v = rng.normal(0, 0.02, (m, factors)).astype(np.float32)
    g_bias, g_w, g_v = 1e-6, np.full(m, 1e-6, np.float32), np.full((m, factors), 1e-6, np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            rows = order[at: at + BATCH]
            b = x[rows].astype(np.float32)
            inner = b @ v
            z = bias + b @ w + 0.5 * ((inner**2).sum(axis=1) - b @ (v**2).sum(axis=1))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]).astype(np.float32) / len(rows)
            d_w = b.T @ error + DECAY * w
            d_v = b.T @ (error[:, None] * inner) - (b.T @ error)[:, None] * v + DECAY * v
            d_bias = float(error.sum())
            g_bias += d_bias**2
            g_w += d_w**2
            g_v += d_v**2
            bias -= RATE * d_bias / g_bias**0.5
            w -= RATE * d_w / np.sqrt(g_w)
            v -= RATE * d_v / np.sqrt(g_v)
    return bias, w, v


def _train(prior: float, most: int, factors: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(b["label"].to_pylist(), b["terms"].to_pylist())))
        label = np.array([r[0] for r in rows], dtype=float)
        lists = [np.frombuffer(r[1], "<i4") for r in rows]
        doc = np.repeat(np.arange(len(rows)), [len(x) for x in lists])
        term = np.concatenate([*lists, np.empty(0, np.int32)]).astype(np.int64)
        terms = chosen_terms(doc, term, label, most)
        x = np.zeros((len(rows), len(terms)), dtype=np.uint8)
        at = np.searchsorted(terms, term)
        known = at < len(terms)
        known[known] = terms[at[known]] == term[known]
        x[doc[known], at[known]] = 1
        bias, w, v = fit(x, label, factors)
        own = (label.sum() + 1) / (len(label) + 2)  # the sample's share of label 1; the score is to use that of all rows
        bias += np.log(prior / (1 - prior)) - np.log(own / (1 - own))
        out = io.BytesIO()
        np.savez(out, bias=bias, w=w, v=v, terms=terms)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["model"])

    return run


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          sample: tuple[int, int] = SAMPLE, terms: int = TERMS, factors: int = FACTORS) -> bytes | None:
    """A machine learnt from labelled texts, or None without any labelled text.

    ``sample`` bounds the rows of label 1 and 0: those with the smallest hashes
    of their id, so the bound also bounds the one task that learns.  Rows
    without id or label are left out; an id with several labels has the largest.
    """
    bounded_batches(documents.sparkSession)
    each = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
            .groupBy(F.col(id_col).cast("bigint").alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("label")))
    n = {r["label"]: r["n"] for r in each.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not n:
        return None
    prior = (n.get(1, 0) + 1) / (n.get(1, 0) + n.get(0, 0) + 2)
    drawn = None
    for label, most in zip((1, 0), sample):
        part = each.where(F.col("label") == label).orderBy(F.xxhash64("_id"), "_id").limit(most)
        drawn = part if drawn is None else drawn.union(part)
    texts = documents.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    rows = texts.join(F.broadcast(drawn), "_id").select("label", "_text")  # at most sum(sample) ids are broadcast
    found = rows.mapInArrow(_term_lists, "label int, terms binary").repartition(1).mapInArrow(_train(prior, terms, factors), "model binary").collect()
    return bytes(found[0]["model"]) if found else None


def _score(model):
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        data = np.load(io.BytesIO(model.value)) if model.value else None
        if data is not None:
            bias, w, v, terms = float(data["bias"]), data["w"].astype(float), data["v"].astype(float), data["terms"]
            place = np.full(BUCKETS, -1, dtype=np.int32)
            place[terms] = np.arange(len(terms))
        for column in texts:
            score = np.zeros(len(column))
            for a, b in textarrays.slices(column) if data is not None else ():
                n = b - a
                doc, term = _buckets(textarrays.words(column.slice(a, n), True))
                at = place[term]
                doc, at = _distinct(doc[at >= 0], at[at >= 0].astype(np.int64), max(len(terms), 1))
                z = bias + np.bincount(doc, weights=w[at], minlength=n)
                for f in range(v.shape[1]):
                    inner = np.bincount(doc, weights=v[at, f], minlength=n)
                    z += 0.5 * (inner**2 - np.bincount(doc, weights=v[at, f] ** 2, minlength=n))
                score[a:b] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.array(score)

    return F.arrow_udf(run, "double", F.ArrowUDFType.SCALAR_ITER)


def held_out(doc_id: Column) -> Column:
    """Ids whose labels are for testing: crc32 of the id as text is divisible by five."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def scored(documents: DataFrame, model: bytes | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) and ``score`` between 0 and 1.

    A null or empty text has the score of the bias; without a model every score
    is 0.  A new column whose name is taken gets underscores at its end.  The
    whole text counts, however long; repeated rows have equal scores.
    """
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most TERMS terms
    keep = documents.columns if keep is None else keep
    score = _score(shared)(F.col(text_col).cast("string"))
    return documents.select(*[F.col(c) for c in keep], score.alias(free_name("score", keep)))


def accepted(documents: DataFrame, model: bytes | None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents whose score stays under ``threshold``, with their own columns."""
    name = free_name("score", documents.columns)
    return scored(documents, model, text_col).where(F.col(name) < threshold).select(*documents.columns)
