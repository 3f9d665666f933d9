"""Histogram gradient boosting of regression trees in one barrier job.

Every task keeps the binned features of its rows for the whole training.  A
level of a tree costs one exchange: tasks add up their histograms of gradients
with ``BarrierTaskContext.allGather`` and then all find the same splits, so a
model of hundreds of rounds is a single Spark job.  Gradients are whole
multiples of a power of two, hence their sums are exact and the model does not
depend on how rows are dealt or on a retried stage.  Rows and features of a
round are drawn by hash.  A barrier costs about a second, so a task is given many
rows, and a table that fits into one task needs no exchange.

Squared error with second-order gains: a split gains
``GL^2/(HL+l) + GR^2/(HR+l) - G^2/(H+l)`` and a leaf is ``-eta G/(H+l)``; rows
with a feature below the cut go left.  A feature with more than ``MAX_BINS``
distinct values is cut at evenly spaced ones.  Null labels or features are an
error.  All tasks of a job must get a slot at once, so there are never more
than the cluster has cores; a lost executor repeats the job.
"""

from __future__ import annotations

import base64
import sys
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweeplens.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LAMBDA, LEAST_GAIN, LEAST_CHILD = 1.0, 1e-6, 1.0  # fixed values of the original regressors
MAX_BINS = 256
CELLS_PER_TASK = 1 << 24  # binned values a task should hold: a barrier takes about a second, however few rows there are
CHUNK = 1 << 20  # binned values that are counted at a time
NODES = "target string, tree int, node int, feature int, cut double, value double, gain double, cover double"
_U = np.uint64


@dataclass(frozen=True)
class Spec:
    rounds: int
    depth: int
    eta: float
    subsample: float = 1.0
    colsample: float = 1.0
    seed: int = 42


def _mix(x: np.ndarray) -> np.ndarray:
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> _U(shift))) * _U(mul)
    return x ^ (x >> _U(31))


def drawn(hashes: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """Uniform [0, 1) per hash for one round of one seed."""
    salt = _mix(np.array([(seed * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) % 2**64], dtype=np.uint64))
    return (_mix(_mix(hashes.view(np.uint64) ^ salt) + salt) >> _U(11)) * (1.0 / (1 << 53))


def drawn_columns(n: int, share: float, seed: int, turn: int) -> np.ndarray:
    """The features of a round, in order: the share with the smallest draws, one at least."""
    keys = drawn(np.arange(n, dtype=np.int64), seed ^ 0x5EED, turn)
    return np.sort(np.argsort(keys, kind="stable")[: max(1, int(share * n))])


def splits(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """Best (feature, bin, gain, left G, left H) of each node, from histograms (node, feature, bin).

    Equal gains go to the first feature, then the first bin; a node without a
    valid cut has gain -inf.
    """
    gl, hl = np.cumsum(g, axis=2), np.cumsum(h, axis=2)
    gt, ht = gl[:, :, -1:], hl[:, :, -1:]
    gr, hr = gt - gl, ht - hl
    gain = gl * gl / (hl + LAMBDA) + gr * gr / (hr + LAMBDA) - gt * gt / (ht + LAMBDA)
    gain[(hl < LEAST_CHILD) | (hr < LEAST_CHILD)] = -np.inf
    flat = gain.reshape(len(g), -1)
    best = flat.argmax(axis=1)
    at = np.arange(len(g))
    return best // g.shape[2], best % g.shape[2], flat[at, best], gl.reshape(flat.shape)[at, best], hl.reshape(flat.shape)[at, best]


class _Tree:
    """One tree in progress: where each row stands, and the nodes that are still open."""

    def __init__(self, rows: int, spec: Spec):
        self.spec = spec
        self.node = np.zeros(rows, dtype=np.int64)
        self.slot = np.zeros(rows, dtype=np.int64)  # of the open nodes, -1 in a leaf
        self.open = np.zeros(1, dtype=np.int64)
        self.value = np.zeros(2 ** (spec.depth + 1) - 1)
        self.cover = np.zeros(self.value.size)
        self.inner: list[tuple[np.ndarray, ...]] = []

    def histogram(self, codes: np.ndarray, gradient: np.ndarray, sampled: np.ndarray, bins: int) -> np.ndarray:
        """Gradient sums and row counts by (open node, feature, bin); ``codes`` count feature * bins + bin."""
        features = codes.shape[1]
        rows = np.flatnonzero(sampled & (self.slot >= 0))
        size = self.open.size * features * bins
        out = np.zeros((2, size))
        for at in range(0, rows.size, 1 + CHUNK // features):
            some = rows[at: at + 1 + CHUNK // features]
            key = (codes[some] + self.slot[some, None] * (features * bins)).ravel()
            out[0] += np.bincount(key, np.repeat(gradient[some], features), size)
            out[1] += np.bincount(key, minlength=size)
        return out.ravel()

    def grow(self, histogram: np.ndarray, columns: np.ndarray, bins: int, unit: float, codes: np.ndarray, level: int) -> None:
        """Split the open nodes where it gains and move all rows, also those left out of the sample."""
        g, h = histogram.reshape(2, self.open.size, columns.size, bins)
        g = g * unit
        feature, place, gain, gl, hl = splits(g, h)
        gt, ht = g[:, 0].sum(axis=1), h[:, 0].sum(axis=1)
        if level == 0:
            self.value[0], self.cover[0] = -self.spec.eta * gt[0] / (ht[0] + LAMBDA), ht[0]
        split = gain > LEAST_GAIN
        parents = self.open[split]
        for side, (gs, hs) in enumerate(((gl, hl), (gt - gl, ht - hl))):
            self.value[2 * parents + 1 + side] = -self.spec.eta * gs[split] / (hs[split] + LAMBDA)
            self.cover[2 * parents + 1 + side] = hs[split]
        self.inner.append((parents, columns[feature[split]], place[split], gain[split]))
        rows = np.flatnonzero(self.slot >= 0)
        rows = rows[split[self.slot[rows]]]
        at = self.slot[rows]
        right = codes[rows, feature[at]] - feature[at] * bins > place[at]
        self.node[rows] = 2 * self.node[rows] + 1 + right
        number = np.cumsum(split) - 1
        last = level + 1 == self.spec.depth
        moved = np.full(self.slot.size, -1, dtype=np.int64)
        if not last:
            moved[rows] = 2 * number[at] + right
        self.slot = moved
        self.open = np.empty(0, np.int64) if last else np.stack((2 * parents + 1, 2 * parents + 2), axis=1).ravel()

    def table(self, target: str, number: int, edges: list[np.ndarray]) -> list[tuple]:
        parents, features, places, gains = (np.concatenate(x) for x in zip(*self.inner))
        inner = {p: (f, e, g) for p, f, e, g in zip(parents.tolist(), features.tolist(), places.tolist(), gains.tolist())}
        every = [0, *(2 * p + s for p in inner for s in (1, 2))]
        out = []
        for node in sorted(every):
            feature, place, gain = inner.get(node, (None, None, None))
            cut = None if feature is None else float(edges[feature][place])
            out.append((target, number, node, feature, cut, float(self.value[node]), gain, float(self.cover[node])))
        return out


def binned(x: np.ndarray, distinct: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bin of each value and the cuts between bins, from every feature's distinct values over all rows."""
    codes, edges = np.empty(x.shape, dtype=np.int32), []
    for f, values in enumerate(distinct):
        cuts = (values[1:] + values[:-1]) / 2
        if cuts.size >= MAX_BINS:
            cuts = cuts[np.linspace(0, cuts.size - 1, MAX_BINS - 1).round().astype(int)]
        codes[:, f] = np.searchsorted(cuts, x[:, f], side="right")
        edges.append(cuts)
    return codes, edges


def boosted(x: np.ndarray, y: np.ndarray, hashes: np.ndarray, targets: list[str], spec: Spec,
            gather: Callable[[bytes], list[bytes]]) -> Iterator[list[tuple]]:
    """Node rows of all trees, from this task's rows; ``gather`` brings every task's message to all.

    A tree numbered -1 holds the mean label of its target.
    """
    def added(values: np.ndarray) -> np.ndarray:
        return np.sum([np.frombuffer(m) for m in gather(values.tobytes())], axis=0).reshape(values.shape)

    # one exchange: rows, largest labels, and each feature's distinct values
    distinct = [np.unique(x[:, f]) for f in range(x.shape[1])]
    own = [np.array([float(len(x))]), np.abs(y).max(axis=0, initial=0.0), *distinct]
    sizes = np.array([a.size for a in own], dtype=np.float64)
    heads = [np.frombuffer(m) for m in gather(np.concatenate((sizes, *own)).tobytes())]
    parts = [np.split(h[sizes.size:], np.cumsum(h[: sizes.size].astype(np.int64))[:-1]) for h in heads]
    rows, size = int(sum(p[0][0] for p in parts)), len(x)
    if not rows:
        raise ValueError("no rows to learn from")
    codes, edges = binned(x, [np.unique(np.concatenate([p[2 + f] for p in parts])) for f in range(x.shape[1])])
    width = x.shape[1]
    del x, distinct, own, heads  # the bins are enough
    bins = 1 + max(e.size for e in edges)
    reach = np.maximum(np.max([p[1] for p in parts], axis=0), 1e-30)
    unit = 2.0 ** np.ceil(np.log2(reach * rows) - 49)  # sums of eight times the largest label stay exact
    mean = added(np.rint(y / unit).sum(axis=0)) * unit / rows
    trees = [[(target, -1, 0, None, None, float(mean[t]), None, float(rows))] for t, target in enumerate(targets)]
    state = [(t, target, unit[t], 8 * reach[t], np.full(size, mean[t])) for t, target in enumerate(targets)]
    yield [row for first in trees for row in first]
    for turn in range(spec.rounds):
        columns = drawn_columns(width, spec.colsample, spec.seed, turn)
        sampled = drawn(hashes, spec.seed, turn) < spec.subsample
        offset = codes[:, columns] + (np.arange(columns.size) * bins).astype(np.int32)
        grown = [_Tree(size, spec) for _ in targets]
        gradients = [np.rint(np.clip(f - y[:, t], -most, most) / unit) for t, _, unit, most, f in state]
        for level in range(spec.depth):
            live = [t for t, tree in enumerate(grown) if tree.open.size]
            if not live:
                break
            parts = [grown[t].histogram(offset, gradients[t], sampled, bins) for t in live]
            total = added(np.concatenate(parts))
            for t, part in zip(live, np.split(total, np.cumsum([p.size for p in parts])[:-1])):
                grown[t].grow(part, columns, bins, state[t][2], offset, level)
        for tree, (_, _, _, _, predicted) in zip(grown, state):
            predicted += tree.value[tree.node]
        yield [row for t, tree in enumerate(grown) for row in tree.table(targets[t], turn, edges)]


def _arrays(batches: Iterator[pa.RecordBatch], width: int, targets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and key hashes of a task's rows."""
    parts = [(b["x"].flatten().to_numpy(), b["y"].flatten().to_numpy(), b["h"].to_numpy()) for b in batches if b.num_rows]
    x, y, h = zip(*parts) if parts else ([np.empty(0)], [np.empty(0)], [np.empty(0, np.int64)])
    return np.concatenate(x).reshape(-1, width), np.concatenate(y).reshape(-1, targets), np.concatenate(h)


def fit(rows: DataFrame, features: str, labels: dict[str, str], key: str, spec: Spec) -> DataFrame:
    """Node table of one regressor for each of ``labels`` (target name to column).

    ``features`` is an array column, ``key`` (any column) decides the draws of a
    row; rows with equal keys are drawn together.  The table is written.
    """
    spark = rows.sparkSession
    chosen = rows.select(F.col(features).cast("array<double>").alias("x"), F.array(*[F.col(c).cast("double") for c in labels.values()]).alias("y"),
                         F.xxhash64(key).alias("h"))
    size = chosen.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("most"), F.min(F.size("x")).alias("least"),
                      F.count_if(F.col("x").isNull() | F.exists("x", F.isnull) | F.exists("y", F.isnull)).alias("null")).first()
    if size["null"] or not size["n"] or size["most"] != size["least"]:
        raise ValueError("every row needs all labels and features, and there must be rows")
    tasks = max(1, min(spark.sparkContext.defaultParallelism, size["n"] * size["most"] // CELLS_PER_TASK))
    targets, width = list(labels), size["most"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()

        def gather(message: bytes) -> list[bytes]:
            if tasks == 1:
                return [message]
            packed = base64.b64encode(zlib.compress(message, 1)).decode()
            return [zlib.decompress(base64.b64decode(m)) for m in context.allGather(packed)]

        names = [p.split()[0] for p in NODES.split(", ")]
        types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), *[pa.float64()] * 4]
        for found in boosted(*_arrays(batches, width, len(targets)), targets, spec, gather):
            if context.partitionId() == 0:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)

    path = scratch_path(spark, "trees")
    chosen.repartition(tasks, "h").mapInArrow(run, NODES, barrier=True).write.parquet(path)
    return spark.read.schema(NODES).parquet(path)


# --- applying -----------------------------------------------------------------

@dataclass
class Ensemble:
    """Trees as full binary arrays: inner nodes with feature and cut, leaves with values."""

    base: float
    depth: int
    feature: np.ndarray  # (tree, inner node)
    cut: np.ndarray
    value: np.ndarray  # (tree, leaf of the full tree)

    @classmethod
    def of(cls, nodes: DataFrame, target: str, spec: Spec) -> Ensemble:
        """Collect one target's nodes: at most ``rounds * (2^(depth+1) - 1)`` of them."""
        found = nodes.where(F.col("target") == target).drop("target", "gain", "cover").toArrow()
        tree, node = found["tree"].to_numpy(), found["node"].to_numpy()
        feature, cut = found["feature"].fill_null(-1).to_numpy(), found["cut"].fill_null(np.inf).to_numpy()
        value = found["value"].to_numpy()
        base, real = float(value[tree < 0][0]), tree >= 0
        tree, node, feature, cut, value = (a[real] for a in (tree, node, feature, cut, value))
        inner = 2 ** spec.depth - 1
        features = np.full((spec.rounds, 2 * inner + 1), -1, dtype=np.int64)
        cuts, values = np.full(features.shape, np.inf), np.full(features.shape, np.nan)
        features[tree, node], cuts[tree, node], values[tree, node] = feature, cut, value
        for i in range(inner):  # below a leaf its value goes on
            for child in (2 * i + 1, 2 * i + 2):
                values[:, child] = np.where(features[:, i] < 0, values[:, i], values[:, child])
        return cls(base, spec.depth, np.maximum(features[:, :inner], 0), cuts[:, :inner], values[:, inner:])

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Predictions of rows of features: all trees are walked level by level, some rows at a time."""
        out = np.empty(len(x))
        step = max(1, (1 << 17) // max(1, len(self.feature)))  # few enough to stay near the processor
        inner = self.feature.shape[1]
        start = np.arange(len(self.feature)) * inner
        leaf = np.arange(start.size) * self.value.shape[1] - inner
        feature, cut, value = self.feature.ravel(), self.cut.ravel(), self.value.ravel()
        for at in range(0, len(x), step):
            part = x[at: at + step]
            first = np.arange(len(part))[:, None] * x.shape[1]
            flat = part.ravel()
            node = np.zeros((len(part), start.size), dtype=np.int64)
            for _ in range(self.depth):
                here = node + start
                node = 2 * node + 1 + (flat.take(first + feature.take(here)) >= cut.take(here))
            out[at: at + step] = self.base + value.take(node + leaf).sum(axis=1)
        return out


def predicted(df: DataFrame, models: dict[str, Ensemble], features: str = "counts") -> DataFrame:
    """``df`` with ``pred_<name>`` for each model; a row without features has null.

    The walk is marked so that filters on its results stay above it: rows that an
    earlier filter drops are then not walked.
    """
    spark: SparkSession = df.sparkSession
    shared = spark.sparkContext.broadcast(models)
    fields = ", ".join(f"pred_{name}: double" for name in models)

    @F.arrow_udf(f"struct<{fields}>")
    def walk(column: pa.Array) -> pa.Array:
        whole = column.is_valid()
        x = column.filter(whole)
        size = len(x)
        matrix = x.flatten().to_numpy(zero_copy_only=False).reshape(size, -1) if size else np.empty((0, 1))
        place = np.cumsum(whole.to_numpy(zero_copy_only=False)) - 1
        arrays = [pa.array(m.predict(matrix) if size else np.empty(0)).take(pa.array(place, mask=~whole.to_numpy(zero_copy_only=False)))
                  for m in shared.value.values()]
        return pa.StructArray.from_arrays(arrays, names=[f"pred_{name}" for name in shared.value])

    made = df.withColumn("_walked", walk.asNondeterministic()(F.col(features).cast("array<double>")))
    return made.select(*df.columns, *[F.col(f"_walked.pred_{name}").alias(f"pred_{name}") for name in models])


def importance(nodes: DataFrame, target: str, n: int) -> DataFrame:
    """Mean gain, mean cover and number of splits of each of ``n`` features; zeros where a feature is not used."""
    used = nodes.where((F.col("target") == target) & F.col("feature").isNotNull()).groupBy(F.col("feature").alias("layer_idx")).agg(
        F.avg("gain").alias("gain"), F.avg("cover").alias("cover"), F.count("*").cast("double").alias("weight"))
    every = nodes.sparkSession.range(n).select(F.col("id").cast("int").alias("layer_idx"))
    return every.join(used, "layer_idx", "left").select("layer_idx", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("gain", "cover", "weight")])
