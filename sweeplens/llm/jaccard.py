"""Jaccard join of shingle sets by group-count vectors.

Shingles are hashed into groups, and a document is the point of its counts per
group.  Two sets overlap by at most the sum, over the groups, of the smaller of
both counts; a pair whose sum falls short of the overlap it needs is out.

The bound is used three times.  With fine groups (one a hash value) it says that
linked sets share one of the groups in which few documents have a count, so
each document is posted only under its lightest groups (cells).  In a cell an
R-tree over coarse counts prunes nodes by the largest counts of their members,
then pairs by their own; sets connected by the pairs left are a family.  What
survives the bound inside a family is verified on the sets.

Families are cut into chunks of bounded size.  First each chunk is joined alone,
then one member of each component found so far, chunk by chunk, and only
families that are still in several components have all their chunks paired.
So a large group of near copies costs about as many comparisons as it has
members, and never all its pairs.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweeplens.llm import textarrays
from sweeplens.llm.shared import IdFilter, components, contracted, forest, key_groups, local_forest, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MASSES = 1 << 20  # groups whose counts over all documents order the posting
_BLOCK = 1 << 14
GROUPS = 256  # groups of the R-tree's points
LEAF = 16  # points of a leaf
FULL = 255  # a posted count at its largest, which may stand for more
SMALL, LARGEST = 48, 16_384  # rows of a cell: paired outright up to the first, by R-tree up to the second, see _families
CHUNK = 512  # documents of a chunk
CHUNK_SHINGLES = 1 << 20  # about as many shingles


@dataclass(frozen=True)
class Rule:
    """Sets link when their overlap is at least ``over / under`` of their union."""

    words: int = 5
    over: int = 80
    under: int = 100

    def needed(self, n, m):
        """Smallest overlap with which sets of these sizes link."""
        return -(-self.over * (n + m) // (self.over + self.under))

    def posted(self, n):
        """How many shingles of a set are posted: one more than can be missing from a partner."""
        return n - -(-self.over * n // self.under) + 1


def _sets(column: pa.Array, words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Sorted distinct shingle hashes of each text, by slices: place of the first text, sets."""
    for a, b in textarrays.slices(column):
        w = textarrays.words(column.slice(a, b - a))
        h, first, _ = textarrays.shingles(w.hash, w.first, words)
        found = []
        for i in range(b - a):
            own = np.sort(h[first[i]: first[i + 1]])
            found.append(own[np.append(True, own[1:] != own[:-1])] if own.size else own)
        yield a, found


def _identity(s: np.ndarray) -> int:
    """A hash of the whole set, as signed 64 bits."""
    value = (int(textarrays.mix(s).sum(dtype=np.uint64)) + s.size * 0x9E3779B97F4A7C15) & (2**64 - 1)
    return int(textarrays.mix(np.array([value], dtype=np.uint64)).view(np.int64)[0])


def _survey(words: int):
    """Per document its set's size and identity; per task the counts of all groups, in blocks."""
    names = ["doc_id", "row", "text_hash", "n", "s", "block", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masses = np.zeros(MASSES, dtype=np.uint32)
        for batch in batches:
            for at, sets in _sets(batch.column(3), words):
                everything = np.concatenate([*sets, np.empty(0, np.uint64)])
                masses += np.bincount((everything % np.uint64(MASSES)).astype(np.int64), minlength=MASSES).astype(np.uint32)
                k = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(at, k) for c in range(3)), pa.array([s.size for s in sets], pa.int64()), pa.array([_identity(s) for s in sets], pa.int64()),
                     pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        for block in range(MASSES // _BLOCK):
            counts = masses[block * _BLOCK: (block + 1) * _BLOCK]
            if counts.any():
                yield pa.RecordBatch.from_arrays(
                    [*[pa.nulls(1, pa.int64())] * 5, pa.array([block], pa.int32()),
                     pa.array([counts.astype("<u4").tobytes()], pa.binary())], names=names)

    return run


def _add(key: tuple, table: pa.Table) -> pa.Table:
    total = np.zeros(_BLOCK, dtype=np.uint64)
    for x in table["counts"].to_pylist():
        total += np.frombuffer(x, "<u4")
    total = np.minimum(total, 2**32 - 1).astype("<u4")
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def _postings(masses, rule: Rule):
    """Per distinct set of a slice: identity, size and the lightest shingles it is posted under."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass = masses.value
        for batch in batches:
            for _, sets in _sets(batch.column(0), rule.words):
                rows = {}
                for s in sets:
                    if s.size:
                        rows.setdefault(_identity(s), s)
                lists, points = [], []
                for s in rows.values():
                    count = rule.posted(s.size)
                    weight = mass[(s % np.uint64(MASSES)).astype(np.int64)]
                    lists.append(s[np.lexsort((s, weight))[:count]].view(np.int64))
                    points.append(np.minimum(_point(s), FULL).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(rows), pa.int64()), pa.array([s.size for s in rows.values()], pa.int64()), pa.array(lists, pa.list_(pa.int64())),
                     pa.array(points, pa.binary())], names=["s", "n", "keys", "point"])

    return run


def _point(s: np.ndarray) -> np.ndarray:
    """Counts of a set's shingles per coarse group."""
    return np.bincount((s % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)


def _shared(rule: Rule):
    """Of rows sorted by (key, n, s) those with a neighbour under their key of another set whose size allows a link.

    As sizes ascend, a row without one links with nobody under the key.  The
    first and the last row of a partition stay, as their neighbours are elsewhere.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, True  # the row that awaits its follower
        for batch in batches:
            key, n, s = (batch.column(i).to_numpy() for i in range(3))
            if not len(key):
                continue
            if last is not None:
                key, n, s = (np.concatenate(([x], y)) for x, y in zip(last, (key, n, s)))
            near = (key[1:] == key[:-1]) & (s[1:] != s[:-1]) & (n[1:] * rule.over <= n[:-1] * rule.under)
            keep = np.append(near, False) | np.insert(near, 0, kept)
            last, kept = (key[-1], n[-1], s[-1]), bool(keep[-1])
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep[:-1]]) for x in (key, n, s)], names=["key", "n", "s"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in last], names=["key", "n", "s"])

    return run


def _bounded(a: np.ndarray, b: np.ndarray, n_a, n_b, rule: Rule) -> np.ndarray:
    """Pairs of points whose summed coordinate minima allow a link; so do two points with a full count each."""
    both = np.minimum(a, b).sum(axis=1, dtype=np.int64)
    return (both >= rule.needed(n_a, n_b)) | ((a == FULL).any(axis=1) & (b == FULL).any(axis=1))


def _cell_edges(key: np.ndarray, n: np.ndarray, s: np.ndarray, point: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Edges between sets under one key whose points allow a link, enough of them to connect all that are so connected.

    Rows are sorted by (key, n, s).  Small cells are paired at one distance after
    the other, all at once; in larger ones an R-tree is asked for each row's
    partners, and those connected already are left out.
    """
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(start, len(key)))
    left = np.repeat(size, size)
    found_a, found_b = [], []
    small = left <= SMALL
    for d in range(1, int(size[size <= SMALL].max(initial=0))):
        i = np.flatnonzero(small[:-d] & (key[d:] == key[:-d]) & (s[d:] != s[:-d]) & (n[d:] * rule.over <= n[:-d] * rule.under))
        for at in range(0, len(i), 1 << 16):
            x = i[at: at + (1 << 16)]
            x = x[_bounded(point[x], point[x + d], n[x], n[x + d], rule)]
            found_a.append(s[x])
            found_b.append(s[x + d])
    for at, m in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist()):
        own = slice(at, at + m)
        counts, sizes = point[own].astype(np.int32), n[own]
        tree, label = Tree(counts, sizes), np.arange(m)
        for i in range(m):
            points, _ = tree.partners(counts[i], int(sizes[i]), rule, label[i] != label)
            if (counts[i] == FULL).any():
                points = np.union1d(points, np.flatnonzero((counts == FULL).any(axis=1) & (label != label[i])))
            if points.size:
                found_a.append(np.full(points.size, s[own][i]))
                found_b.append(s[own][points])
                label[np.isin(label, label[points])] = label[i]
    if not found_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return forest(np.concatenate(found_a), np.concatenate(found_b))


def _cells(rule: Rule):
    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_groups(batches, ["key"], 1 << 16):
            key, n, s = (table[c].to_numpy() for c in ("key", "n", "s"))
            point = np.frombuffer(b"".join(table["point"].to_pylist()), np.uint8).reshape(-1, GROUPS)
            a, b = _cell_edges(key, n, s, point, rule)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return local_forest(edges(batches))

    return run


def _families(postings: DataFrame, rule: Rule) -> DataFrame:
    """Sets connected by pairs under one key whose points allow a link: (node, root) of identities.

    Rows are first dealt by ranges of (key, n, s), so that of one key may lie in
    many partitions, and those that are alone under their key are left out.
    """
    rows = postings.select(F.explode("keys").alias("key"), "n", "s")
    dealt = rows.repartitionByRange("key", "n", "s").sortWithinPartitions("key", "n", "s")
    shared = written(dealt.mapInArrow(_shared(rule), "key bigint, n bigint, s bigint"), "shared")
    points = postings.groupBy("s").agg(F.min("point").alias("point"))
    large = shared.groupBy("key").agg(F.count("*").alias("rows"), F.min("s").alias("hub")).where(F.col("rows") > LARGEST)
    large = written(large.select("key", "hub"), "large")
    star = shared.join(large, "key").select(F.col("s").alias("a"), F.col("hub").alias("b"))
    met = (shared.join(large, "key", "left_anti").join(points, "s").select("key", "n", "s", "point").repartition("key").sortWithinPartitions("key", "n", "s")
           .mapInArrow(_cells(rule), "a bigint, b bigint"))
    return components(met.union(contracted(star.where("a <> b"))), forests=True)


def _set_bytes(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, sets in _sets(batch.column(0), words):
                rest = pa.RecordBatch.from_arrays([*(c.slice(at, len(sets)) for c in batch.columns[1:]), pa.array([s.tobytes() for s in sets], pa.binary())],
                                                  names=[*batch.schema.names[1:], "set"])
                # rows can share what they were joined by, not the identity
                yield rest.filter(pa.compute.equal(rest["s"], pa.array([_identity(s) for s in sets], pa.int64())))

    return run


class Tree:
    """R-tree of two levels over count vectors: leaves of neighbours with the largest counts and sizes among them."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, leaf: int = LEAF):
        self.counts, self.sizes = counts, sizes
        # tiles of similar size, inside a tile by the coordinate that varies most
        order = np.argsort(sizes, kind="stable")
        tile = leaf * 8
        for at in range(0, len(order), tile):
            part = order[at: at + tile]
            axis = int(np.argmax(counts[part].var(axis=0)))
            order[at: at + tile] = part[np.argsort(counts[part, axis], kind="stable")]
        self.leaves = [order[at: at + leaf] for at in range(0, len(order), leaf)]
        self.high = np.array([counts[p].max(axis=0) for p in self.leaves])
        self.low_size = np.array([sizes[p].min() for p in self.leaves])
        self.high_size = np.array([sizes[p].max() for p in self.leaves])

    def partners(self, counts: np.ndarray, size: int, rule: Rule, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Points (of the wanted ones) whose summed coordinate minima with ``counts`` allow a link, and those sums."""
        fits = (self.high_size * rule.under >= size * rule.over) & (self.low_size * rule.over <= size * rule.under)
        near = np.flatnonzero(fits)
        bound = np.minimum(self.high[near], counts).sum(axis=1)
        near = near[bound >= rule.needed(np.maximum(self.low_size[near], -(-size * rule.over // rule.under)), size)]
        if not near.size:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        points = np.concatenate([self.leaves[i] for i in near])
        if wanted is not None:
            points = points[wanted[points]]
        bound = np.minimum(self.counts[points], counts).sum(axis=1)
        alive = bound >= rule.needed(self.sizes[points], size)
        return points[alive], bound[alive]


def links(sets: list[np.ndarray], rule: Rule, label: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets (sorted hashes) of different labels.

    With ``side`` (0 or 1) only pairs of different sides are looked at.  Pairs
    that are connected already are not verified.
    """
    sizes = np.array([s.size for s in sets], dtype=np.int64)
    counts = np.array([_point(s) for s in sets]).astype(np.int32)
    tree = Tree(counts, sizes)
    group = np.unique(label, return_inverse=True)[1].tolist()
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for i in range(len(sets)):
        if side is not None and side[i]:
            continue
        points, bound = tree.partners(counts[i], int(sizes[i]), rule)
        other = points > i if side is None else side[points] == 1
        points, bound = points[other], bound[other]
        for j in points[np.argsort(-bound, kind="stable")].tolist():
            x, y = root(group[i]), root(group[j])
            if x == y:
                continue
            small, large = (sets[i], sets[j]) if sizes[i] <= sizes[j] else (sets[j], sets[i])
            at = np.searchsorted(large, small)
            at[at == large.size] = 0
            if int((large[at] == small).sum()) >= rule.needed(int(sizes[i]), int(sizes[j])):
                parent[x] = y
                found.append((i, j))
    return found


def _linked(rule: Rule, paired: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.take(np.unique(table["s"].to_numpy(), return_index=True)[1])  # equal rows of a text
        s, label = table["s"].to_numpy(), table["label"].to_numpy()
        sets = [np.frombuffer(x, "<u8") for x in table["set"].to_pylist()]
        side = table["side"].to_numpy() if paired else None
        both = paired and side.min() == side.max()  # a pair of chunks of which one is empty
        pairs = [] if len(sets) < 2 or both else links(sets, rule, label, side)
        a = np.array([s[i] for i, _ in pairs], dtype=np.int64)
        b = np.array([s[j] for _, j in pairs], dtype=np.int64)
        return pa.table({"a": a, "b": b})

    return run


def _sizes(live: DataFrame) -> DataFrame:
    """Members, their shingles and their labels of each family."""
    return live.groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"), F.count_distinct("label").alias("labels"))


def _chunked(live: DataFrame, salt: int) -> DataFrame:
    """Rows with ``chunk`` and ``chunks`` of their family (root): chunks of about CHUNK members at most."""
    per = _sizes(live).where("labels > 1")
    chunks = F.greatest(F.ceil(F.col("members") / CHUNK), F.ceil(F.col("shingles") / CHUNK_SHINGLES)).cast("int")
    per = per.select(F.col("root").alias("_root"), chunks.alias("chunks"))
    return (live.join(per, F.col("root") == F.col("_root")).drop("_root")
            .withColumn("chunk", F.pmod(F.xxhash64("s", F.lit(salt)), F.col("chunks")).cast("int")))


def _relabelled(live: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels after the edges (a, b) between members: the label's component."""
    names = live.select("s", "label").distinct()
    lifted = (edges.join(names.select(F.col("s").alias("a"), F.col("label").alias("la")), "a")
              .join(names.select(F.col("s").alias("b"), F.col("label").alias("lb")), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    roots = components(lifted)
    return live.join(roots.select(F.col("node").alias("label"), F.col("root").alias("_to")), "label", "left").select(
        *[F.coalesce("_to", "label").alias("label") if c == "label" else c for c in live.columns])


def _verified(sets: DataFrame, rule: Rule) -> DataFrame:
    """Labels of live sets (s, root, n, set): members of a family with the same label are linked by chains of links."""
    group = lambda df, keys, paired: written(
        df.groupBy(*keys).applyInArrow(_linked(rule, paired), "a bigint, b bigint"), "links")
    live = sets.select("s", "root", "n").distinct().withColumn("label", F.col("s"))  # equal rows gave equal sets
    body = sets.select("s", "set")

    left = None

    def joined(rows: DataFrame, keys: list[str], paired: bool = False) -> DataFrame:
        wanted = rows.select("s", "label", *keys, *(["side"] if paired else []))
        if left is not None:  # only sets of open families are moved again
            return group(wanted.join(IdFilter(rows.select(F.col("s").alias("id"))).passing(body, "s"), "s"), keys, paired)
        return group(wanted.join(body, "s"), keys, paired)

    rounds, before = 0, None
    while True:
        if left is None:
            rows = _chunked(live, rounds)
        else:  # one member of each label
            some = live.join(left.select("root"), "root", "left_semi").groupBy("root", "label").agg(F.min(F.struct("s", "n")).alias("x"))
            rows = _chunked(some.select("root", "label", "x.s", "x.n"), rounds)
        edges = joined(rows, ["root", "chunk"])
        live = written(_relabelled(live, edges), "labels")
        # families of several chunks that still have several labels
        left = _sizes(live).where("labels > 1")
        left = left.where((F.col("members") > CHUNK) | (F.col("shingles") > CHUNK_SHINGLES))
        open_labels = left.agg(F.coalesce(F.sum("labels"), F.lit(0))).first()[0]
        if open_labels == 0:
            return live
        if before is not None and open_labels > before / 2:
            break  # representatives join too little
        before, rounds = open_labels, rounds + 1
    # what no representative joined: every pair of chunks of these families, labels that differ only
    rows = _chunked(live.join(left.select("root"), "root", "left_semi"), 0)
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    pairs = (rows.withColumn("_o", other).where("_o <> chunk")
             .select("s", "root", "label", F.least("chunk", "_o").alias("c1"), F.greatest("chunk", "_o").alias("c2"), (F.col("_o") < F.col("chunk")).cast("int").alias("side")))
    return written(_relabelled(live, joined(pairs, ["root", "c1", "c2"], True)), "labels")


def classes(documents: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id reachable by links) of every document.

    A text with fewer words than a shingle has one shingle, the whole sequence;
    one without words, or null, has none and links with nothing.  Equal sets
    link; so do repeated ids.  A null id takes no part in the smallest id: a
    component of null ids alone has a null component_id.  An empty table gives an
    empty result.  No cap: every link counts, whatever a group's size.
    """
    spark = documents.sparkSession
    text = F.col(text_col).cast("string")
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(id_col).cast("bigint"), F.xxhash64(text)).alias("row"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    survey = written(rows.mapInArrow(_survey(rule.words), "doc_id bigint, row bigint, text_hash bigint, n bigint, s bigint, block int, counts binary"), "survey")
    docs = survey.where("block is null").select("doc_id", "row", "text_hash", "n", "s")
    masses = np.zeros(MASSES, dtype=np.uint32)
    for r in survey.where("block is not null").select("block", "counts").groupBy("block").applyInArrow(_add, "block int, counts binary").collect():
        masses[r["block"] * _BLOCK: (r["block"] + 1) * _BLOCK] = np.frombuffer(r["counts"], "<u4")
    shared = spark.sparkContext.broadcast(masses)  # MASSES counts, whatever the input
    postings = written(rows.select("text").mapInArrow(_postings(shared, rule), "s bigint, n bigint, keys array<bigint>, point binary"), "postings")
    families = written(_families(postings, rule), "families").select(F.col("node").alias("s"), "root")
    families = families.union(families.select(F.col("root").alias("s"), "root").distinct())

    distinct = docs.where("n > 0").groupBy("s").agg(F.min("n").alias("n"), F.min("doc_id").alias("id"), F.min("row").alias("row"))
    live = families.join(distinct, "s").select("s", "root", "n", "row")
    # one text of each live set
    live = written(live, "live")
    named = IdFilter(live.select(F.col("row").alias("id")))
    bodies = (named.passing(rows, "row").join(live, "row").select("text", "s", "root", "n")
              .mapInArrow(_set_bytes(rule.words), "s bigint, root bigint, n bigint, set binary"))
    labels = _verified(written(bodies, "sets"), rule).select("s", "label")
    by_set = distinct.join(labels, "s", "left").select("s", "id", F.coalesce("label", "s").alias("label"))
    least = by_set.groupBy("label").agg(F.min("id").alias("component_id"))
    of_set = written(by_set.join(least, "label").select("s", "component_id"), "classes")
    return (docs.join(of_set, "s", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "text_hash"))


def one_each(documents: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component: that with the smallest id, then text hash; of equal rows one.

    Texts without words, and components of null ids alone, stay.  Only rows
    that may go are shuffled.
    """
    found = written(classes(documents, rule, id_col, text_col).where("n_shingles > 0"), "found").where("component_id is not null")
    each = found.groupBy("doc_id", "text_hash", "component_id").agg(F.count("*").alias("rows"))
    first = found.where("doc_id is not null").groupBy("component_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    first = first.select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"), F.lit(True).alias("stays"))
    marked = each.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("text_hash").eqNullSafe(F.col("_hash")), "left")
    gone = written(marked.where("stays is null or rows > 1").select("doc_id", "text_hash", F.coalesce("stays", F.lit(False)).alias("stays")), "gone")
    text, doc = F.col(text_col).cast("string"), F.col(id_col).cast("bigint")
    rows = documents.select(F.struct("*").alias("row"), doc.alias("id"), F.xxhash64(text).alias("hash"))
    named, empty = IdFilter(gone.select(F.col("doc_id").alias("id"))), F.col("id").isNull()
    near = named.passing(rows, "id").union(rows.where(empty))
    hit = near.join(gone, F.col("id").eqNullSafe(F.col("doc_id")) & F.col("hash").eqNullSafe(F.col("text_hash")), "left")
    kept = hit.where("stays is null").select("row").union(hit.where("stays").dropDuplicates(["id", "hash"]).select("row"))
    return named.failing(rows.where(~empty), "id").select("row").union(kept).select("row.*")
