"""Document fingerprints from closed syncmers, in SQL functions only.

A text is cut into short tokens that start anew at every word, so that an edit
shifts no token beyond its own word.  Of all runs of ``K`` tokens those are
anchors whose smallest inner run of ``S`` tokens (by hash) lies at an edge: a
rule that looks at nothing outside the run, so equal passages have equal
anchors wherever they stand.  The fingerprint keeps the anchors with the
smallest hashes, each with its place; likeness counts shared anchors that
moved by about the same distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sweeplens.llm.shared import partitions

K, S = 5, 2
TOKEN = r"[\p{L}\p{N}]{1,4}|[^\s\p{L}\p{N}]+"
ANCHORS = 64  # of the smallest hashes
DRIFT = 0.25  # share of the places by which matched anchors may differ in movement
_PLACE_BITS = 31  # a place in the longest string there can be
_HASH_BITS = 63 - _PLACE_BITS


def fingerprint(text: Column, k: int = K, s: int = S, anchors: int = ANCHORS) -> Column:
    """Array of bigint, ascending: 32 bits of an anchor's hash above 31 bits of its place.

    Equal texts have equal fingerprints.  A text of fewer than ``3 * k`` tokens
    also has the anchors of its characters; one without any anchor, such as the
    empty or null text, has one of its whole text.
    """
    text = F.coalesce(text, F.lit(""))
    whole = F.array(F.shiftrightunsigned(F.xxhash64(text), 64 - _HASH_BITS) * F.lit(1 << _PLACE_BITS))

    def of_tokens(h: Column) -> Column:
        characters = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.xxhash64(c))
        short = _let(characters, lambda c: _smallest(F.concat(_anchors(h, k, s), _anchors(c, k, s)), anchors))
        found = F.when(F.size(h) < 3 * k, short).otherwise(_smallest(_anchors(h, k, s), anchors))
        return _let(found, lambda some: F.when(F.size(some) > 0, some).otherwise(whole))

    return _let(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t)), of_tokens)


def _anchors(h: Column, k: int, s: int) -> Column:
    """Packed anchors of a sequence of token hashes, in order; none when it is shorter than ``k``."""
    span = k - s  # the last inner run begins this far from the first

    def of_inner(g: Column) -> Column:
        def anchor(i: Column) -> Column:
            ends = F.least(F.element_at(g, i), F.element_at(g, i + span))
            between = [F.element_at(g, i + j) for j in range(1, span)]
            mark = F.xxhash64(*[F.element_at(g, i + j) for j in range(0, span, s)], F.element_at(g, i + span))
            packed = F.shiftrightunsigned(mark, 64 - _HASH_BITS) * F.lit(1 << _PLACE_BITS) + i
            return F.when(ends <= F.least(*between), packed)

        every = F.transform(F.sequence(F.lit(1), F.size(g) - span), anchor)
        return F.filter(every, lambda a: a.isNotNull())

    inner = F.transform(F.sequence(F.lit(1), F.size(h) - (s - 1)), lambda i: F.xxhash64(*[F.element_at(h, i + j) for j in range(s)]))
    return F.when(F.size(h) >= k, _let(inner, of_inner)).otherwise(F.array().cast("array<bigint>"))


def _smallest(found: Column, anchors: int) -> Column:
    """Of anchors with equal hashes the first place, and the smallest of all."""
    def first_places(a: Column) -> Column:
        new = F.filter(a, lambda x, i: (i == 0) | (_mark(x) != _mark(F.element_at(a, F.greatest(i, F.lit(1))))))
        return F.slice(new, 1, anchors)

    return _let(F.sort_array(found), first_places)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def as_text(anchors: Column) -> Column:
    """A fingerprint as a string: 16 hexadecimal digits an anchor."""
    return F.array_join(F.transform(anchors, lambda a: F.lower(F.lpad(F.hex(a), 16, "0"))), "")


def _mark(anchor: Column) -> Column:
    return F.shiftright(anchor, _PLACE_BITS)


def _place(anchor: Column) -> Column:
    return anchor.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))


def likeness(a: Column, b: Column, anchors: int = ANCHORS) -> Column:
    """Share (0 to 1) of the anchors that both have and that moved together.

    Looks at the smallest anchors of both texts taken together, which estimates
    the likeness of all anchors; those in both count if their move from place to
    place lies near the median move.
    """
    marks_a, marks_b = F.transform(a, _mark), F.transform(b, _mark)
    smallest = F.slice(F.sort_array(F.array_union(marks_a, marks_b)), 1, anchors)

    def judged(together: Column) -> Column:
        shared = F.array_intersect(F.array_intersect(together, marks_a), marks_b)

        def moved(m: Column) -> Column:
            own = [F.filter(x, lambda y: F.array_contains(m, _mark(y))) for x in (a, b)]  # both ascending by hash
            return F.zip_with(*own, lambda p, q: _place(p) - _place(q))

        def close(m: Column) -> Column:
            middle = F.element_at(F.sort_array(m), F.floor((F.size(m) + 1) / 2).cast("int"))
            reach = F.greatest(*[F.array_max(F.transform(x, _place)) for x in (a, b)]) * DRIFT + 8
            return F.when(F.size(m) == 0, 0.0).otherwise(F.size(F.filter(m, lambda x: F.abs(x - middle) <= reach)) / F.size(together))

        return _let(_let(shared, moved), close)

    return _let(smallest, judged)


def _in_order(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, text) with a bucket: ranges of ids of about equal size, and a copy of each range's follower.

    The follower of a range is the first row of the next one, of the last range
    that of the first; copies have ``copy = 1`` and come last in their bucket.
    """
    n = 8 * partitions(documents.sparkSession)
    cuts = documents.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)])).first()[0] or []
    cuts = sorted(set(cuts))
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    bucket = F.when(F.col("doc_id").isNull(), -1).otherwise(F.size(F.filter(bounds, lambda c: c < F.col("doc_id"))))
    rows = documents.withColumn("bucket", bucket)
    firsts = sorted(rows.groupBy("bucket").agg(F.min("doc_id").alias("id")).collect(), key=lambda r: r["bucket"])  # a row a range
    if not firsts:
        return rows.withColumn("copy", F.lit(0))
    follows = [(r["bucket"], firsts[i - 1]["bucket"]) for i, r in enumerate(firsts)]
    ids = documents.sparkSession.createDataFrame(
        [(b, r["id"], before) for (b, before), r in zip(follows, firsts)], "own bigint, id bigint, before bigint")
    first = Window.partitionBy("own").orderBy("text")
    copies = (rows.join(F.broadcast(ids), (F.col("bucket") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("id")))
              .withColumn("r", F.row_number().over(first)).where("r = 1")
              .select("doc_id", "text", F.col("before").cast("int").alias("bucket")))
    return rows.withColumn("copy", F.lit(0)).unionByName(copies.withColumn("copy", F.lit(1)))


def edited_fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each text and of the text with its last quarter replaced by its follower's beginning.

    The follower is the next row by ascending id (then text), of the last row
    the first; a single row follows itself.  Null texts are empty, null ids come
    first.  Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.
    """
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("bucket").orderBy("copy", "doc_id", "text")
    marked = _in_order(rows).withColumn("anchors", fingerprint(F.col("text")))
    follower = (marked.withColumn("next_text", F.lead("text").over(order)).withColumn("next_anchors", F.lead("anchors").over(order))
                .where("copy = 0"))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", 1, n - quarter), F.substring("next_text", 1, quarter))
    ready = follower.select("doc_id", n.cast("bigint").alias("n_chars"), "anchors", "next_anchors", edited.alias("edited"))
    ready = ready.withColumn("edited_anchors", fingerprint(F.col("edited")))
    return ready.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("anchors")).alias("fingerprint"),
        as_text(F.col("edited_anchors")).alias("edited_fingerprint"), likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"))
