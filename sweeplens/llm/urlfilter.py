"""URL verdicts: host and path rules first, a model of segmented host and path words for the rest.

Model: host labels are split into words by a unigram Viterbi pass, path parts
are words as they are; multinomial naive Bayes over the hashed words, learnt
from the urls that the rules decide, judges the urls that no rule fits.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sweeplens.llm.shared import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 1 << 16  # hashed words of the classifier
SALTS = 16  # tasks that share the hosts with one short word, or the urls of one host
Rules = list[tuple[str, str]]


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for null and without ``://``.

    The host ends at the first ``/``, ``?`` or ``#`` and has A-Z lower-cased; the
    path goes on from there to the first ``?`` or ``#``.
    """
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return (_lower_ascii(F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))),
            F.coalesce(F.regexp_extract(url, pattern, 2), F.lit("")))


def matched_rule(host: Column, path: Column, rules: Rules) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null where none fits.

    A rule ``host/path`` fits the host itself and all its subdomains, if the
    url's path starts with the rule's.  Of equally long ones the first wins.
    """
    rule = verdict = F.lit(None).cast("string")
    for verdict_name, text in sorted(rules, key=lambda r: len(r[1])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict_name)).otherwise(verdict)
    return rule, verdict


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """All letter runs of all texts outside tags with their counts over all rows: a written table (word, count)."""
    plain = F.lower(F.regexp_replace(F.col(column), r"(?s)<[^>]*>", " "))
    each = texts.select(F.explode(F.split(plain, r"[^\p{L}]+")).alias("word")).where(F.length("word") > 0)
    return written(each.groupBy("word").count(), "words")


class Segmenter:
    """Most likely split of a name under independent word probabilities.

    ``counts`` has the words that can be in the name; ``total`` counts all words.
    """

    def __init__(self, counts: dict[str, int], total: int):
        self.score = {w: math.log(c / (total + 1)) for w, c in counts.items()}
        self.unknown = -math.log(total + 1)
        self.lengths = sorted({len(w) for w in counts})

    def split(self, name: str) -> tuple[str, ...]:
        """Viterbi over cut places; an unknown piece costs more the longer it is."""
        best = [(0.0, 0)] + [(-math.inf, 0)] * len(name)
        odd, begun = -math.inf, 0  # the best that ends in an unknown piece, and where that begins
        for end in range(1, len(name) + 1):
            if best[end - 1][0] + self.unknown > odd:
                odd, begun = best[end - 1][0] + self.unknown, end - 1
            odd -= 2.3
            best[end] = (odd, begun)
            for length in self.lengths:
                if length > end:
                    break
                score = self.score.get(name[end - length: end])
                if score is not None and best[end - length][0] + score >= best[end][0]:
                    best[end] = (best[end - length][0] + score, end - length)
        out, at = [], len(name)
        while at:
            out.append(name[best[at][1]: at])
            at = best[at][1]
        return tuple(reversed(out))


def pieces(host: str) -> list[str]:
    """Names and runs of digits of a host, in order."""
    return [p for label in re.split(r"[^0-9a-z\u0080-\U0010ffff]+", host) for p in re.findall(r"\d+|\D+", label)]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [pieces(h) for h in batch["host"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["host"], pa.array(lists, pa.list_(pa.string()))], names=["host", "pieces"])


def _parts(lengths: list[int]):
    """Distinct parts of each name, of the lengths that words have."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, parts = [], []
            for name in batch["name"].to_pylist():
                for length in lengths:
                    if length > len(name):
                        break
                    found = {name[at: at + length] for at in range(len(name) - length + 1)}
                    names += [name] * len(found)
                    parts += found
                    if len(parts) > 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.string())], names=["name", "part"])
                        names, parts = [], []
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.string())], names=["name", "part"])

    return run


def _split(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch["name"].to_pylist()
            lists = [Segmenter({k["word"]: k["count"] for k in known or []}, total).split(name)
                     for name, known in zip(names, batch["known"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["name"], pa.array(lists, pa.list_(pa.string()))], names=["name", "words"])

    return run


def segmented(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """Words of every distinct host (column ``host``): host, words; runs of digits are the word ``0``.

    The parts of each distinct name meet the counts of all words in a join, so
    that a name is split with the counts of its own parts and nothing is held
    whole.  Short words are in many names: their rows are dealt over ``SALTS``
    tasks.
    """
    listed = written(hosts.select("host").distinct().mapInArrow(_pieces, "host string, pieces array<string>"), "hosts")
    each = listed.select("host", F.posexplode("pieces").alias("place", "name"))
    digits = F.col("name").rlike(r"^\d")
    names = each.where(~digits).select("name").distinct()
    sizes = counts.select(F.length("word").alias("length"), "count").groupBy("length").agg(F.sum("count").alias("count")).collect()  # a row for each length
    salts = F.when(F.length("word") <= 3, SALTS).otherwise(1)
    words = counts.select("word", "count", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    parts = names.mapInArrow(_parts(sorted(r["length"] for r in sizes)), "name string, part string").withColumn(
        "salt", F.pmod(F.xxhash64("name"), F.when(F.length("part") <= 3, SALTS).otherwise(1)).cast("int"))
    known = parts.join(words, (parts["part"] == words["word"]) & (parts["salt"] == words["salt"])).groupBy("name").agg(
        F.collect_list(F.struct("word", "count")).alias("known"))
    total = sum(r["count"] for r in sizes)
    split = names.join(known, "name", "left").mapInArrow(_split(total), "name string, words array<string>")
    # a name like www is in many hosts
    salt = F.pmod(F.xxhash64("host"), F.lit(SALTS)).cast("int")
    dealt = written(split, "split").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    filled = each.withColumn("salt", salt).join(dealt, ["name", "salt"], "left").select("host", "place", F.when(digits, F.array(F.lit("0"))).otherwise(F.col("words")).alias("words"))
    together = filled.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "words"))).alias("all"))
    return listed.select("host").join(together, "host", "left").select("host", F.coalesce(F.flatten(F.transform("all", lambda x: x["words"])), F.array().cast("array<string>")).alias("words"))


def _bucket(term: str) -> int:
    value = 0xCBF29CE484222325
    for byte in term.encode():
        value = ((value ^ byte) * 0x100000001B3) & (2**64 - 1)
    return (value >> 20) % BUCKETS


def terms(words: list[str], path: str) -> list[str]:
    """Words of the host (marked ``h:``) and of the path (``p:``); runs of digits become ``0``."""
    found = [f"h:{w}" for w in words]
    for piece in re.findall(r"[0-9]+|[^\W\d_]+", path.lower()):
        found.append("p:0" if piece[0].isdigit() else f"p:{piece}")
    return found


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bucket = lru_cache(200_000)(_bucket)
    for batch in batches:
        lists = [[bucket(t) for t in terms(w, p)] for w, p in zip(batch["words"].to_pylist(), batch["path"].to_pylist())]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("_id", "host", "path")), pa.array(lists, pa.list_(pa.int32()))],
                                         names=["_id", "host", "path", "terms"])


def judge(pages: DataFrame, rules: Rules, id_col: str = "page_id", url_col: str = "url",
          corpus: tuple[DataFrame, str] | None = None) -> DataFrame:
    """Verdict per url: columns ``id_col``, host, path, rule, verdict, score.

    ``rules`` are (allow | block, ``host/path``).  ``score`` is the model's
    log-odds for block (0 without any learnt class); urls without a rule are
    blocked if it is positive.  Segmenter words are all words of ``corpus``
    (table, text column).  Null and unusable urls have empty host and path and
    are judged like others; repeated rows and ids stay.  Learns from all urls
    that a rule decides; an empty table gives an empty result.  A very long host
    or path is split like any other; ``id_col`` may not be called like a column
    of the result.
    """
    if id_col.lower() in ("host", "path", "rule", "verdict", "score"):
        raise ValueError(f"the result has a column {id_col} of its own")
    spark = pages.sparkSession
    host, path = parts(F.col(url_col))
    base = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    table, column = corpus or (pages, url_col)
    words = segmented(base, word_counts(table, column)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = base.withColumn("salt", F.pmod(F.xxhash64("_id", "path"), F.lit(SALTS)).cast("int"))
    hashed = salted.join(words, ["host", "salt"]).select("_id", "host", "path", "words").mapInArrow(
        _hashed, base.select("*", F.array(F.lit(0)).alias("terms")).schema)
    hashed = written(hashed.select("*", rule.alias("rule"), verdict.alias("given")), "urls")
    # at most one row a bucket and class, combined before the shuffle
    counted = (hashed.where("given is not null").select("given", F.explode_outer("terms").alias("term"))
               .groupBy("given", "term").count().collect())
    rows = dict(hashed.where("given is not null").groupBy("given").count().collect())
    weight, prior = _weights(counted, rows)
    shared = spark.sparkContext.broadcast(weight)

    @F.pandas_udf("double")
    def score(lists):
        w = shared.value
        return lists.map(lambda x: float(w[np.asarray(x, dtype=np.int64)].sum()) + prior)

    scored = hashed.withColumn("score", score("terms"))
    own = F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(F.col("_id").alias(id_col), "host", "path", "rule",
                         F.coalesce("given", own).alias("verdict"), "score")


def _weights(counted: list, rows: dict[str, int]) -> tuple[np.ndarray, float]:
    """Log-odds of block per bucket, and of the classes themselves; zeros unless both classes occur."""
    counts = {c: np.zeros(BUCKETS) for c in ("allow", "block")}
    for r in counted:
        if r["term"] is not None:
            counts[r["given"]][r["term"]] += r["count"]
    if len(rows) < 2:
        return np.zeros(BUCKETS), 0.0
    seen = counts["allow"] + counts["block"] > 0
    share = {c: np.log((v + 0.5) / (v.sum() + 0.5 * seen.sum())) for c, v in counts.items()}
    return np.where(seen, share["block"] - share["allow"], 0.0), math.log(rows["block"] / rows["allow"])
