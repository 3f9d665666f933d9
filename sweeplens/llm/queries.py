"""The registered query of each operator of this package, and SQL twins where SQL can say the same."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweeplens.llm import bpe, jaccard, lexical, mixing, packing, passages, periods, quality, syncmers, tokenfile, topk, toxicity, urlfilter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weights of all documents and the draw of as large a share as the labels call good."""
    return quality.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles overlap by nine tenths of their union."""
    found = jaccard.classes(_table(spark, sf_dir, "documents"), jaccard.Rule(words=3, over=90, under=100))
    return found.select("doc_id", "n_shingles", "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents; labels of held-out ids are not learnt from."""
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(documents, labels.where(~toxicity.held_out(F.col("doc_id"))))
    found = toxicity.scored(documents, model, keep=["doc_id"])
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                        F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack(packing.pieces(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level token ids of all documents, written to frame files and read back."""
    manifest = tokenfile.write(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return tokenfile.read(manifest)


def op6_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return syncmers.edited_fingerprints(_table(spark, sf_dir, "documents"))


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url; segmenter words come from the pages themselves."""
    pages = _table(spark, sf_dir, "pages")
    return urlfilter.judge(pages, RULES, corpus=(pages, "html"))


def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in a mixture in which every source appears whole and none more than one and a half times."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), max_repetition=1.5)
    return mixed.select("doc_id", "source", "epoch", "mix_key")


def op9_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of fifty words and more that a document shares with an earlier one."""
    return passages.merged(passages.repeated(_table(spark, sf_dir, "documents")))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best integer inner products of every fiftieth vector among all vectors."""
    vectors = topk.quantised(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("id % 50 = 0"), k=5)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all documents, and of the bytes those ids decode to."""
    import public_tokenizers

    ranks = bpe.read_ranks(tokenizer_path("byte_bpe_50k.tiktoken"))
    found = bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_bytes=True)
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents of every benchmark item."""
    return lexical.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """Word numbers of a text of ``n`` words whose tail repeats one period, for a tenth of the ids."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return np.concatenate((np.arange(a), a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of all documents, a tenth of them with a repeated tail."""
    found = periods.runs(_table(spark, sf_dir, "documents"), order=repeated_tail, digest=True)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    length = -F.col("best.less")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"),
        F.col("best.period").alias("period"), F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"))


QUERIES["op1_importance_resampling"] = op1_importance_resampling
QUERIES["op2_jaccard_join"] = op2_jaccard_join
ORACLES["op2_jaccard_join"] = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as t
  from documents
), s as (
  select distinct doc_id, unnest(case when len(t) = 0 then []::varchar[] when len(t) < 3 then [array_to_string(t, ' ')]
                                 else list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) end) as g
  from w
), n as (select doc_id, count(*) as n from s group by doc_id), o as (
  select a.doc_id as x, b.doc_id as y, count(*) as o from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
), l as (
  select x, y from o join n p on p.doc_id = x join n q on q.doc_id = y where 100 * o.o >= 90 * (p.n + q.n - o.o)
), e as (select x, y from l union select y, x from l), r as (
  select x, y from e union select r.x, e.y from r join e on r.y = e.x
)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) as component_id
from documents d left join n using (doc_id) left join (select x, min(y) as y from r group by x) m on m.x = d.doc_id
"""
QUERIES["op3_toxicity"] = op3_toxicity
QUERIES["op4_best_fit_packing"] = op4_best_fit_packing
QUERIES["op5_token_files"] = op5_token_files
QUERIES["op6_syncmer_fingerprints"] = op6_syncmer_fingerprints
QUERIES["op7_url_filter"] = op7_url_filter
QUERIES["op8_temperature_mixing"] = op8_temperature_mixing
QUERIES["op9_compact_windows"] = op9_compact_windows
QUERIES["op10_exact_top_k"] = op10_exact_top_k
ORACLES["op10_exact_top_k"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id,
         cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
  where q.vec_id % 50 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as r from scored
)
select query_id, cast(r as integer) as rank, vec_id, score from ranked where r <= 5
"""
QUERIES["op11_byte_bpe"] = op11_byte_bpe
QUERIES["op12_ranked_search"] = op12_ranked_search
ORACLES["op12_ranked_search"] = r"""
with d as (
  select row_number() over () as row, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t
  from documents
), i as (
  select row_number() over () as item, item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t
  from benchmark
), totals as (
  select count(*) as n_docs, sum(len(t))::bigint as n_terms from d where len(t) > 0
), asked as (
  select item, term, count(*) as times from (select item, unnest(t) as term from i) group by 1, 2
), p as (
  select row, term, count(*) as tf from (select row, unnest(t) as term from d) where term in (select term from asked) group by 1, 2
), w as (
  select term, cast(floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1))) as bigint) as w from p, totals group by term, n_docs
), m as (
  select row, 100 - 75 + ((75 * len(t)::bigint * n_docs) // n_terms) as m from d, totals where len(t) > 0
), s as (
  select a.item, p.row, sum(a.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m.m)))::bigint as score
  from asked a join p using (term) join w using (term) join m using (row) group by 1, 2
), ranked as (
  select item_id, row_number() over (partition by item order by score desc, doc_id) as rank, doc_id, score
  from s join d using (row) join i using (item) where score > 0
)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 10
"""
QUERIES["op13_periodic_runs"] = op13_periodic_runs
