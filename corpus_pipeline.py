"""From documents to packed sequences: toxicity, near copies, repeated passages, mixture, packing.

Each stage works on all that the one before it kept.  ``run`` writes what a
stage returns into the shared scratch folder and reads it again for the next.

All but the last stage return the columns they were given, whatever others there
are beside those of ``documents``; columns that a stage makes for itself get
another name where theirs is taken.  Null, empty and very long texts, null ids
and sources, repeated rows and ties have one result each, which the stage states;
an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sweeplens.llm import jaccard, mixing, packing, passages, toxicity
from sweeplens.llm.queries import tokenizer_path
from sweeplens.llm.shared import written

ORACLE_SQL = None  # learnt scores, hash-drawn blocks and tokenizers have no SQL form


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a factorization machine, learnt from the labels, does not reject.

    Empty texts have the score of a text without terms; without labels all stay.
    Equal texts have equal scores.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.accepted(docs, model)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by four fifths of their five-word shingles.

    That with the smallest id stays, of equal rows one; texts without words and
    groups of null ids alone stay whole.
    """
    return jaccard.one_each(docs, jaccard.Rule(words=5, over=80, under=100))


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of fifty words and more that an earlier one has.

    Earlier is a smaller id; rows without an id go by a hash of their text.  Null
    and short texts are left as they are; a document may end up empty and stays.
    """
    return passages.removed(docs, passages.repeated(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source whole, small ones repeated up to one and a half times.

    A null source is a source; equal rows come and go together; documents without
    words appear once.
    """
    return mixing.mix(docs, max_repetition=1.5).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences of 2048.

    Null and empty texts are one piece, the end id; long ones are cut; rows that
    repeat are packed each for itself.
    """
    return packing.pack(packing.pieces(docs, tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", without_near_copies),
    ("substring_dedup", without_repeated_passages),
    ("source_mixing", mixed),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
