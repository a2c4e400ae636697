"""Corpus pipeline over ``documents``: each stage keeps, cuts or rewrites what the stage before it kept.

Defined results: a document with a null or empty text has nothing to judge and passes every stage with no tokens; a
document that loses all its lines goes; rows that share an id share the decisions on that id; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyflow.llm import bpe, decontamination, line_dedup, ngram_jaccard, toxicity
from storyflow.llm.common import Scratch, ready, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, does not reject."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document or line already has; n_chars follows the text."""
    ready(spark)
    cut = line_dedup.without_repeated_lines(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of near copies: five-word shingles, Jaccard 0.8 or more."""
    ready(spark)
    groups = ngram_jaccard.near_copies(docs.select("doc_id", "text"), ngram_jaccard.Settings(words=5, percent=80))
    copies = groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_copy")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"))
    return rows.join(copies, F.col("_id").eqNullSafe(F.col("_copy")), "left_anti").select("_row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every kept document, with digests of the ids and of the decoded text."""
    ready(spark)
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("ngram_jaccard", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", tokenize),
]

#: The stages fit models and follow links between documents, which SQL cannot express; tests/llm checks them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each stage's result is stored and read again as the next one's documents."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        kept = scratch.keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            before.drop()
        docs, before = kept.df, kept
    return docs
