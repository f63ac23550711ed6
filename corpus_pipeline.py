"""The corpus pipeline: quality classifier, language identification, exact dedup, n-gram Jaccard join, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. run() writes each result as
Parquet to the folder shared by driver and executors and reads it again for the next stage, so a lost executor costs one
stage at most. All stages but the last return the columns of documents; the last returns one row per packed piece.

Defined results: rows whose text is null or empty are scored by the first stage like all others and rejected by the second, as they
have no letter; an empty table gives empty results; extra columns are carried along until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locusweave.llm import content_sort, jaccard, language, packing, quality
from locusweave.llm.common import drop, stash, table
from locusweave.llm.queries import SIZE, tokenizer


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the boosted trees score at least quality.ACCEPT. Labels are learned from the training folds of labels only."""
    return quality.accept(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows in a learned language with a score of at least language.ACCEPT."""
    return language.accept(docs, language.learn(docs))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id, as in op9_exact_dedup."""
    return content_sort.keep_one(docs, keep="largest")


def near_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the row with the smallest doc_id."""
    return jaccard.keep_first(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece, with its sequence and place."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), SIZE)


STAGES = [("quality", good_quality), ("language", known_language), ("exact_dedup", distinct_texts), ("ngram_jaccard", near_distinct), ("packing", packed)]

#: Classifiers and tokenizers aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stash(stage(spark, docs, sf_dir), name)
        drop(before)
    return docs
