"""A corpus pipeline of the operators: quality, near copies, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir).  For all of them: a null text is an empty one; very long texts are
processed whole; rows that repeat an id, or have none, are judged or carried each by itself unless a stage says otherwise; an empty
table gives an empty result; further columns go along untouched, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import kernel, mixing, ngram_join, packing, quality_model, substrings


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    A row's score depends on its text alone, so equal texts, ties included, stay or go together; an empty text is scored like others.
    Without usable labels all rows have one score.
    """
    return quality_model.accepted_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays.

    Rows of that id all stay, also repeated ones; rows with a null id stay; texts without words are copies of nothing.
    """
    return ngram_join.distinct_documents(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that occur elsewhere are taken out.

    Every row stays, if need be with an empty text; a null text stays null.  Of equal texts each loses all repeated words.
    """
    return substrings.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are drawn to their targets; a document that is drawn twice has two rows.

    Documents without words, null texts among them, have nothing to draw and go.  A null source is a source of its own, the last one.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row for each piece of each row, whose ids may be null or repeated; an empty text is its end token."""
    return packing.packed_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_classifier", keep_quality), ("ngram_jaccard_join", keep_distinct), ("substring_dedup", cut_repeats), ("mixing", mix), ("best_fit_packing", pack)]

#: Scores of trees, hashes of draws and token identifiers are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = kernel.stored(stage(spark, docs, sf_dir), name)
    return docs
