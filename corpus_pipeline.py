"""A document corpus prepared for training in five stages, each an operator of ``rareflow.llm``.

A stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; its result is written as Parquet and
read again for the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rareflow.llm import mixing, ngram_join, packing, preference, quality_rules, queries
from rareflow.llm.common import kept

#: Target weights of the mix: tempered row counts.
MIX = {"power": 0.5, "total": 1000}


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Bradley-Terry scorer puts at its threshold or above."""
    ranker = preference.learn(docs, queries.table(spark, sf_dir, "labels"))
    return preference.scored(docs, ranker, score_col="_score").where(F.col("_score") >= preference.CUT).drop("_score")


def divergence_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and stay near their language's histograms."""
    return quality_rules.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of similar documents; documents without a group stay. Rows that
    share an id stay or go together, and rows with a null id stay."""
    groups = ngram_join.similar_groups(docs, size=5, similarity=(80, 100))
    gone = groups.where("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: files and rows ascend by place."""
    placed = mixing.mix(docs, **MIX)
    return placed.repartitionByRange("position").sortWithinPartitions("position").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents at their places in sequences of 1024 tokens, which are numbered in the order of the mix.
    A table has no order of its own, so the places are found again: they follow from the rows."""
    placed = mixing.mix(docs, **MIX).select("doc_id", "text", "position")
    return packing.pack_in_order(placed, public_tokenizers.path(queries.BYTE_BPE), queries.END_ID, queries.SEQUENCE_TOKENS)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", divergence_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", packed),
]

#: A learnt classifier, hashes and a tokenizer decide about the rows, so SQL can't give them; the tests do it by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the packed pieces."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), "stage-" + name.split()[0])
    return docs
