"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on every row that the one before it kept and returns a DataFrame; all
but the last return the columns of documents. Null or empty texts fail the quality rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import langid, minhash, mixing, packing, quality
from tidelog.session import Scratch

#: Share of the tokens that mixing keeps, and powers that its targets raise each category's tokens to.
FRACTION, SOURCE_POWER, LANG_POWER, TOPIC_POWER = 0.8, 0.7, 0.8, 0.9
#: Percentage of shingles that near duplicates share at least.
NEAR = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base conditions and all rules of the threshold table."""
    return quality.passing(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to a language's centroid, by a model fitted on this stage's own labelled documents."""
    return langid.accepting(docs, langid.learnt_from(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id in each group of near duplicates."""
    return minhash.deduplicated(docs, NEAR)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that expected tokens meet tempered shares of sources, languages and topics."""
    mixed = mixing.mixed(docs, FRACTION, None, SOURCE_POWER, TOPIC_POWER, LANG_POWER)
    return mixed.where("sampled").select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of 4096 tokens."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Neither signatures nor tokens can be had in SQL; tests hold run() against a plain version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
