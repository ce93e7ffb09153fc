"""The queries opN_<name> over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import chat, langid, minhash, mixing, packing, quality, sharding, tokenfiles, vectors, warc


def _over(table: str, query: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": _over("documents", mixing.query),
        "op10_embedding_dedup": _over("embeddings", vectors.query),
        "op2_warc": _over("pages", warc.query),
        "op3_quality_rules": _over("documents", quality.query),
        "op4_minhash_dedup": _over("documents", minhash.query),
        "op5_sharding": _over("documents", sharding.query),
        "op6_best_fit_packing": _over("documents", packing.query),
        "op7_language_id": _over("documents", langid.query),
        "op8_chat_formatting": _over("conversations", chat.query),
        "op9_token_counts": _over("documents", tokenfiles.query),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": warc.sql(), "op3_quality_rules": quality.sql(), "op4_minhash_dedup": minhash.sql(), "op8_chat_formatting": chat.sql()}
