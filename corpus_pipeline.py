"""The corpus pipeline: toxicity, quality rules, near-duplicates, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common, neardup, packing, quality, token_counts, toxicity


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold; the lexicon is learned from those of docs that have a label."""
    return toxicity.keep(docs, common.table(spark, sf_dir, "labels"))


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep(docs, common.table(spark, sf_dir, "labels"))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class, whatever its ids: null and repeated ones take part like all others."""
    return neardup.keep(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes by its number of BPE tokens: bucket, batch and place."""
    counts = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(counts.select("doc_id", "n_tokens"), "n_tokens", "doc_id")


STAGES = [("toxicity", _toxicity), ("quality rules", _quality), ("near-dedup", _near_dedup), ("packing", _packing)]

#: A learned lexicon, certified cutoffs and sampled candidates are no SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
