"""The queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowlens.llm import (chat, decontam, mixing, neardup, periodic, pii, quality_model, quality_rules, search, sharding, substring,
                          token_counts, toxicity)
from flowlens.llm.common import read


def op1_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op1_minimax_shards(read(spark, sf_dir, "documents", "doc_id", "text"))


def op2_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.op2_odd_sketches(read(spark, sf_dir, "documents", "doc_id", "text"))


def op3_simhash_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op3_simhash_leaks(read(spark, sf_dir, "documents", "doc_id", "text"),
                                      read(spark, sf_dir, "benchmark", "item_id", "text"))


def op4_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op4_weak_supervision(read(spark, sf_dir, "documents", "doc_id", "text"))


def op5_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op5_entropy_mix(read(spark, sf_dir, "documents", "doc_id", "source", "text"))


def op6_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op6_factorization_machine(read(spark, sf_dir, "documents", "doc_id", "text"),
                                              read(spark, sf_dir, "labels", "doc_id", "toxic"))


def op7_subword_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.op7_subword_embeddings(read(spark, sf_dir, "documents", "doc_id", "text"),
                                                read(spark, sf_dir, "labels", "doc_id", "quality"))


def op8_fm_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.op8_fm_passages(read(spark, sf_dir, "documents", "doc_id", "text"))


def op9_prefix_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op9_prefix_examples(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op10_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.op10_section_tokens(read(spark, sf_dir, "documents", "doc_id", "text"))


def op11_max_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.op11_max_sketches(read(spark, sf_dir, "documents", "doc_id", "text"),
                                    read(spark, sf_dir, "benchmark", "item_id", "text"))


def op12_branching_tandems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.op12_branching_tandems(read(spark, sf_dir, "documents", "doc_id", "text"))


def op13_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op13_deobfuscation(read(spark, sf_dir, "documents", "doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_minimax_shards, op2_odd_sketches, op3_simhash_leaks, op4_weak_supervision, op5_entropy_mix,
        op6_factorization_machine, op7_subword_embeddings, op8_fm_passages, op9_prefix_examples, op10_section_tokens,
        op11_max_sketches, op12_branching_tandems, op13_deobfuscation, pipeline)}

ORACLES: dict[str, str] = {"op9_prefix_examples": chat.ORACLE_SQL, "op11_max_sketches": search.ORACLE_SQL}
