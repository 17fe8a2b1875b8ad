"""The corpus pipeline: documents to shards of a training mix.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and
returns a DataFrame; ``run`` writes each stage's rows as Parquet and reads them again as
the next one's docs.  All stages but the last return the columns of docs.

The stages' own decisions on nulls, empty texts and repeated rows are those of the
operators (see their modules): the quality rules drop documents without words; the
decontamination stage names rows by their text, so that rows without a doc_id are judged like others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import decontam, mixing, neardup, quality_rules, sharding
from flowlens.llm.common import Store, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighted rules judge good stay."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.8 or more) stays."""
    return neardup.keep_one(docs, 80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go, with or without a doc_id."""
    key = F.sha2(docs["text"], 256)
    found = decontam.leaks(docs.select(key.alias("doc_id"), "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))
    leaked = found.select(F.col("doc_id").alias("leaked_text")).distinct()
    return docs.join(leaked, key == leaked["leaked_text"], "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as many times as the mix takes it."""
    return mixing.repeat_rows(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot."""
    return sharding.place_rows(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shards),
]

#: The stages' models and sketches have no SQL form; tests hold each stage, on its own input, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
