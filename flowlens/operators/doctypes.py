"""Document-type views over the rollup.

The catalog is a config table, broadcast; the
rollup side is never shuffled for the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def with_doc_catalog(ru: DataFrame, catalog: DataFrame) -> DataFrame:
    """Family defaults to 'Other', label falls back to the doc type."""
    # The planner does not know the size of a table made from a list.
    c = F.broadcast(catalog.select("doc_type", "label", "business_family"))
    return (ru.join(c, "doc_type", "left")
              .withColumn("family", F.coalesce("business_family", F.lit("Other")))
              .withColumn("doc_label", F.coalesce("label", "doc_type")))


def _sums():
    return [F.sum("txn_count").cast("bigint").alias("txns"),
            F.sum("failed_count").cast("bigint").alias("failed"),
            F.sum("rejected_count").cast("bigint").alias("rejected"),
            F.sum("duplicate_count").cast("bigint").alias("dupes"),
            F.sum("value_sum").cast("decimal(28,2)").alias("value_usd")]


def doc_type_grid(ru: DataFrame, catalog: DataFrame) -> DataFrame:
    """Volume, failed, rejected, dupes, value and ok % per doc type."""
    ok = F.round(F.lit(100.0) * (F.lit(1.0) - F.sum(F.col("failed_count") + F.col("rejected_count")).cast("double")
                                 / F.nullif(F.sum("txn_count").cast("double"), F.lit(0.0))), 1)
    return (with_doc_catalog(ru, catalog).groupBy("family", "doc_label", "doc_type")
            .agg(*_sums(), ok.alias("ok_pct")))


def family_summary(ru: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per family, with the number of distinct doc types."""
    return (with_doc_catalog(ru, catalog).groupBy("family")
            .agg(F.count_distinct("doc_type").alias("types"), *_sums()))


def family_subtotals(ru: DataFrame, catalog: DataFrame) -> DataFrame:
    """Family and doc-type subtotals in one ``rollup`` (grand total row included)."""
    return (with_doc_catalog(ru, catalog).rollup("family", "doc_type")
            .agg(*_sums(), F.grouping_id().alias("level")))


def family_trend(ru: DataFrame, catalog: DataFrame) -> DataFrame:
    """Family throughput per bucket."""
    return (with_doc_catalog(ru, catalog).groupBy("bucket", "family")
            .agg(F.sum("txn_count").cast("bigint").alias("txns")))


def type_by_partner(ru: DataFrame, catalog: DataFrame) -> DataFrame:
    """Doc type x partner volume."""
    return (with_doc_catalog(ru, catalog).groupBy("doc_label", "doc_type", "partner")
            .agg(F.sum("txn_count").cast("bigint").alias("txns")))


def type_by_protocol(ru: DataFrame, catalog: DataFrame) -> DataFrame:
    """Doc type x protocol volume."""
    return (with_doc_catalog(ru, catalog).groupBy("doc_label", "doc_type", "protocol")
            .agg(F.sum("txn_count").cast("bigint").alias("txns")))
