"""File / interchange reconciliation (J2, A23, F12, J17, SNK3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.timeutil import as_of_col

FILE_COLUMNS = ["interchange_id", "file_name", "environment", "partner", "channel", "protocol", "direction",
                "received_at", "completed_at", "status", "reason_category", "declared_txn_count",
                "isa_control", "gs_control", "value_usd", "kchar"]


def files_missing_txns(files: DataFrame, ev: DataFrame) -> DataFrame:
    """Declared transaction count vs child rows at stage 'received'.

    The child side is aggregated per interchange first (partial aggregation),
    so the join is one-to-one and a file with millions of children costs one
    row in the join.
    """
    j = with_children(files.filter(F.col("declared_txn_count").isNotNull()), ev)
    return (j.filter(F.col("declared_txn_count") > F.col("actual_txns"))
             .select("interchange_id", "file_name", "partner", "direction", "declared_txn_count", "actual_txns",
                     (F.col("declared_txn_count") - F.col("actual_txns")).alias("missing_inside_file")))


def with_children(files: DataFrame, ev: DataFrame) -> DataFrame:
    """The files with the number of their child rows at stage 'received' (``actual_txns``)."""
    children = (ev.groupBy("interchange_id")
                  .agg(F.count_if(F.col("stage") == "received").alias("_received")))
    return files.join(children, "interchange_id", "left").withColumn(
        "actual_txns", F.coalesce("_received", F.lit(0))).drop("_received")


def file_feed(files: DataFrame, as_of=None, hours: int = 24) -> DataFrame:
    """Files received in the last ``hours`` by direction x status."""
    since = F.timestamp_add("HOUR", F.lit(-hours), as_of_col(as_of))
    return (files.filter(F.col("received_at") >= since).groupBy("direction", "status")
                 .agg(F.count(F.lit(1)).alias("files"),
                      F.sum("declared_txn_count").alias("txns"),
                      F.sum("kchar").cast("decimal(28,2)").alias("kchar")))


def rejected_at_receipt(files: DataFrame) -> DataFrame:
    """files rejected at receipt (never parsed)."""
    return (files.filter(F.col("status") == "rejected")
                 .select("interchange_id", "file_name", "partner", "channel", "received_at", "reason_category"))


def file_explorer(files: DataFrame) -> DataFrame:
    """SRC2: file explorer columns."""
    return files.select("interchange_id", "file_name", "direction", "partner", "channel", "protocol",
                        "received_at", "completed_at", "status", "reason_category", "declared_txn_count", "kchar")


def file_children(ev: DataFrame, files: DataFrame) -> DataFrame:
    """Child transactions of the chosen files (semi join on interchange)."""
    return ev.join(files.select("interchange_id"), "interchange_id", "left_semi")


def upsert_files(batch: DataFrame, target: DataFrame) -> DataFrame:
    """SNK3: receipt rows inserted when absent, later rows update declared count,
    controls, status, reason and completion; other columns keep the first value.

    A batch may hold several rows of an interchange (its receipt and its parse):
    it is reduced to one row per interchange first, in the order of completion.
    """
    upd = ["status", "reason_category", "declared_txn_count", "isa_control", "gs_control", "completed_at"]
    at = F.struct(F.col("completed_at").isNotNull(), "completed_at", "received_at")
    said = lambda c: F.when(F.col(c).isNotNull(), at)
    b = batch.groupBy("interchange_id").agg(*[
        (F.max_by(c, said(c)) if c in upd else F.min_by(c, said(c))).alias(c)
        for c in FILE_COLUMNS if c != "interchange_id"])
    b = b.select(*[F.col(c).alias("b_" + c) for c in FILE_COLUMNS])
    t = target.select(*[F.col(c).alias("t_" + c) for c in FILE_COLUMNS])
    j = t.join(b, t.t_interchange_id.eqNullSafe(b.b_interchange_id), "full_outer")
    cols = []
    for c in FILE_COLUMNS:
        if c in upd:
            cols.append(F.coalesce("b_" + c, "t_" + c).alias(c))
        else:
            cols.append(F.coalesce("t_" + c, "b_" + c).alias(c))
    return j.select(*cols)
