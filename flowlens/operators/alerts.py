"""Alerts as tables (AL1-AL8): each alert is a count, evaluated ``value > 0``.

All counts are computed as one-row aggregates and unpivoted into
(alert, value, threshold, fired) rows; the caller schedules and delivers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.timeutil import as_of_col, trunc_ntz
from flowlens.operators import files as fi
from flowlens.operators import monitors as mo
from flowlens.operators import sla


def _counts(df: DataFrame, **conditions: Column) -> DataFrame:
    """One pass over a source: (alert, value) rows, one for each condition's count; names have _ for blanks."""
    values = df.agg(*[F.count_if(c).cast("bigint").alias(n) for n, c in conditions.items()])
    return values.select(F.explode(F.array(*[F.struct(F.lit(n.replace("_", " ")).alias("alert"), F.col(n).alias("value"))
                                             for n in conditions])).alias("a")).select("a.*")


def rejected_last_hour(ru: DataFrame, as_of=None) -> DataFrame:
    """AL4: rejected messages in buckets from the last full hour on."""
    since = F.timestamp_add("HOUR", F.lit(-1), trunc_ntz("hour", as_of_col(as_of)))
    return (ru.filter(F.col("bucket") >= since)
              .agg(F.coalesce(F.sum("rejected_count"), F.lit(0)).cast("bigint").alias("value"))
              .select(F.lit("Rejected message").alias("alert"), "value"))


def evaluate(counts: list[DataFrame], threshold: int = 0) -> DataFrame:
    """AL7: one row per alert with its value and whether ``value > threshold`` fired."""
    u = counts[0]
    for c in counts[1:]:
        u = u.unionByName(c)
    return u.select("alert", "value", F.lit(threshold).alias("threshold"), (F.col("value") > threshold).alias("fired"))


def alert_table(ev: DataFrame, ru: DataFrame, files: DataFrame, feeds: DataFrame, endpoints: DataFrame,
                pipelines: DataFrame, acks: DataFrame, as_of=None) -> DataFrame:
    """AL1-AL8 evaluated together; each source is read once."""
    now = as_of_col(as_of)
    all_rows = F.lit(True)
    expiring = F.col("cert_expires_at").cast("timestamp_ntz") < F.timestamp_add("DAY", F.lit(7), now)
    at_risk = sla.at_risk_tenders(ev, as_of, 24, 30, trigger=("204", "out"), response=("990", "in"), key="interchange_id")
    counts = [
        _counts(mo.hung_pipelines(pipelines), Hung_pipeline=all_rows),
        _counts(mo.missing_feeds(feeds, as_of), Missing_feed=all_rows),
        _counts(endpoints, Channel_down=F.col("status") != "up", Cert_expiring=expiring),
        rejected_last_hour(ru, as_of),
        _counts(at_risk, **{"At-risk_response": all_rows}),
        _counts(acks, Missing_ack=F.col("fa_state") == "missing"),
        _counts(fi.with_children(files, ev), Rejected_at_receipt=F.col("status") == "rejected",
                Missing_inside_file=F.col("declared_txn_count") > F.col("actual_txns")),
    ]
    return evaluate(counts)
