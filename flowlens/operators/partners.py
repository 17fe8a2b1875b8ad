"""Partner views: partner 360 (J8, A30, A31) and period-over-period activity.

Each side is pre-aggregated to one row per (environment, partner) before the
left joins, so the joins are one-to-one and tiny; Catalyst does not push
aggregates through outer joins, so the order is written out here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.timeutil import MICROS_PER_HOUR, as_of_col, breached, micros_between, pct

KEYS = ["environment", "partner"]


def partner_current(ev: DataFrame, as_of=None) -> DataFrame:
    """Refs, exceptions, duplicates, open, breaching, last seen."""
    now = as_of_col(as_of)
    return ev.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("refs"),
        F.count_if(F.col("status").isin("failed", "rejected")).alias("exceptions"),
        F.count_if(F.col("status") == "duplicate").alias("duplicates"),
        F.count_if(~F.col("terminal")).alias("open_refs"),
        F.count_if(breached(now)).alias("breaching"),
        F.max("event_time").alias("last_seen"))


def partner_rollup_sla(ru: DataFrame) -> DataFrame:
    """Txns and breached from the rollup."""
    return ru.groupBy(*KEYS).agg(F.sum("txn_count").alias("txns"), F.sum("breached_count").alias("breached"))


def partner_current_at_risk(ev: DataFrame, penalty: DataFrame, as_of=None) -> DataFrame:
    """A30 with J7's dollars: one pass over the messages to (environment, partner, document type),
    where the few penalties join, then one row per (environment, partner)."""
    now = as_of_col(as_of)
    docs = ev.groupBy(*KEYS, "doc_type").agg(
        F.count(F.lit(1)).alias("refs"),
        F.count_if(F.col("status").isin("failed", "rejected")).alias("exceptions"),
        F.count_if(F.col("status") == "duplicate").alias("duplicates"),
        F.count_if(~F.col("terminal")).alias("open_refs"),
        F.count_if(breached(now)).alias("breaching"),
        F.max("event_time").alias("last_seen"))
    fees = penalty.groupBy("partner", "doc_type").agg(F.sum("penalty_usd").alias("_fee"))
    sums = [F.sum(c).alias(c) for c in ("refs", "exceptions", "duplicates", "open_refs", "breaching")]
    return docs.join(fees, ["partner", "doc_type"], "left").groupBy(*KEYS).agg(
        *sums, F.max("last_seen").alias("last_seen"),
        F.sum(F.col("exceptions") * F.col("_fee")).cast("decimal(28,2)").alias("dollars_at_risk"))


def partner_360(ev: DataFrame, ru: DataFrame, penalty: DataFrame, profile: DataFrame,
                anomaly: DataFrame, as_of=None) -> DataFrame:
    """One row per (environment, partner) with the whole integration health."""
    now = as_of_col(as_of)
    cur = partner_current_at_risk(ev, penalty, as_of)
    s = partner_rollup_sla(ru)
    pr = profile.select("partner", "tier", "onboarding_status", "region")
    qa = anomaly.select(*KEYS, F.col("status").alias("qa_status"), F.col("silent_feeds").alias("qa_silent"),
                        F.col("abnormal_feeds").alias("qa_abnormal"))
    j = (cur.join(s, KEYS, "left").join(pr, "partner", "left").join(qa, KEYS, "left"))
    sla_pct = F.round(F.lit(100.0) * (F.lit(1.0) - F.col("breached").cast("double")
                                      / F.nullif(F.col("txns").cast("double"), F.lit(0.0))), 2)
    return j.select(
        "environment", "partner", "tier", "onboarding_status", "region", "refs", "exceptions",
        pct(F.col("exceptions"), F.col("refs")).alias("exception_pct"),
        pct(F.col("duplicates"), F.col("refs")).alias("duplicate_pct"),
        "open_refs", "breaching", sla_pct.alias("sla_pct"),
        F.coalesce(F.col("dollars_at_risk"), F.lit(0).cast("decimal(28,2)")).alias("dollars_at_risk"),
        "last_seen",
        (micros_between(F.col("last_seen"), now) / F.lit(float(MICROS_PER_HOUR))).alias("hours_since_seen"),
        F.coalesce("qa_status", F.lit("Normal")).alias("anomaly_status"),
        F.coalesce("qa_silent", F.lit(0).cast("bigint")).alias("silent_feeds"),
        F.coalesce("qa_abnormal", F.lit(0).cast("bigint")).alias("abnormal_feeds"))


def partner_activity(ru: DataFrame, as_of=None, days: int = 7) -> DataFrame:
    """Last ``days`` vs the ``days`` before, per partner, % change.

    One scan of the last 2 x ``days`` of the rollup with conditional sums
    (instead of two scans and a join); partners with no rows in the current
    window are dropped, as in the reference's left join from the current side.
    """
    now = as_of_col(as_of)
    start_cur = F.timestamp_add("DAY", F.lit(-days), now)
    start_prv = F.timestamp_add("DAY", F.lit(-2 * days), now)
    b = F.col("bucket")
    is_cur = b >= start_cur
    g = (ru.filter(b >= start_prv).groupBy("partner").agg(
        F.count_if(is_cur).alias("_n"),
        F.sum(F.when(is_cur, F.col("txn_count"))).alias("volume"),
        F.sum(F.when(is_cur, F.col("failed_count") + F.col("rejected_count"))).alias("exceptions"),
        F.sum(F.when(~is_cur, F.col("txn_count"))).alias("_prv")))
    change = F.round(F.lit(100.0) * (F.col("volume") - F.col("_prv")).cast("double")
                     / F.nullif(F.col("_prv").cast("double"), F.lit(0.0)))
    return g.filter(F.col("_n") > 0).select("partner", F.col("volume").cast("bigint").alias("volume"),
                                            F.col("exceptions").cast("bigint").alias("exceptions"),
                                            change.alias("pct_change"))
