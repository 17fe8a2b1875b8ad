"""Exception queues, failure diagnostics and the resolution knowledge base
(F10, F11, A12-A15, J6, J7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.timeutil import as_of_col, round_minutes

EXC = ("failed", "rejected")
# Reasons the older attribution rule charges to the partner.
PARTNER_REASONS_OLD = ("bad_input_file", "rejected_by_partner", "duplicate")


def _exceptions(ev: DataFrame) -> DataFrame:
    return ev.filter(F.col("status").isin(*EXC))


def exception_queue(ev: DataFrame, as_of=None) -> DataFrame:
    """failed / rejected messages, reason defaulted to 'unknown', age."""
    now = as_of_col(as_of)
    return _exceptions(ev).select(
        "event_time", "business_ref", "partner", "doc_type", "channel", "environment", "status",
        F.coalesce("reason_category", F.lit("unknown")).alias("reason_category"), "value_usd",
        round_minutes(F.col("event_time"), now).alias("age_min"))


def lob_exceptions(ev: DataFrame, as_of=None) -> DataFrame:
    """LOB exception queue with stage, error code default '', replays, comments."""
    now = as_of_col(as_of)
    comments = F.col("payload") if "payload" in ev.columns else F.lit(None).cast("string")
    return _exceptions(ev).select(
        "lob", "event_time", "business_ref", "partner", "doc_type", "stage", "status",
        F.coalesce("reason_category", F.lit("unknown")).alias("reason_category"),
        F.coalesce("error_code", F.lit("")).alias("error_code"), "replay_count",
        comments.alias("comments"),
        round_minutes(F.col("event_time"), now).alias("age_min"))


def exceptions_by_reason(ev: DataFrame) -> DataFrame:
    """Occurrences and value exposed per reason."""
    return (_exceptions(ev).groupBy(F.coalesce("reason_category", F.lit("unknown")).alias("reason_category"))
            .agg(F.count(F.lit(1)).alias("occurrences"),
                 F.sum("value_usd").cast("decimal(28,2)").alias("value_exposed")))


def failure_signatures(ev: DataFrame) -> DataFrame:
    """(reason, code, stage, partner) clusters with onset, latest, distinct refs."""
    return (_exceptions(ev).filter(F.col("reason_category").isNotNull())
            .groupBy("reason_category", "error_code", "stage", "partner")
            .agg(F.count(F.lit(1)).alias("occurrences"), F.min("event_time").alias("onset"),
                 F.max("event_time").alias("latest"), F.count_distinct("business_ref").alias("refs"),
                 F.sum("value_usd").cast("decimal(28,2)").alias("value_exposed")))


def failure_attribution(ev: DataFrame, rule: str = "status") -> DataFrame:
    """Partner (theirs) vs platform (ours).

    ``rule='status'`` (current): rejected or bad_input_file -> partner.
    ``rule='reason'`` (older): a fixed reason list -> partner.
    """
    if rule == "status":
        theirs = (F.col("status") == "rejected") | (F.col("reason_category") == "bad_input_file")
    else:
        theirs = F.col("reason_category").isin(*PARTNER_REASONS_OLD)
    attribution = F.when(theirs, "partner (theirs)").otherwise("platform (ours)")
    return (_exceptions(ev).filter(F.col("reason_category").isNotNull())
            .groupBy(attribution.alias("attribution")).agg(F.count(F.lit(1)).alias("occurrences")))


def duplicate_sources(ev: DataFrame, duplicates_only: bool = True) -> DataFrame:
    """(partner, control number) seen more than once.

    ``duplicates_only`` counts rows already marked duplicate (dataset form);
    ``False`` counts every message (the documented diagnostic form).
    """
    src = ev.filter(F.col("status") == "duplicate") if duplicates_only else ev
    return (src.groupBy("partner", "control_number")
              .agg(F.count(F.lit(1)).alias("dupes")).filter(F.col("dupes") > 1))


def resolution_kb(ev: DataFrame, rules: DataFrame) -> DataFrame:
    """Partner-specific rule wins over the generic rule per (reason, code).

    Rules are a config table; AQE decides by its measured size whether to broadcast it.
    NULL error codes never match (SQL equality), as in the reference.
    """
    r = rules
    cols = ["likely_cause", "suggested_action", "runbook_url"]
    dp = r.filter(F.col("partner").isNotNull()).select(
        F.col("partner").alias("p_partner"), F.col("reason_category").alias("p_reason"),
        F.col("error_code").alias("p_code"), *[F.col(c).alias("p_" + c) for c in cols])
    dg = r.filter(F.col("partner").isNull()).select(
        F.col("reason_category").alias("g_reason"), F.col("error_code").alias("g_code"),
        *[F.col(c).alias("g_" + c) for c in cols])
    e = _exceptions(ev)
    j = (e.join(dp, (dp.p_partner == e.partner) & (dp.p_reason == e.reason_category) & (dp.p_code == e.error_code), "left")
          .join(dg, (dg.g_reason == e.reason_category) & (dg.g_code == e.error_code), "left"))
    return j.select("event_time", "business_ref", "partner", "reason_category", "error_code",
                    *[F.coalesce("p_" + c, "g_" + c).alias(c) for c in cols])


def dollars_at_risk(ev: DataFrame, penalty: DataFrame) -> DataFrame:
    """Penalty exposure of current exceptions per (environment, partner)."""
    p = penalty
    return (_exceptions(ev).join(p, ["partner", "doc_type"])
            .groupBy("environment", "partner")
            .agg(F.sum("penalty_usd").cast("decimal(28,2)").alias("dollars_at_risk")))
