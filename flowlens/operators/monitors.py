"""Monitor rules over the small latest-state tables.

The monitor tables hold one row per feed / endpoint / monitor / pipeline;
every rule is a filter + projection evaluated at an explicit ``as_of``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.timeutil import (
    MICROS_PER_MINUTE, add_minutes, as_of_col, micros_between, round_minutes)


def missing_feeds(feeds: DataFrame, as_of=None) -> DataFrame:
    """past due + grace and not seen since due; minutes overdue."""
    now = as_of_col(as_of)
    due = F.col("expected_next_at")
    late = now > add_minutes(due, F.col("grace_minutes"))
    unseen = F.col("last_seen_at").isNull() | (F.col("last_seen_at") < due)
    return (feeds.filter(late & unseen)
                 .select("partner", "doc_type", "channel", "environment", "expected_next_at", "last_seen_at",
                         round_minutes(due, now).alias("mins_overdue")))


def hung_pipelines(p: DataFrame) -> DataFrame:
    """running, queue or MQ depth > 0, consuming nothing."""
    return (p.filter((F.col("state") == "running")
                     & ((F.col("queue_depth") > 0) | (F.col("mq_depth") > 0))
                     & (F.col("consume_rate") == 0))
             .select("pipeline", "environment", "queue_depth", "mq_depth", "consume_rate", "last_consumed_at"))


def _stale(as_of) -> F.Column:
    return (micros_between(F.col("last_run_at"), as_of_col(as_of))
            > F.col("expected_interval_sec").cast("bigint") * F.lit(1_000_000))


def sweep_integrity(hb: DataFrame, as_of=None) -> DataFrame:
    """every monitor with its ``is_stale`` flag."""
    return hb.select("monitor_name", "channel", "environment", "last_run_at", "expected_interval_sec",
                     _stale(as_of).alias("is_stale"))


def stale_monitors(hb: DataFrame, as_of=None) -> DataFrame:
    """stale monitors only, minutes silent."""
    return (hb.filter(_stale(as_of))
              .select("monitor_name", "channel", "environment", "last_run_at",
                      round_minutes(F.col("last_run_at"), as_of_col(as_of)).alias("mins_silent")))


def monitors_reporting(hb: DataFrame, as_of=None) -> DataFrame:
    """Number of monitors not silent."""
    return sweep_integrity(hb, as_of).agg(F.count_if(~F.col("is_stale")).alias("reporting"))


def _older_than(ts: str, minutes: int, as_of) -> F.Column:
    return micros_between(F.col(ts), as_of_col(as_of)) > F.lit(minutes * MICROS_PER_MINUTE)


def stuck(ev: DataFrame, as_of=None, minutes: int = 20) -> DataFrame:
    """not terminal and older than ``minutes`` (SLA ignored; see M4)."""
    now = as_of_col(as_of)
    return (ev.filter(~F.col("terminal") & _older_than("event_time", minutes, as_of))
              .select("business_ref", "lob", "partner", "channel", "doc_type",
                      F.col("stage").alias("current_stage"), "environment",
                      F.col("event_time").alias("last_event_at"),
                      round_minutes(F.col("event_time"), now).alias("age_min"), "value_usd"))


def landed_not_picked(ev: DataFrame, as_of=None, minutes: int = 10) -> DataFrame:
    """stage received, not terminal, older than ``minutes``."""
    now = as_of_col(as_of)
    return (ev.filter(~F.col("terminal") & (F.col("stage") == "received")
                      & _older_than("event_time", minutes, as_of))
              .select("business_ref", "lob", "partner", "channel", "doc_type", "environment",
                      F.col("event_time").alias("last_event_at"),
                      round_minutes(F.col("event_time"), now).alias("age_min")))


def channel_health(ep: DataFrame) -> DataFrame:
    """channel health projection."""
    return ep.select("channel", "endpoint", "partner", "environment", "status", "last_ok_at", "cert_expires_at")


def endpoints_down(ep: DataFrame) -> DataFrame:
    """F8: endpoints not up."""
    return (ep.filter(F.col("status") != "up")
              .select("channel", "endpoint", "partner", "environment", "status", "last_ok_at"))


def cert_expiry(ep: DataFrame, as_of=None, days: int = 14, critical_days: int = 7) -> DataFrame:
    """certificates expiring within ``days``; days left and severity."""
    now = as_of_col(as_of)
    days_left = F.datediff(F.col("cert_expires_at"), F.to_date(now))
    return (ep.filter(F.col("cert_expires_at").cast("timestamp_ntz") < F.timestamp_add("DAY", F.lit(days), now))
              .select("channel", "endpoint", "partner", "environment", "cert_expires_at",
                      days_left.alias("days_left"),
                      F.when(days_left < critical_days, "critical").otherwise("warning").alias("severity")))
