"""Remaining grids and KPI variants, the EDI-scoped rollup and the batch forms of
the streaming operators (F13, F21, A36, A37, A41, SRC4, ST1, ST5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import lifecycle as lc
from flowlens.operators import rollup as ro
from flowlens.operators import shipment360 as s3
from flowlens.operators import sla
from flowlens.plans import shapes as sh
from flowlens.plans.catalog_ops import PAIRS_SQL
from flowlens.plans.registry import CUR, RU, W, register, sql
from flowlens.streaming import jobs

EV = ["txn_events"]


@register("f13_txn_lookup", sql(EV, """
SELECT business_ref, partner, doc_type, current_stage, current_status, first_event_at, last_event_at, terminal,
  replay_count FROM txn_current""", CUR))
def f13_txn_lookup(spark, sf_dir):
    return lc.txn_lookup(lc.current_state(W(spark, sf_dir).events()))


@register("f21_lob_details", sql(EV, """
SELECT business_ref, lob, partner, doc_type, channel, current_stage, current_status, last_event_at, value_usd
FROM txn_current""", CUR))
def f21_lob_details(spark, sf_dir):
    return lc.lob_details(lc.current_state(W(spark, sf_dir).events()))


@register("a41_exception_kpis", sql(["anomaly_registry"], """
SELECT count(DISTINCT anomaly_id) AS exceptions,
  count(DISTINCT anomaly_id) FILTER (WHERE anomaly_status IN ('Open', 'In Progress') AND severity = 'Critical') AS critical_exceptions,
  count(DISTINCT anomaly_id) FILTER (WHERE anomaly_status IN ('Open', 'In Progress') AND anomaly_type = 'STATUS_AGING') AS aging_exceptions
FROM anomaly_registry"""))
def a41_exception_kpis(spark, sf_dir):
    return s3.exception_kpis(W(spark, sf_dir).anomalies())


@register("src4_edi_rollup", sql(EV, "SELECT * FROM txn_rollup_hourly WHERE protocol = 'edi'", RU))
def src4_edi_rollup(spark, sf_dir):
    return ro.rollup_for(W(spark, sf_dir).rollup(), "edi")


@register("st1_windowed_rollup", sql(EV, """
SELECT * EXCLUDE (breached_count) FROM txn_rollup_hourly""", RU))
def st1_windowed_rollup(spark, sf_dir):
    """The streaming rollup's plan run on the batch table (breach is applied at read)."""
    return jobs.windowed_rollup(W(spark, sf_dir).events(), watermark=None)


@register("st5_feed_sessions", sql(["feed_events"], """
SELECT environment, partner, doc_type, min(event_time) AS session_start,
  max(event_time) + INTERVAL 1 HOUR AS session_end, count(*) AS messages, max(event_time) AS last_message_at
FROM (SELECT *, sum(new_session) OVER (PARTITION BY environment, partner, doc_type ORDER BY event_time, event_id
                                       ROWS UNBOUNDED PRECEDING) AS sid
      FROM (SELECT *, CASE WHEN lag(event_time) OVER w IS NULL OR event_time >= lag(event_time) OVER w + INTERVAL 1 HOUR
                           THEN 1 ELSE 0 END AS new_session
            FROM feed_events WINDOW w AS (PARTITION BY environment, partner, doc_type ORDER BY event_time, event_id)))
GROUP BY environment, partner, doc_type, sid"""))
def st5_feed_sessions(spark, sf_dir):
    """Silent-feed sessions (gap 1 hour) with the streaming operator's plan on the batch table."""
    return jobs.feed_sessions(W(spark, sf_dir).feed_events(), gap="1 hour", watermark=None)




@register("a36_breaches_by_lob", sql(EV, """
SELECT lob, CAST(sum(breached_count) AS BIGINT) AS breached FROM txn_rollup_hourly GROUP BY lob""", RU))
def a36_breaches_by_lob(spark, sf_dir):
    return ro.breaches(W(spark, sf_dir).rollup(), "lob")


@register("a36_breach_trend", sql(EV, """
SELECT CAST(date_trunc('day', bucket) AS TIMESTAMP) AS bucket, CAST(sum(breached_count) AS BIGINT) AS breached
FROM txn_rollup_hourly GROUP BY 1""", RU))
def a36_breach_trend(spark, sf_dir):
    return sh.big_number(W(spark, sf_dir).rollup(), ("breached", F.sum("breached_count").cast("bigint")),
                         trend_col="bucket")


@register("a37_missed_by_partner", sql(EV, """
SELECT partner, sla_state, count(*) FILTER (WHERE sla_state = 'missed') AS missed, count(*) AS orders
FROM vw_sla_pairs GROUP BY 1, 2""", f"vw_sla_pairs AS ({PAIRS_SQL})"))
def a37_missed_by_partner(spark, sf_dir):
    w = W(spark, sf_dir)
    return sla.missed_by_partner(sla.sla_pairs(w.events(), w.as_of))
