"""Rollup and lifecycle queries (A1, A2, A4-A7, W1, F13-F17, F21, F22, A22-A26,
A32-A36, A40)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.timeutil import add_hours, ts_lit
from flowlens.operators import lifecycle as lc
from flowlens.operators import rollup as ro
from flowlens.plans.oracle_world import AS_OF
from flowlens.plans.registry import CUR, DETAIL, RU, ROLLUP_SQL, SHIP, W, register, sql

EV = ["txn_events"]


@register("a1_hourly_rollup", sql(EV, "SELECT * FROM txn_rollup_hourly", RU))
def a1_hourly_rollup(spark, sf_dir):
    w = W(spark, sf_dir)
    return ro.hourly_rollup(w.events(), w.as_of)


_STALE_AT = f"({AS_OF} - INTERVAL 3 HOUR)"
_STALE_ROLLUP = ROLLUP_SQL.replace(AS_OF, _STALE_AT).replace(
    "FROM txn_events GROUP BY ALL", f"FROM txn_events WHERE event_time <= {_STALE_AT} GROUP BY ALL")
_CUT = f"date_trunc('hour', {AS_OF}) - INTERVAL 2 HOUR"


@register("a2_refresh_rollup", sql(EV, f"""
SELECT * FROM stale WHERE bucket < {_CUT}
UNION ALL
SELECT * FROM fresh""", f"""stale AS ({_STALE_ROLLUP}),
fresh AS ({ROLLUP_SQL.replace("FROM txn_events GROUP BY ALL", f"FROM txn_events WHERE event_time >= {_CUT} GROUP BY ALL")})"""))
def a2_refresh_rollup(spark, sf_dir):
    """Rollup written 3 hours earlier (stale), then refreshed at as_of."""
    w = W(spark, sf_dir)
    ev = w.events()
    before = add_hours(ts_lit(w.as_of), -3)
    stale = ro.hourly_rollup(ev.filter(F.col("event_time") <= before), before)
    return ro.refresh_rollup(ev, stale, w.as_of, hours=2)


def _ru(spark, sf_dir):
    return W(spark, sf_dir).rollup()


@register("a32_flow_kpis", sql(EV, """
SELECT CAST(sum(txn_count) AS BIGINT) AS total_messages,
  CAST(coalesce(sum(txn_count) FILTER (WHERE protocol = 'edi'), 0) AS BIGINT) AS edi_messages,
  CAST(coalesce(sum(txn_count) FILTER (WHERE protocol = 'api'), 0) AS BIGINT) AS api_messages,
  CAST(coalesce(sum(txn_count) FILTER (WHERE doc_type = '204'), 0) AS BIGINT) AS orders,
  CAST(coalesce(sum(txn_count) FILTER (WHERE doc_type = '990'), 0) AS BIGINT) AS confirmations,
  CAST(coalesce(sum(txn_count) FILTER (WHERE doc_type = '214'), 0) AS BIGINT) AS updates,
  CAST(coalesce(sum(txn_count) FILTER (WHERE doc_type = '210'), 0) AS BIGINT) AS invoices,
  round(100.0 * (1.0 - CAST(sum(failed_count + rejected_count) AS DOUBLE) / nullif(CAST(sum(txn_count) AS DOUBLE), 0.0)), 2) AS auto_processed_pct,
  CAST(sum(failed_count + rejected_count) AS BIGINT) AS exceptions,
  CAST(sum(duplicate_count) AS BIGINT) AS duplicates,
  CAST(sum(kchar_sum) AS DECIMAL(28,2)) AS kchar,
  CAST(sum(breached_count) AS BIGINT) AS breached
FROM txn_rollup_hourly""", RU))
def a32_flow_kpis(spark, sf_dir):
    return ro.flow_kpis(_ru(spark, sf_dir))


@register("a36_breaches_by_partner", sql(EV, """
SELECT partner, CAST(sum(breached_count) AS BIGINT) AS breached FROM txn_rollup_hourly GROUP BY partner""", RU))
def a36_breaches_by_partner(spark, sf_dir):
    return ro.breaches(_ru(spark, sf_dir), "partner")


@register("a22_monthly_usage", sql(EV, """
SELECT CAST(date_trunc('month', bucket) AS TIMESTAMP) AS month, partner, protocol, doc_type, channel,
  CAST(sum(txn_count) AS BIGINT) AS txns, CAST(sum(kchar_sum) AS DECIMAL(28,2)) AS kchar,
  CAST(sum(value_sum) AS DECIMAL(28,2)) AS value_usd
FROM txn_rollup_hourly GROUP BY ALL""", RU))
def a22_monthly_usage(spark, sf_dir):
    return ro.monthly_usage(_ru(spark, sf_dir))


@register("a26_traffic", sql(EV, """
SELECT lob, partner, CAST(bucket AS DATE) AS day, CAST(sum(txn_count) AS BIGINT) AS txn_count
FROM txn_rollup_hourly GROUP BY ALL""", RU))
def a26_traffic(spark, sf_dir):
    return ro.traffic(_ru(spark, sf_dir))


# ----------------------------------------------------------------- orders
@register("a4_shipments", sql(EV, "SELECT * FROM vw_shipment", SHIP))
def a4_shipments(spark, sf_dir):
    w = W(spark, sf_dir)
    return lc.shipments(w.events(), w.as_of)


def _ship(spark, sf_dir):
    w = W(spark, sf_dir)
    return lc.shipments(w.events(), w.as_of)


@register("a34_order_kpis", sql(EV, """
SELECT count(*) AS orders,
  round(100.0 * CAST(count(*) FILTER (WHERE complete) AS DOUBLE) / nullif(CAST(count(*) AS DOUBLE), 0.0), 2) AS flow_complete_pct,
  round(100.0 * CAST(count(*) FILTER (WHERE has_invoice) AS DOUBLE) / nullif(CAST(count(*) AS DOUBLE), 0.0), 2) AS invoice_coverage_pct,
  count(*) FILTER (WHERE exception_cnt > 0) AS with_exceptions
FROM vw_shipment""", SHIP))
def a34_order_kpis(spark, sf_dir):
    return lc.order_kpis(_ship(spark, sf_dir))


@register("a34_completeness_mix", sql(EV, """
SELECT completeness_status, count(*) AS orders FROM vw_shipment GROUP BY 1""", SHIP))
def a34_completeness_mix(spark, sf_dir):
    return lc.completeness_mix(_ship(spark, sf_dir))


@register("a35_order_sla_kpis", sql(EV, """
SELECT round(100.0 * CAST(count(*) FILTER (WHERE NOT sla_breached) AS DOUBLE) / nullif(CAST(count(sla_breached) AS DOUBLE), 0.0), 2) AS on_time_pct,
  count(*) FILTER (WHERE sla_breached) AS breached, count(*) AS orders,
  CAST(coalesce(sum(CASE WHEN sla_breached THEN value_usd END), 0) AS DECIMAL(28,2)) AS dollars_at_risk
FROM vw_shipment""", SHIP))
def a35_order_sla_kpis(spark, sf_dir):
    return lc.order_sla_kpis(_ship(spark, sf_dir))


# ---------------------------------------------------------- current state
@register("w1_current_state", sql(EV, "SELECT * FROM txn_current", CUR))
def w1_current_state(spark, sf_dir):
    return lc.current_state(W(spark, sf_dir).events())


def _cur(spark, sf_dir):
    return lc.current_state(W(spark, sf_dir).events())


@register("f14_all_transactions", sql(EV, f"""
SELECT business_ref, environment, lob, partner, channel, protocol, doc_type, current_stage, current_status,
  last_event_at, terminal, replayed,
  CAST(round(CAST(date_diff('microsecond', last_event_at, {AS_OF}) AS DOUBLE) / 60000000.0) AS BIGINT) AS age_min
FROM txn_current""", CUR))
def f14_all_transactions(spark, sf_dir):
    w = W(spark, sf_dir)
    return lc.all_transactions(lc.current_state(w.events()), w.as_of)


@register("f16_replayed", sql(EV, """
SELECT business_ref, partner, doc_type, current_status, replay_count, replayed_at
FROM txn_current WHERE replayed""", CUR))
def f16_replayed(spark, sf_dir):
    return lc.replayed(_cur(spark, sf_dir))


@register("f17_replay_refailed", sql(EV, """
SELECT business_ref, partner, doc_type, replay_count, current_status
FROM txn_current WHERE replay_count > 0 AND current_status IN ('failed','rejected')""", CUR))
def f17_replay_refailed(spark, sf_dir):
    return lc.replay_refailed(_cur(spark, sf_dir))


@register("a24_lob_last", sql(EV, """
SELECT lob, max(last_event_at) AS last_received, count(*) AS live_refs FROM txn_current GROUP BY lob""", CUR))
def a24_lob_last(spark, sf_dir):
    return lc.lob_last(_cur(spark, sf_dir))


@register("a25_status_distribution", sql(EV, """
SELECT current_status, count(*) AS txns FROM txn_current GROUP BY 1""", CUR))
def a25_status_distribution(spark, sf_dir):
    return lc.status_distribution(_cur(spark, sf_dir))


@register("a40_state_kpis", sql(EV, """
SELECT count(*) AS live, count(*) FILTER (WHERE NOT terminal) AS in_flight,
  count(*) FILTER (WHERE terminal) AS terminal, count(*) FILTER (WHERE replayed) AS replayed,
  count(*) FILTER (WHERE current_status IN ('failed','rejected') AND replay_count > 0) AS resubmitted_exceptions
FROM txn_current""", CUR))
def a40_state_kpis(spark, sf_dir):
    return lc.state_kpis(_cur(spark, sf_dir))


# ------------------------------------------------------------ msg detail
@register("f22_message_detail", sql(EV, "SELECT * FROM vw_shipment_detail", DETAIL))
def f22_message_detail(spark, sf_dir):
    w = W(spark, sf_dir)
    return lc.message_detail(w.events(), w.as_of)


@register("a33_message_kpis", sql(EV, """
SELECT count(*) AS total, count(*) FILTER (WHERE processing_status = 'Processed') AS processed,
  count(*) FILTER (WHERE is_stuck) AS stuck, count(*) FILTER (WHERE processing_status = 'Failed') AS failed
FROM vw_shipment_detail""", DETAIL))
def a33_message_kpis(spark, sf_dir):
    w = W(spark, sf_dir)
    return lc.message_kpis(lc.message_detail(w.events(), w.as_of))


@register("a33_status_mix", sql(EV, """
SELECT processing_status, count(*) AS msgs FROM vw_shipment_detail GROUP BY 1""", DETAIL))
def a33_status_mix(spark, sf_dir):
    w = W(spark, sf_dir)
    return lc.status_mix(lc.message_detail(w.events(), w.as_of))
