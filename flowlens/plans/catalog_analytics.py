"""Anomaly, partner, doc-type, shipment-360 / control-tower and API queries
(A8-A11, W6, J8, J13, J12, A16-A20, J9-J11, A27-A29, T1-T21)."""

from __future__ import annotations

from flowlens.operators import anomaly as an
from flowlens.operators import api
from flowlens.operators import doctypes as dt
from flowlens.operators import partners as pa
from flowlens.operators import shipment360 as s3
from flowlens.plans.oracle_world import AS_OF
from flowlens.plans.registry import ROLLUP_SQL, RU, W, register, sql

# ----------------------------------------------------------------- anomaly
FEED_RU = "feed_ru AS (" + ROLLUP_SQL.replace("FROM txn_events GROUP BY ALL", "FROM feed_events GROUP BY ALL") + ")"


def daily_sql(ru: str, name: str) -> str:
    return f"""{name} AS (SELECT environment, partner, doc_type, CAST(bucket AS DATE) AS day,
  CAST(sum(txn_count) AS BIGINT) AS txns, CAST(sum(failed_count + rejected_count) AS BIGINT) AS errors,
  CAST(sum(breached_count) AS BIGINT) AS breached FROM {ru} GROUP BY ALL)"""


def asof_sql(ru: str) -> str:
    return (f"(SELECT max(CAST(date_trunc('day', bucket) AS DATE)) FROM {ru} "
            f"WHERE bucket < date_trunc('day', (SELECT max(bucket) FROM {ru})))")


def feed_anomaly_sql(ru: str, daily: str, name: str) -> str:
    """One pass over the feed's days, each told by its age: 0-6 now, 7-27 the base."""
    return f"""{name}_aged AS (
  SELECT d.*, a.asof_day - d.day AS age FROM {daily} d CROSS JOIN (SELECT {asof_sql(ru)} AS asof_day) a),
{name}_means AS (
  SELECT environment, partner, doc_type, sum(if(age BETWEEN 7 AND 27, txns, 0)) / 21.0::DOUBLE AS bm,
    coalesce(stddev_pop(if(age BETWEEN 7 AND 27, txns, NULL)), 0) AS sd,
    sum(if(age BETWEEN 0 AND 6, txns, 0)) / 7.0::DOUBLE AS cm,
    arg_min(day, age) FILTER (WHERE txns > 0) AS last_active_day, min(age) FILTER (WHERE txns > 0) AS quiet
  FROM {name}_aged GROUP BY ALL),
{name}_scored AS (
  SELECT *, (cm - bm) / nullif(sd, 0) AS z, 100.0 * (bm - cm) / bm AS lost FROM {name}_means WHERE bm >= 3),
{name}_states AS (
  SELECT environment, partner, doc_type, 1 AS priority, 'Silent' AS status FROM {name}_scored WHERE bm >= 5 AND cm = 0
  UNION ALL SELECT environment, partner, doc_type, 2, 'Severe drop' FROM {name}_scored WHERE z <= -2 OR lost >= 50
  UNION ALL SELECT environment, partner, doc_type, 3, 'Watch' FROM {name}_scored WHERE z <= -1
  UNION ALL SELECT environment, partner, doc_type, 4, 'Normal' FROM {name}_scored),
{name} AS (
  SELECT environment, partner, doc_type, any_value(last_active_day) AS last_active_day,
    any_value(if(quiet > 0, quiet, NULL)) AS days_silent, round(any_value(bm), 1) AS base_mean, round(any_value(sd), 1) AS base_sd,
    round(any_value(cm), 1) AS cur_mean, round(any_value(z), 2) AS zscore, round(any_value(lost), 0) AS drop_pct,
    arg_min(status, priority) AS status
  FROM {name}_scored JOIN {name}_states USING (environment, partner, doc_type) GROUP BY environment, partner, doc_type)"""


def partner_anomaly_sql(fa: str, name: str) -> str:
    """The partner is as bad as its worst feed; feeds are counted in a map by status."""
    return f"""{name}_maps AS (
  SELECT environment, partner, count(*) AS feeds, histogram(status) AS by_status, min(zscore) AS worst_z,
    max(drop_pct) AS worst_drop_pct, round(sum(base_mean), 0) AS base_mean_total, round(sum(cur_mean), 0) AS cur_mean_total,
    arg_min(status, priority) AS worst
  FROM {fa} JOIN (VALUES ('Silent', 1), ('Severe drop', 2), ('Watch', 3), ('Normal', 4)) ranks(status, priority) USING (status)
  GROUP BY environment, partner),
{name} AS (
  SELECT * EXCLUDE (by_status, worst), CAST(coalesce(by_status['Silent'], 0) AS BIGINT) AS silent_feeds,
    CAST(coalesce(by_status['Severe drop'], 0) AS BIGINT) AS severe_drop_feeds,
    feeds - CAST(coalesce(by_status['Normal'], 0) AS BIGINT) AS abnormal_feeds,
    worst AS status
  FROM {name}_maps)"""


FEED_DAILY = daily_sql("feed_ru", "feed_daily")
FEED_FA = feed_anomaly_sql("feed_ru", "feed_daily", "feed_fa")


def _feed_daily(spark, sf_dir):
    w = W(spark, sf_dir)
    ru = w.feed_rollup()
    return ru, an.feed_daily(ru)


@register("a8_feed_daily", sql(["feed_events"], "SELECT * FROM feed_daily", FEED_RU + ",\n" + FEED_DAILY))
def a8_feed_daily(spark, sf_dir):
    return _feed_daily(spark, sf_dir)[1]


@register("a9_asof_day", sql(["feed_events"], f"SELECT {asof_sql('feed_ru')} AS asof_day", FEED_RU))
def a9_asof_day(spark, sf_dir):
    ru, _ = _feed_daily(spark, sf_dir)
    return an.asof_day_frame(ru)


@register("a10_feed_anomaly", sql(["feed_events"], "SELECT * FROM feed_fa",
                                  FEED_RU + ",\n" + FEED_DAILY + ",\n" + FEED_FA))
def a10_feed_anomaly(spark, sf_dir):
    ru, daily = _feed_daily(spark, sf_dir)
    return an.feed_anomaly(daily, an.asof_day(ru))


@register("a11_partner_anomaly", sql(["feed_events"], "SELECT * FROM feed_pa",
                                     FEED_RU + ",\n" + FEED_DAILY + ",\n" + FEED_FA + ",\n"
                                     + partner_anomaly_sql("feed_fa", "feed_pa")))
def a11_partner_anomaly(spark, sf_dir):
    ru, daily = _feed_daily(spark, sf_dir)
    return an.partner_anomaly(an.feed_anomaly(daily, an.asof_day(ru)))


@register("w6_trailing_baseline", sql(["feed_events"], """
SELECT environment, partner, doc_type, day, coalesce(txns, 0) AS txns, round(bm, 1) AS base_mean, round(bsd, 1) AS base_sd,
  round(cm, 1) AS cur_mean, round((cm - bm) / nullif(bsd, 0), 2) AS zscore,
  round(100.0 * (bm - cm) / nullif(bm, 0), 0) AS drop_pct,
  CASE WHEN bm >= 5 AND cm = 0 THEN 'Silent'
       WHEN (cm - bm) / nullif(bsd, 0) <= -2 OR 100.0 * (bm - cm) / nullif(bm, 0) >= 50 THEN 'Severe drop'
       WHEN (cm - bm) / nullif(bsd, 0) <= -1 THEN 'Watch' ELSE 'Normal' END AS status
FROM (
  SELECT *, count(txns) OVER wb AS base_days,
    CAST(coalesce(sum(txns) OVER wb, 0) AS DOUBLE) / 21 AS bm,
    coalesce(stddev_pop(txns) OVER wb, 0) AS bsd,
    CAST(coalesce(sum(txns) OVER wc, 0) AS DOUBLE) / 7 AS cm
  FROM (SELECT feed_days.*, txns, date_diff('day', DATE '1970-01-01', day) AS dn FROM feed_days
        LEFT JOIN feed_daily USING (environment, partner, doc_type, day))
  WINDOW wb AS (PARTITION BY environment, partner, doc_type ORDER BY dn RANGE BETWEEN 27 PRECEDING AND 7 PRECEDING),
         wc AS (PARTITION BY environment, partner, doc_type ORDER BY dn RANGE BETWEEN 6 PRECEDING AND CURRENT ROW))
WHERE base_days > 0 AND bm >= 3""", FEED_RU + ",\n" + FEED_DAILY + """,
feed_firsts AS (SELECT environment, partner, doc_type, min(day) AS first FROM feed_daily GROUP BY ALL),
feed_days AS (SELECT environment, partner, doc_type, CAST(unnest(generate_series(CAST(first AS TIMESTAMP),
    (SELECT CAST(max(day) AS TIMESTAMP) FROM feed_daily), INTERVAL 1 DAY)) AS DATE) AS day
  FROM feed_firsts)"""))
def w6_trailing_baseline(spark, sf_dir):
    return an.trailing_baseline(_feed_daily(spark, sf_dir)[1])


# ----------------------------------------------------------------- partners
ORDER_ANOM = (daily_sql("txn_rollup_hourly", "ord_daily") + ",\n"
              + feed_anomaly_sql("txn_rollup_hourly", "ord_daily", "ord_fa") + ",\n"
              + partner_anomaly_sql("ord_fa", "ord_pa"))


# Facts per partner and document type, met by the few penalties, then summed per partner; the SLA share
# comes from the same facts, not from the rollup.
@register("j8_partner_360", sql(["txn_events", "ref_partner_penalty", "ref_partner_profile"], f"""
SELECT t.* EXCLUDE (duplicates), pr.tier, pr.onboarding_status, pr.region,
  round(100 * t.exceptions::DOUBLE / t.refs, 2) AS exception_pct, round(100 * t.duplicates::DOUBLE / t.refs, 2) AS duplicate_pct,
  round(100.0 * (1.0 - t.breaching::DOUBLE / t.refs), 2) AS sla_pct,
  date_diff('microsecond', t.last_seen, {AS_OF}) / 3600000000.0::DOUBLE AS hours_since_seen,
  coalesce(qa.status, 'Normal') AS anomaly_status, coalesce(qa.silent_feeds, 0) AS silent_feeds,
  coalesce(qa.abnormal_feeds, 0) AS abnormal_feeds
FROM partner_sums t LEFT JOIN ref_partner_profile pr USING (partner) LEFT JOIN ord_pa qa USING (environment, partner)""",
                                RU + ",\n" + ORDER_ANOM + f""",
partner_docs AS (
  SELECT environment, partner, doc_type, count(*) AS n, count_if(status IN ('failed', 'rejected')) AS bad,
    count_if(status = 'duplicate') AS twice, count_if(NOT terminal) AS unfinished,
    count_if(NOT terminal AND sla_due_at < {AS_OF}) AS overdue, max(event_time) AS seen
  FROM txn_events GROUP BY ALL),
partner_sums AS (
  SELECT d.environment, d.partner, CAST(sum(n) AS BIGINT) AS refs, CAST(sum(bad) AS BIGINT) AS exceptions,
    CAST(sum(twice) AS BIGINT) AS duplicates, CAST(sum(unfinished) AS BIGINT) AS open_refs,
    CAST(sum(overdue) AS BIGINT) AS breaching, max(seen) AS last_seen,
    CAST(coalesce(sum(bad * fee), 0) AS DECIMAL(28,2)) AS dollars_at_risk
  FROM partner_docs d
  LEFT JOIN (SELECT partner, doc_type, sum(penalty_usd) AS fee FROM ref_partner_penalty GROUP BY ALL) USING (partner, doc_type)
  GROUP BY ALL)"""))
def j8_partner_360(spark, sf_dir):
    w = W(spark, sf_dir)
    ev = w.events()
    ru = w.rollup()
    qa = an.partner_anomaly(an.feed_anomaly(an.feed_daily(ru), an.asof_day(ru)))
    return pa.partner_360(ev, ru, w.penalty(), w.profile(), qa, w.as_of)


@register("j13_partner_activity", sql(["txn_events"], f"""
SELECT cur.partner, CAST(cur.v AS BIGINT) AS volume, CAST(cur.e AS BIGINT) AS exceptions,
  round(100.0 * CAST(cur.v - prv.v AS DOUBLE) / nullif(CAST(prv.v AS DOUBLE), 0.0)) AS pct_change
FROM (SELECT partner, sum(txn_count) v, sum(failed_count + rejected_count) e FROM txn_rollup_hourly
      WHERE bucket >= {AS_OF} - INTERVAL 7 DAY GROUP BY partner) cur
LEFT JOIN (SELECT partner, sum(txn_count) v FROM txn_rollup_hourly
           WHERE bucket >= {AS_OF} - INTERVAL 14 DAY AND bucket < {AS_OF} - INTERVAL 7 DAY GROUP BY partner) prv
  USING (partner)""", RU))
def j13_partner_activity(spark, sf_dir):
    w = W(spark, sf_dir)
    return pa.partner_activity(w.rollup(), w.as_of)


# ---------------------------------------------------------------- doc types
CAT = ["txn_events", "doc_type_catalog"]
RC = "FROM txn_rollup_hourly r LEFT JOIN doc_type_catalog c USING (doc_type)"


def _rc(spark, sf_dir):
    w = W(spark, sf_dir)
    return w.rollup(), w.catalog()


@register("a16_doc_type_grid", sql(CAT, f"""
SELECT coalesce(c.business_family, 'Other') AS family, coalesce(c.label, r.doc_type) AS doc_label, r.doc_type,
  CAST(sum(r.txn_count) AS BIGINT) AS txns, CAST(sum(r.failed_count) AS BIGINT) AS failed,
  CAST(sum(r.rejected_count) AS BIGINT) AS rejected, CAST(sum(r.duplicate_count) AS BIGINT) AS dupes,
  CAST(sum(r.value_sum) AS DECIMAL(28,2)) AS value_usd,
  round(100.0 * (1.0 - CAST(sum(r.failed_count + r.rejected_count) AS DOUBLE) / nullif(CAST(sum(r.txn_count) AS DOUBLE), 0.0)), 1) AS ok_pct
{RC} GROUP BY 1, 2, 3""", RU))
def a16_doc_type_grid(spark, sf_dir):
    return dt.doc_type_grid(*_rc(spark, sf_dir))


_SUMS = """CAST(sum(r.txn_count) AS BIGINT) AS txns, CAST(sum(r.failed_count) AS BIGINT) AS failed,
  CAST(sum(r.rejected_count) AS BIGINT) AS rejected, CAST(sum(r.duplicate_count) AS BIGINT) AS dupes,
  CAST(sum(r.value_sum) AS DECIMAL(28,2)) AS value_usd"""


@register("a17_family_summary", sql(CAT, f"""
SELECT coalesce(c.business_family, 'Other') AS family, count(DISTINCT r.doc_type) AS types, {_SUMS}
{RC} GROUP BY 1""", RU))
def a17_family_summary(spark, sf_dir):
    return dt.family_summary(*_rc(spark, sf_dir))


@register("a17_family_subtotals", sql(CAT, f"""
SELECT family, doc_type, {_SUMS}, GROUPING(family, doc_type) AS level
FROM (SELECT r.*, coalesce(c.business_family, 'Other') AS family {RC}) r
GROUP BY ROLLUP (family, doc_type)""", RU))
def a17_family_subtotals(spark, sf_dir):
    return dt.family_subtotals(*_rc(spark, sf_dir))


@register("a18_family_trend", sql(CAT, f"""
SELECT r.bucket, coalesce(c.business_family, 'Other') AS family, CAST(sum(r.txn_count) AS BIGINT) AS txns
{RC} GROUP BY 1, 2""", RU))
def a18_family_trend(spark, sf_dir):
    return dt.family_trend(*_rc(spark, sf_dir))


@register("a19_type_by_partner", sql(CAT, f"""
SELECT coalesce(c.label, r.doc_type) AS doc_label, r.doc_type, r.partner, CAST(sum(r.txn_count) AS BIGINT) AS txns
{RC} GROUP BY 1, 2, 3""", RU))
def a19_type_by_partner(spark, sf_dir):
    return dt.type_by_partner(*_rc(spark, sf_dir))


@register("a20_type_by_protocol", sql(CAT, f"""
SELECT coalesce(c.label, r.doc_type) AS doc_label, r.doc_type, r.protocol, CAST(sum(r.txn_count) AS BIGINT) AS txns
{RC} GROUP BY 1, 2, 3""", RU))
def a20_type_by_protocol(spark, sf_dir):
    return dt.type_by_protocol(*_rc(spark, sf_dir))


# ----------------------------------------------------------- shipment 360
S360 = ["shipment_header", "edi_transactions", "anomaly_registry", "trading_partner_master"]


def _src(spark, sf_dir, *names):
    """The named sources of shipment 360; a source that is not asked for is not built."""
    w = W(spark, sf_dir)
    return [w.as_of if n == "as_of" else getattr(w, n)() for n in names]


# Counts by type stand in maps; each gap is a row with its rank, and the first by rank is the shipment's status.
@register("j9_shipment_360", sql(S360, """
SELECT g.* EXCLUDE (n, found, wait_us), gaps[1] AS choreography_status,
  CAST(gaps[1] = 'Complete' AS INTEGER) AS choreography_complete,
  CAST(list_contains(gaps, 'Missing 990') AS INTEGER) AS missing_990,
  CAST(list_contains(gaps, 'Missing 214') AS INTEGER) AS missing_214, CAST(list_contains(gaps, 'ACK gap') AS INTEGER) AS ack_gap,
  round(wait_us / 60000000.0::DOUBLE, 1) AS response_minutes,
  CAST(coalesce(wait_us <= expected_204_990_minutes * 60000000::BIGINT, wait_us IS NOT NULL) AS INTEGER) AS response_sla_met
FROM shipment_gaps g JOIN gap_lists USING (shipment_id)""", """message_maps AS (
  SELECT shipment_id, histogram(transaction_type) AS n, count(*) AS total_messages, count_if(ack_required) AS ack_required_cnt,
    count_if(ack_required AND ack_received) AS ack_received_cnt,
    count_if(error_code IS NOT NULL OR processing_status = 'rejected') AS error_cnt,
    count_if(processing_status = 'duplicate') AS duplicate_cnt,
    min(transaction_timestamp) AS first_msg_ts, max(transaction_timestamp) AS last_msg_ts,
    date_diff('microsecond', min(CASE transaction_type WHEN '204' THEN transaction_timestamp END),
                             min(CASE transaction_type WHEN '990' THEN transaction_timestamp END)) AS wait_us
  FROM edi_transactions GROUP BY ALL),
anomaly_maps AS (
  SELECT shipment_id, histogram(anomaly_type) AS found, count(*) AS anomaly_count,
    count_if(severity = 'Critical') AS critical_anomaly_count, sum(business_impact_amount) AS impact
  FROM anomaly_registry GROUP BY ALL),
shipment_facts AS (
  SELECT h.shipment_id, h.partner_id, p.partner_name, p.expected_204_990_minutes, h.transport_mode, h.priority, h.shipment_status,
    h.shipment_date, h.promised_delivery_date, h.actual_delivery_date, coalesce(m.n, MAP {}) AS n, coalesce(a.found, MAP {}) AS found,
    wait_us, first_msg_ts, last_msg_ts, CAST(coalesce(impact, 0) AS DECIMAL(28,2)) AS business_impact_amount,
    coalesce(COLUMNS(['total_messages', 'ack_required_cnt', 'ack_received_cnt', 'error_cnt', 'duplicate_cnt',
                      'anomaly_count', 'critical_anomaly_count']), 0)
  FROM shipment_header h LEFT JOIN trading_partner_master p USING (partner_id) LEFT JOIN message_maps m USING (shipment_id)
  LEFT JOIN anomaly_maps a USING (shipment_id)),
shipment_gaps AS (
  SELECT *, greatest(ack_required_cnt - ack_received_cnt, 0) AS ack_pending,
    CAST(coalesce(n['204'], 0) AS BIGINT) AS cnt_204, CAST(coalesce(n['990'], 0) AS BIGINT) AS cnt_990,
    CAST(coalesce(n['214'], 0) AS BIGINT) AS cnt_214, CAST(coalesce(n['210'], 0) AS BIGINT) AS cnt_210,
    CAST(coalesce(n['997'], 0) AS BIGINT) AS cnt_997,
    map_contains(n, '204') AS has_204, map_contains(n, '990') AS has_990, map_contains(n, '214') AS has_214,
    map_contains(n, '997') AS has_997
  FROM shipment_facts),
gap_rows AS (
  SELECT shipment_id, 1 AS priority, 'No messages' AS gap FROM shipment_facts WHERE total_messages = 0
  UNION ALL SELECT shipment_id, 2, 'Missing 990' FROM shipment_gaps
    WHERE map_contains(found, 'MISSING_990') OR (has_204 AND NOT has_990)
  UNION ALL SELECT shipment_id, 3, 'Missing 214' FROM shipment_gaps WHERE map_contains(found, 'MISSING_214') OR NOT has_214
  UNION ALL SELECT shipment_id, 4, 'ACK gap' FROM shipment_gaps WHERE map_contains(found, 'MISSING_997') OR ack_pending > 0
  UNION ALL SELECT shipment_id, 5, 'Complete' FROM shipment_facts),
gap_lists AS (SELECT shipment_id, list(gap ORDER BY priority) AS gaps FROM gap_rows GROUP BY shipment_id)"""))
def j9_shipment_360(spark, sf_dir):
    h, tx, a, p = _src(spark, sf_dir, "header", "edi_tx", "anomalies", "partners")
    return s3.shipment_360(h, tx, a, p)


@register("j10_shipment_messages", sql(S360, """
SELECT m.* EXCLUDE (carrier_id, created_at), (SELECT any_value(partner_name) FROM trading_partner_master p WHERE p.partner_id = m.partner_id) AS partner_name,
  h.transport_mode
FROM edi_transactions m LEFT JOIN (SELECT shipment_id, transport_mode FROM shipment_header) h USING (shipment_id)"""))
def j10_shipment_messages(spark, sf_dir):
    h, tx, p = _src(spark, sf_dir, "header", "edi_tx", "partners")
    return s3.shipment_messages(tx, p, h)


def _status_sql(trig: str, resp: str, sla: str) -> str:
    m = f"CAST(date_diff('microsecond', {trig}, {resp}) AS DOUBLE) / 60000000.0"
    return f"""CASE WHEN {resp} IS NULL AND {trig} + to_minutes(CAST({sla} AS BIGINT)) < {AS_OF} THEN 'missing'
       WHEN {resp} IS NULL THEN 'pending' WHEN {m} <= CAST({sla} AS DOUBLE) THEN 'met' ELSE 'breach' END"""


def _pct52(num: str, den: str) -> str:
    return f"CAST(round(100.0 * CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0.0), 2) AS DECIMAL(5,2))"


TENDER = f"""tender AS (
  SELECT h.shipment_id, h.partner_id, h.carrier_id, h.shipment_date, h.shipment_value, x.tender_ts, x.response_ts,
    x.first_214_ts, p.partner_name, p.expected_204_990_minutes
  FROM shipment_header h
  JOIN (SELECT shipment_id, min(transaction_timestamp) FILTER (WHERE transaction_type = '204') AS tender_ts,
          min(transaction_timestamp) FILTER (WHERE transaction_type = '990') AS response_ts,
          min(transaction_timestamp) FILTER (WHERE transaction_type = '214') AS first_214_ts
        FROM edi_transactions GROUP BY 1) x ON x.shipment_id = h.shipment_id
  LEFT JOIN trading_partner_master p ON p.partner_id = h.partner_id
  WHERE x.tender_ts IS NOT NULL),
t1 AS (
  SELECT shipment_id, partner_id, partner_name, carrier_id, tender_ts, response_ts, CAST(tender_ts AS DATE) AS metric_date,
    round(CAST(date_diff('microsecond', tender_ts, response_ts) AS DOUBLE) / 60000000.0, 1) AS response_minutes,
    expected_204_990_minutes AS sla_minutes,
    {_status_sql('tender_ts', 'response_ts', 'expected_204_990_minutes')} AS sla_status
  FROM tender),
t2 AS (
  SELECT shipment_id, partner_id, partner_name, carrier_id, tender_ts, first_214_ts, CAST(tender_ts AS DATE) AS metric_date,
    round(CAST(date_diff('microsecond', tender_ts, first_214_ts) AS DOUBLE) / 60000000.0, 1) AS first_update_minutes,
    1440 AS sla_minutes, {_status_sql('tender_ts', 'first_214_ts', '1440')} AS sla_status
  FROM tender)"""


@register("t1_response_204_990", sql(S360, "SELECT * FROM t1", TENDER))
def t1_response_204_990(spark, sf_dir):
    h, tx, p, asof = _src(spark, sf_dir, "header", "edi_tx", "partners", "as_of")
    return s3.response_204_990(h, tx, p, asof)


@register("t2_first_update_204_214", sql(S360, "SELECT * FROM t2", TENDER))
def t2_first_update_204_214(spark, sf_dir):
    h, tx, p, asof = _src(spark, sf_dir, "header", "edi_tx", "partners", "as_of")
    return s3.first_update_204_214(h, tx, p, asof)


@register("t3_message_sla_daily", sql(S360, f"""
SELECT metric_date, partner_id, partner_name, sla_type,
  count(*) FILTER (WHERE sla_status <> 'pending') AS total_messages,
  count(*) FILTER (WHERE sla_status = 'met') AS within_sla_count,
  count(*) FILTER (WHERE sla_status = 'breach') AS breach_count,
  count(*) FILTER (WHERE sla_status = 'missing') AS missing_count,
  {_pct52("count(*) FILTER (WHERE sla_status = 'met')", "count(*) FILTER (WHERE sla_status <> 'pending')")} AS sla_percent
FROM (SELECT metric_date, partner_id, partner_name, sla_status, '204-990' AS sla_type FROM t1
      UNION ALL SELECT metric_date, partner_id, partner_name, sla_status, '204-214' FROM t2)
GROUP BY 1, 2, 3, 4""", TENDER))
def t3_message_sla_daily(spark, sf_dir):
    h, tx, p, asof = _src(spark, sf_dir, "header", "edi_tx", "partners", "as_of")
    return s3.message_sla_daily(h, tx, p, asof)


@register("t4_ack_sla_daily", sql(S360, f"""
SELECT CAST(transaction_timestamp AS DATE) AS metric_date, partner_id, transaction_type,
  count(*) FILTER (WHERE st <> 'pending') AS total_transactions,
  count(*) FILTER (WHERE st = 'met') AS ack_within_sla_count, count(*) FILTER (WHERE st = 'breach') AS ack_breach_count,
  count(*) FILTER (WHERE st = 'missing') AS missing_ack_count,
  {_pct52("count(*) FILTER (WHERE st = 'met')", "count(*) FILTER (WHERE st <> 'pending')")} AS ack_sla_percent
FROM (SELECT *, {_status_sql('transaction_timestamp', 'ack_timestamp', '60')} AS st
      FROM edi_transactions WHERE ack_required)
GROUP BY 1, 2, 3"""))
def t4_ack_sla_daily(spark, sf_dir):
    tx, asof = _src(spark, sf_dir, "edi_tx", "as_of")
    return s3.ack_sla_daily(tx, asof)


@register("t5_transaction_volume", sql(S360, """
SELECT CAST(transaction_timestamp AS DATE) AS transaction_date, hour(transaction_timestamp) AS transaction_hour,
  partner_id, transaction_type, processing_status, count(*) AS transaction_count,
  count(*) FILTER (WHERE ack_received) AS ack_received_count,
  count(*) FILTER (WHERE ack_required AND NOT ack_received) AS ack_missing_count
FROM edi_transactions GROUP BY 1, 2, 3, 4, 5"""))
def t5_transaction_volume(spark, sf_dir):
    return s3.transaction_volume(_src(spark, sf_dir, "edi_tx")[0])


@register("t6_edi_funnel", sql(S360, """
SELECT CAST(transaction_timestamp AS DATE) AS transaction_date, partner_id, transaction_type,
  CASE transaction_type WHEN '204' THEN 'Tender' WHEN '990' THEN 'Response' WHEN '214' THEN 'Status' ELSE 'Invoice' END AS funnel_stage,
  CASE transaction_type WHEN '204' THEN 1 WHEN '990' THEN 2 WHEN '214' THEN 3 ELSE 4 END AS funnel_order,
  count(DISTINCT shipment_id) AS shipment_count, count(*) AS transaction_count
FROM edi_transactions WHERE transaction_type IN ('204','990','214','210') GROUP BY 1, 2, 3, 4, 5"""))
def t6_edi_funnel(spark, sf_dir):
    return s3.edi_funnel(_src(spark, sf_dir, "edi_tx")[0])


@register("t7_flow_completeness", sql(S360, """
SELECT h.shipment_id, h.shipment_date, h.partner_id, p.partner_name,
  coalesce(x.has_204, FALSE) AS has_204, coalesce(x.has_990, FALSE) AS has_990,
  coalesce(x.has_214, FALSE) AS has_214, coalesce(x.has_210, FALSE) AS has_210,
  CASE WHEN coalesce(x.has_204, FALSE) AND coalesce(x.has_990, FALSE) AND coalesce(x.has_214, FALSE) AND coalesce(x.has_210, FALSE) THEN 'Complete'
       WHEN NOT coalesce(x.has_204, FALSE) THEN 'Missing 204' WHEN NOT coalesce(x.has_990, FALSE) THEN 'Missing 990'
       WHEN NOT coalesce(x.has_214, FALSE) THEN 'Missing 214' ELSE 'Missing 210' END AS edi_flow_status
FROM shipment_header h
LEFT JOIN (SELECT shipment_id, bool_or(transaction_type = '204') AS has_204, bool_or(transaction_type = '990') AS has_990,
             bool_or(transaction_type = '214') AS has_214, bool_or(transaction_type = '210') AS has_210
           FROM edi_transactions GROUP BY 1) x ON x.shipment_id = h.shipment_id
LEFT JOIN trading_partner_master p ON p.partner_id = h.partner_id"""))
def t7_flow_completeness(spark, sf_dir):
    h, tx, p = _src(spark, sf_dir, "header", "edi_tx", "partners")
    return s3.flow_completeness(h, tx, p)


@register("t8_anomaly_kpis_daily", sql(["anomaly_registry"], """
SELECT CAST(detected_timestamp AS DATE) AS metric_date, count(*) AS total_anomalies,
  count(*) FILTER (WHERE anomaly_status = 'Open') AS open_anomalies,
  count(*) FILTER (WHERE anomaly_status = 'In Progress') AS in_progress_anomalies,
  count(*) FILTER (WHERE anomaly_status = 'Resolved') AS resolved_anomalies,
  count(*) FILTER (WHERE severity = 'Critical') AS critical_anomalies, count(*) FILTER (WHERE severity = 'High') AS high_anomalies,
  count(*) FILTER (WHERE severity = 'Medium') AS medium_anomalies, count(*) FILTER (WHERE severity = 'Low') AS low_anomalies,
  CAST(sum(business_impact_amount) AS DECIMAL(28,2)) AS total_business_impact
FROM anomaly_registry GROUP BY 1"""))
def t8_anomaly_kpis_daily(spark, sf_dir):
    return s3.anomaly_kpis_daily(_src(spark, sf_dir, "anomalies")[0])


@register("t9_anomaly_summary", sql(["anomaly_registry"], """
SELECT CAST(detected_timestamp AS DATE) AS detected_date, partner_id, anomaly_type, severity, anomaly_status,
  count(*) AS anomaly_count FROM anomaly_registry GROUP BY 1, 2, 3, 4, 5"""))
def t9_anomaly_summary(spark, sf_dir):
    return s3.anomaly_summary(_src(spark, sf_dir, "anomalies")[0])


@register("t10_exception_workbench", sql(S360, f"""
SELECT a.anomaly_id, a.shipment_id, a.partner_id, p.partner_name, a.carrier_id, s.transport_mode, s.shipment_status,
  a.anomaly_type, a.severity, a.anomaly_status, a.root_cause_category, a.recommended_action, a.detected_timestamp,
  a.business_impact_amount, a.transaction_type, a.current_status, a.actual_value, a.expected_value, a.deviation_percent,
  CAST(a.detected_timestamp AS DATE) AS detected_date, s.shipment_value,
  CAST(s.promised_delivery_date AS DATE) AS promised_delivery_date, CAST(s.actual_delivery_date AS DATE) AS actual_delivery_date,
  CASE a.severity WHEN 'Critical' THEN 1 WHEN 'High' THEN 2 WHEN 'Medium' THEN 3 WHEN 'Low' THEN 4 END AS priority_rank,
  round(CAST(date_diff('microsecond', a.detected_timestamp, {AS_OF}) AS DOUBLE) / 3600000000.0, 1) AS age_hours
FROM anomaly_registry a LEFT JOIN trading_partner_master p ON p.partner_id = a.partner_id
LEFT JOIN shipment_header s ON s.shipment_id = a.shipment_id"""))
def t10_exception_workbench(spark, sf_dir):
    h, a, p, asof = _src(spark, sf_dir, "header", "anomalies", "partners", "as_of")
    return s3.exception_workbench(a, h, p, asof)


def _health_sql(sla: str, exc: str, ships: str) -> str:
    halves = f"(CAST(round({sla} * 100) AS HUGEINT) * {ships} + 10000 * greatest(0, {ships} - {exc}))"
    return f"CAST(({halves} + {ships}) // nullif(2 * {ships}, 0) AS DOUBLE) / 100.0"


def _risk_sql(score: str) -> str:
    return f"CASE WHEN {score} < 70 THEN 'High' WHEN {score} < 85 THEN 'Medium' ELSE 'Low' END"


@register("t11_partner_health_daily", sql(S360, f"""
SELECT metric_date, partner_id, partner_name, shipments_count, exception_count, sla_percent, health_score,
  {_risk_sql('health_score')} AS partner_risk_status
FROM (SELECT s.metric_date, s.partner_id, p.partner_name, s.shipments_count, coalesce(e.exception_count, 0) AS exception_count,
        q.sla_percent, {_health_sql('q.sla_percent', 'coalesce(e.exception_count, 0)', 's.shipments_count')} AS health_score
      FROM (SELECT CAST(shipment_date AS DATE) AS metric_date, partner_id, count(*) AS shipments_count
            FROM shipment_header GROUP BY 1, 2) s
      LEFT JOIN (SELECT CAST(h.shipment_date AS DATE) AS metric_date, a.partner_id, count(*) AS exception_count
                 FROM anomaly_registry a JOIN shipment_header h ON h.shipment_id = a.shipment_id GROUP BY 1, 2) e
        ON e.metric_date = s.metric_date AND e.partner_id = s.partner_id
      LEFT JOIN (SELECT metric_date, partner_id,
                   {_pct52("count(*) FILTER (WHERE sla_status = 'met')", "count(*) FILTER (WHERE sla_status <> 'pending')")} AS sla_percent
                 FROM t1 GROUP BY 1, 2) q ON q.metric_date = s.metric_date AND q.partner_id = s.partner_id
      LEFT JOIN trading_partner_master p ON p.partner_id = s.partner_id)""", TENDER))
def t11_partner_health_daily(spark, sf_dir):
    h, tx, a, p, asof = _src(spark, sf_dir, "header", "edi_tx", "anomalies", "partners", "as_of")
    return s3.partner_health_daily(h, tx, a, p, asof)


PTOT = TENDER + f""",
ptot AS (
  SELECT s.partner_id, p.partner_name, s.shipment_count, s.shipment_value,
    coalesce(an.anomaly_count, 0) AS anomaly_count, coalesce(an.critical_anomalies, 0) AS critical_anomalies,
    coalesce(an.severe_anomaly_count, 0) AS severe_anomaly_count, coalesce(an.high_anomalies, 0) AS high_anomalies,
    q.sla_compliance_pct,
    {_health_sql('q.sla_compliance_pct', 'coalesce(an.anomaly_count, 0)', 's.shipment_count')} AS health_score
  FROM (SELECT partner_id, count(*) AS shipment_count, CAST(sum(shipment_value) AS DECIMAL(28,2)) AS shipment_value
        FROM shipment_header GROUP BY 1) s
  LEFT JOIN (SELECT partner_id, count(*) AS anomaly_count, count(*) FILTER (WHERE severity = 'Critical') AS critical_anomalies,
               count(*) FILTER (WHERE severity IN ('Critical','High')) AS severe_anomaly_count,
               count(*) FILTER (WHERE severity = 'High') AS high_anomalies
             FROM anomaly_registry GROUP BY 1) an ON an.partner_id = s.partner_id
  LEFT JOIN (SELECT partner_id,
               {_pct52("count(*) FILTER (WHERE sla_status = 'met')", "count(*) FILTER (WHERE sla_status <> 'pending')")} AS sla_compliance_pct
             FROM t1 GROUP BY 1) q ON q.partner_id = s.partner_id
  LEFT JOIN trading_partner_master p ON p.partner_id = s.partner_id)"""


@register("t12_partner_scorecard", sql(S360, f"""
SELECT partner_id, partner_name, shipment_count, anomaly_count, critical_anomalies, sla_compliance_pct, health_score,
  {_risk_sql('health_score')} AS partner_risk_status FROM ptot""", PTOT))
def t12_partner_scorecard(spark, sf_dir):
    h, tx, a, p, asof = _src(spark, sf_dir, "header", "edi_tx", "anomalies", "partners", "as_of")
    return s3.partner_scorecard(h, tx, a, p, asof)


@register("t13_partner_risk", sql(S360, """
SELECT partner_id, partner_name, shipment_count AS shipment_volume, anomaly_count, severe_anomaly_count,
  round(100.0 * CAST(anomaly_count AS DOUBLE) / nullif(CAST(shipment_count AS DOUBLE), 0.0), 2) AS anomaly_rate_pct,
  shipment_value, health_score FROM ptot""", PTOT))
def t13_partner_risk(spark, sf_dir):
    h, tx, a, p, asof = _src(spark, sf_dir, "header", "edi_tx", "anomalies", "partners", "as_of")
    return s3.partner_risk(h, tx, a, p, asof)


@register("t14_control_tower_kpis", sql(S360, f"""
SELECT * FROM
 (SELECT CAST(sum(shipment_count) AS BIGINT) AS total_shipments, count(*) FILTER (WHERE shipment_count > 0) AS active_partners,
    CAST(sum(anomaly_count) AS BIGINT) AS total_anomalies, CAST(sum(critical_anomalies) AS BIGINT) AS critical_anomalies,
    CAST(sum(high_anomalies) AS BIGINT) AS high_anomalies, round(avg(health_score), 2) AS avg_partner_health_score FROM ptot),
 (SELECT {_pct52("count(*) FILTER (WHERE sla_status = 'met')", "count(*) FILTER (WHERE sla_status <> 'pending')")} AS sla_compliance_pct FROM t1)""",
    PTOT))
def t14_control_tower_kpis(spark, sf_dir):
    h, tx, a, p, asof = _src(spark, sf_dir, "header", "edi_tx", "anomalies", "partners", "as_of")
    return s3.control_tower_kpis(h, tx, a, p, asof)


@register("t15_control_tower_daily", sql(S360, f"""
SELECT s.metric_date, s.total_shipments, s.active_partners, coalesce(q.sla_met_count, 0) AS sla_met_count,
  coalesce(q.sla_breach_count, 0) AS sla_breach_count, q.sla_compliance_pct, s.total_shipment_value, s.avg_shipment_value
FROM (SELECT CAST(shipment_date AS DATE) AS metric_date, count(*) AS total_shipments, count(DISTINCT partner_id) AS active_partners,
        CAST(sum(shipment_value) AS DECIMAL(28,2)) AS total_shipment_value,
        ((2 * sum(CAST(shipment_value * 100 AS BIGINT)) + count(*)) // (2 * count(*))) / 100.0 AS avg_shipment_value
      FROM shipment_header GROUP BY 1) s
LEFT JOIN (SELECT metric_date, count(*) FILTER (WHERE sla_status = 'met') AS sla_met_count,
             count(*) FILTER (WHERE sla_status IN ('breach','missing')) AS sla_breach_count,
             {_pct52("count(*) FILTER (WHERE sla_status = 'met')", "count(*) FILTER (WHERE sla_status <> 'pending')")} AS sla_compliance_pct
           FROM t1 GROUP BY 1) q ON q.metric_date = s.metric_date""", TENDER))
def t15_control_tower_daily(spark, sf_dir):
    h, tx, p, asof = _src(spark, sf_dir, "header", "edi_tx", "partners", "as_of")
    return s3.control_tower_daily(h, tx, p, asof)


@register("t16_sla_performance_daily", sql(S360, f"""
SELECT metric_date AS shipment_date, partner_id, count(*) AS total_shipments,
  count(*) FILTER (WHERE sla_status = 'met') AS sla_met_count,
  count(*) FILTER (WHERE sla_status IN ('breach','missing')) AS sla_breach_count,
  {_pct52("count(*) FILTER (WHERE sla_status = 'met')", "count(*) FILTER (WHERE sla_status <> 'pending')")} AS sla_pct
FROM t1 GROUP BY 1, 2""", TENDER))
def t16_sla_performance_daily(spark, sf_dir):
    h, tx, p, asof = _src(spark, sf_dir, "header", "edi_tx", "partners", "as_of")
    return s3.sla_performance_daily(h, tx, p, asof)


@register("t17_daily_volume_vs_expected", sql(S360, """
SELECT d.shipment_date, d.partner_id, p.partner_name, d.actual_volume, d.expected_volume,
  round(100.0 * (d.actual_volume - d.expected_volume) / nullif(d.expected_volume, 0.0), 2) AS volume_deviation_pct
FROM (SELECT *, round(CAST(coalesce(sum(actual_volume) OVER (PARTITION BY partner_id ORDER BY dn
                 RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / 7, 2) AS expected_volume
      FROM (SELECT CAST(shipment_date AS DATE) AS shipment_date, partner_id, count(*) AS actual_volume,
              date_diff('day', DATE '1970-01-01', CAST(shipment_date AS DATE)) AS dn
            FROM shipment_header GROUP BY 1, 2, 4)) d
LEFT JOIN trading_partner_master p ON p.partner_id = d.partner_id"""))
def t17_daily_volume_vs_expected(spark, sf_dir):
    h, p = _src(spark, sf_dir, "header", "partners")
    return s3.daily_volume_vs_expected(h, p)


@register("t18_status_aging", sql(S360, f"""
SELECT *, CASE WHEN aging_ratio >= 2 THEN 'Critical' WHEN aging_ratio >= 1.5 THEN 'High'
               WHEN aging_ratio >= 1 THEN 'Medium' ELSE 'Normal' END AS aging_severity,
  current_status || ' for ' || CAST(CAST(actual_hours_in_status AS DECIMAL(18,2)) AS VARCHAR) || 'h vs '
    || CAST(expected_hours_in_status AS VARCHAR) || 'h expected' AS aging_insight
FROM (SELECT * EXCLUDE (us), ((2 * us + 36000000 * CAST(expected_hours_in_status AS BIGINT))
          // (2 * 36000000 * CAST(expected_hours_in_status AS BIGINT))) / 100.0 AS aging_ratio
  FROM (SELECT h.shipment_id, h.partner_id, p.partner_name, h.carrier_id, h.shipment_status AS current_status, h.shipment_status AS header_status,
          l.status_timestamp, CAST(l.status_timestamp AS DATE) AS metric_date,
          round(CAST(date_diff('microsecond', l.status_timestamp, {AS_OF}) AS DOUBLE) / 3600000000.0, 2) AS actual_hours_in_status,
          date_diff('microsecond', l.status_timestamp, {AS_OF}) AS us,
          CASE h.shipment_status WHEN 'Booked' THEN 24 WHEN 'In Transit' THEN 72 WHEN 'Delivered' THEN 720 ELSE 24 END AS expected_hours_in_status
        FROM shipment_header h
        JOIN (SELECT shipment_id, max(transaction_timestamp) AS status_timestamp FROM edi_transactions GROUP BY 1) l
          ON l.shipment_id = h.shipment_id
        LEFT JOIN trading_partner_master p ON p.partner_id = h.partner_id))"""))
def t18_status_aging(spark, sf_dir):
    h, tx, p, asof = _src(spark, sf_dir, "header", "edi_tx", "partners", "as_of")
    return s3.status_aging(h, tx, p, asof)


@register("t19_delay_history", sql(S360, """
SELECT shipment_id, partner_id, partner_name, shipment_date, delay_hours,
  CASE WHEN delay_hours <= 0 THEN 'On time' ELSE 'Late' END AS delivery_performance,
  CASE WHEN delay_hours <= 0 THEN 'On time' WHEN delay_hours < 24 THEN 'Minor' WHEN delay_hours < 72 THEN 'Moderate'
       ELSE 'Severe' END AS delay_severity, shipment_value
FROM (SELECT h.*, p.partner_name,
        round(CAST(date_diff('microsecond', h.promised_delivery_date, h.actual_delivery_date) AS DOUBLE) / 3600000000.0, 2) AS delay_hours
      FROM shipment_header h LEFT JOIN trading_partner_master p ON p.partner_id = h.partner_id
      WHERE h.actual_delivery_date IS NOT NULL)"""))
def t19_delay_history(spark, sf_dir):
    h, p = _src(spark, sf_dir, "header", "partners")
    return s3.delay_history(h, p)


@register("t20_status_distribution", sql(S360, """
SELECT s.partner_id, s.current_status, s.shipment_count, p.partner_name
FROM (SELECT partner_id, shipment_status AS current_status, count(*) AS shipment_count FROM shipment_header GROUP BY 1, 2) s
LEFT JOIN trading_partner_master p ON p.partner_id = s.partner_id"""))
def t20_status_distribution(spark, sf_dir):
    h, p = _src(spark, sf_dir, "header", "partners")
    return s3.status_distribution(h, p)


@register("t21_root_cause", sql(["anomaly_registry"], """
SELECT anomaly_type, severity, partner_id, count(*) AS anomaly_count FROM anomaly_registry GROUP BY 1, 2, 3"""))
def t21_root_cause(spark, sf_dir):
    return s3.root_cause(_src(spark, sf_dir, "anomalies")[0])


# ---------------------------------------------------------------------- API
API = ["api_transactions", "trading_partner_master", "shipment_header"]


@register("j11_api_detail", sql(API, """
WITH modes AS (SELECT shipment_id, transport_mode FROM shipment_header),
names AS (SELECT partner_id, partner_name, industry_segment FROM trading_partner_master)
SELECT calls.* EXCLUDE (created_at), request_ts::DATE AS request_date, retry_count <> 0 AS retried,
  partner_name, industry_segment, transport_mode
FROM api_transactions calls LEFT JOIN names USING (partner_id) LEFT JOIN modes USING (shipment_id)"""))
def j11_api_detail(spark, sf_dir):
    w = W(spark, sf_dir)
    return api.api_detail(w.api(), w.partners(), w.header())


# Calls are summed per partner first; the partner's name and segment join the sums.
@register("a27_api_summary", sql(API, """
WITH sums AS (
  SELECT partner_id, count(*) AS total_calls, count_if(success) AS good, count_if(sla_met) AS quick, count_if(retry_count > 0) AS again,
    count_if(is_webhook) AS webhook_calls, count_if(is_webhook AND webhook_delivered) AS delivered,
    histogram(status_class) AS classes, count_if(rate_limited) AS rate_limited_cnt, round(avg(latency_ms)) AS avg_latency_ms,
    round(quantile_cont(latency_ms, 0.95)) AS p95_latency_ms, min(request_ts) AS first_call_ts, max(request_ts) AS last_call_ts
  FROM api_transactions GROUP BY ALL)
SELECT COLUMNS(['partner_id', 'total_calls', 'webhook_calls', 'rate_limited_cnt', 'avg_latency_ms', 'p95_latency_ms',
    'first_call_ts', 'last_call_ts']), partner_name, industry_segment,
  round(100.0 * (good::DOUBLE / total_calls), 1) AS success_pct, round(100.0 * (quick::DOUBLE / total_calls), 1) AS latency_sla_pct,
  round(100.0 * (again::DOUBLE / total_calls), 1) AS retry_pct,
  CAST(coalesce(classes['4xx'], 0) AS BIGINT) AS err_4xx, CAST(coalesce(classes['5xx'], 0) AS BIGINT) AS err_5xx,
  round(100.0 * delivered::DOUBLE / nullif(webhook_calls, 0), 1) AS webhook_delivery_pct
FROM sums LEFT JOIN (SELECT partner_id, partner_name, industry_segment FROM trading_partner_master) USING (partner_id)"""))
def a27_api_summary(spark, sf_dir):
    w = W(spark, sf_dir)
    return api.api_summary(w.api(), w.partners())
