"""DuckDB text of the contract adapter (an independent second implementation).

Each oracle query is ``world_sql(needed) + "<query>"``: a WITH list that
rebuilds the contract tables from the pre-registered driver views with the
same rules as ``flowlens.sources.fixtures``.  Only the CTEs a query needs
(and what they depend on) are emitted.
"""

from __future__ import annotations

# The newest tender's instant, from the data (CTE ``world_now``).
AS_OF = "(SELECT ts FROM world_now)"

_CTES: dict[str, tuple[list[str], str]] = {}


def _cte(name: str, deps: list[str], body: str) -> None:
    _CTES[name] = (deps, body)


_cte("base", [], f"""
SELECT o.o_orderkey AS k, o.o_custkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate, o.o_orderpriority,
       'ORD-' || lpad(CAST(o.o_orderkey AS VARCHAR), 9, '0') AS interchange_id,
       n.n_name AS partner, n.n_nationkey, c.c_mktsegment AS lob,
       CASE WHEN o.o_custkey % 8 = 0 THEN 'uat' ELSE 'prod' END AS environment,
       CASE o.o_custkey % 5 WHEN 0 THEN 'as2' WHEN 1 THEN 'sftp' WHEN 2 THEN 'van' WHEN 3 THEN 'mq' ELSE 'api' END AS channel,
       CASE WHEN o.o_custkey % 5 = 4 THEN 'api' ELSE 'edi' END AS protocol,
       o.o_orderdate + to_hours(CAST(o.o_orderkey % 24 AS BIGINT)) AS t0
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey""")

_cte("world_now", ["base"], "SELECT max(t0) AS ts FROM base")

_cte("skel", ["base"], """
SELECT *, 204 AS doc, 0 AS ln, t0 AS event_time, 'out' AS direction FROM base
UNION ALL
SELECT *, 990, 0, t0 + to_minutes(CAST((k * 37) % 600 AS BIGINT)), 'in' FROM base WHERE k % 20 <> 0
UNION ALL
SELECT *, 210, 0, t0 + to_hours(CAST(48 + k % 48 AS BIGINT)), 'in' FROM base WHERE o_orderstatus = 'F'
UNION ALL
SELECT b.*, 214, l.ln, b.t0 + to_hours(CAST(l.ln * 9 + b.k % 11 AS BIGINT)), 'in'
FROM base b JOIN (SELECT DISTINCT l_orderkey, l_linenumber AS ln FROM lineitem) l ON b.k = l.l_orderkey""")

_cte("skel2", ["skel"], """
SELECT *,
  CASE WHEN (k*31 + doc*17 + ln*7) % 100 < 4 THEN 'failed'
       WHEN (k*31 + doc*17 + ln*7) % 100 < 8 THEN 'rejected'
       WHEN (k*31 + doc*17 + ln*7) % 100 < 10 AND doc = 214 THEN 'duplicate'
       ELSE 'ok' END AS status
FROM skel""")

_cte("skel3", ["skel2"], """
SELECT *,
  (status IN ('ok','duplicate') AND NOT (doc = 214 AND o_orderstatus = 'O' AND k % 5 = 0)) AS terminal,
  CASE WHEN status = 'failed' AND k % 2 = 0 THEN CAST(1 + k % 3 AS INTEGER) ELSE 0 END AS rc
FROM skel2""")

_cte("txn_events", ["skel3"], """
SELECT CAST((k*1000 + doc)*100 + ln AS BIGINT) AS event_id,
  event_time, interchange_id,
  concat_ws('-', interchange_id, CAST(doc AS VARCHAR), CAST(ln AS VARCHAR)) AS business_ref,
  environment, lob, partner, channel, protocol, direction,
  CAST(doc AS VARCHAR) AS doc_type,
  CASE WHEN NOT terminal AND k % 3 = 0 THEN 'received' ELSE 'acked' END AS stage,
  status,
  CASE WHEN status = 'failed' THEN (CASE k % 4 WHEN 0 THEN 'connectivity' WHEN 1 THEN 'mapping_defect' WHEN 2 THEN 'ack_timeout' ELSE NULL END)
       WHEN status = 'rejected' THEN (CASE k % 3 WHEN 0 THEN 'validation_error' WHEN 1 THEN 'bad_input_file' ELSE NULL END)
       WHEN status = 'duplicate' THEN 'duplicate_interchange' END AS reason_category,
  terminal,
  event_time + to_hours(CAST(CASE k % 3 WHEN 0 THEN 4 WHEN 1 THEN 8 ELSE 24 END AS BIGINT)) AS sla_due_at,
  CASE WHEN doc = 204 THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS value_usd,
  CAST(5 + k % 36 AS DECIMAL(18,2)) AS kchar,
  CASE WHEN status IN ('failed','rejected') THEN 'E' || CAST(k % 5 AS VARCHAR) END AS error_code,
  rc > 0 AS replayed,
  CASE WHEN rc > 0 THEN event_time + INTERVAL 1 HOUR END AS replayed_at,
  rc AS replay_count,
  'CN' || CAST(k AS VARCHAR) || '-' || CAST(doc AS VARCHAR) || '-'
       || CAST(CASE WHEN status = 'duplicate' THEN ln - 1 ELSE ln END AS VARCHAR) AS control_number
FROM skel3""")

_cte("acks", ["base"], """
SELECT CAST((k*1000 + 997)*100 AS BIGINT) AS event_id, t0 + INTERVAL 30 MINUTE AS event_time,
  interchange_id, interchange_id || '-997-0' AS business_ref,
  environment, lob, partner, channel, protocol, 'in' AS direction, '997' AS doc_type, 'acked' AS stage,
  CASE WHEN k % 17 = 0 THEN 'rejected' ELSE 'ok' END AS status,
  CASE WHEN k % 17 = 0 THEN 'rejected_by_partner' END AS reason_category,
  TRUE AS terminal, CAST(NULL AS TIMESTAMP) AS sla_due_at,
  CAST(0 AS DECIMAL(18,2)) AS value_usd, CAST(1 AS DECIMAL(18,2)) AS kchar,
  CAST(NULL AS VARCHAR) AS error_code, FALSE AS replayed, CAST(NULL AS TIMESTAMP) AS replayed_at,
  0 AS replay_count, 'CN' || CAST(k AS VARCHAR) || '-204-0' AS control_number
FROM base WHERE k % 10 <> 0""")

_cte("events_all", ["txn_events", "acks"], """
SELECT * FROM txn_events UNION ALL SELECT * FROM acks""")

_cte("txn_files", ["base", "txn_events"], """
SELECT b.interchange_id, b.interchange_id || '.x12' AS file_name,
  b.environment, b.partner, b.channel, b.protocol,
  CASE WHEN b.k % 8 = 0 THEN 'in' ELSE 'out' END AS direction,
  b.t0 AS received_at,
  CASE WHEN b.k % 40 = 0 OR b.k % 3 <> 0 THEN b.t0 + INTERVAL 5 MINUTE END AS completed_at,
  CASE WHEN b.k % 40 = 0 THEN 'rejected' WHEN b.k % 3 = 0 THEN 'received' ELSE 'delivered' END AS status,
  CASE WHEN b.k % 40 = 0 THEN 'bad_input_file' END AS reason_category,
  CASE WHEN b.k % 40 <> 0 THEN CAST(coalesce(ch.children, 0) + CASE WHEN b.k % 12 = 0 THEN 2 ELSE 0 END AS INTEGER) END AS declared_txn_count,
  lpad(CAST(b.k AS VARCHAR), 9, '0') AS isa_control, CAST(b.k AS VARCHAR) AS gs_control,
  CAST(b.o_totalprice AS DECIMAL(18,2)) AS value_usd,
  CAST((5 + b.k % 36) * coalesce(ch.children, 0) AS DECIMAL(18,2)) AS kchar
FROM base b LEFT JOIN (SELECT interchange_id, count(*) AS children FROM txn_events GROUP BY 1) ch
  ON ch.interchange_id = b.interchange_id""")

_cte("ops_expected_feeds", ["txn_events"], f"""
SELECT partner, doc_type, channel, environment,
  {AS_OF} + to_minutes(CAST(120 - (n * 13) % 240 AS BIGINT)) AS expected_next_at,
  CAST(CASE n % 3 WHEN 0 THEN 15 WHEN 1 THEN 30 ELSE 60 END AS INTEGER) AS grace_minutes,
  CASE WHEN n % 11 <> 0 THEN seen END AS last_seen_at
FROM (SELECT partner, doc_type, channel, environment, max(event_time) AS seen, count(*) AS n
      FROM txn_events GROUP BY 1, 2, 3, 4)""")

_cte("ops_monitor_heartbeat", ["txn_events"], """
SELECT 'sweep_' || channel || '_' || environment AS monitor_name, channel, environment, last_run_at,
  CAST(CASE n % 4 WHEN 0 THEN 300 WHEN 1 THEN 900 WHEN 2 THEN 3600 ELSE 86400 END AS INTEGER) AS expected_interval_sec
FROM (SELECT channel, environment, max(event_time) AS last_run_at, count(*) AS n FROM txn_events GROUP BY 1, 2)""")

_cte("ops_endpoint_health", [], f"""
SELECT CASE s.s_suppkey % 5 WHEN 0 THEN 'as2' WHEN 1 THEN 'sftp' WHEN 2 THEN 'van' WHEN 3 THEN 'mq' ELSE 'api' END AS channel,
  s.s_name AS endpoint, n.n_name AS partner,
  CASE WHEN s.s_suppkey % 8 = 0 THEN 'uat' ELSE 'prod' END AS environment,
  CASE WHEN s.s_suppkey % 10 = 0 THEN 'down' WHEN s.s_suppkey % 10 = 1 THEN 'degraded' ELSE 'up' END AS status,
  {AS_OF} - to_hours(CAST(s.s_suppkey % 48 AS BIGINT)) AS last_ok_at,
  CAST({AS_OF} AS DATE) + CAST(s.s_suppkey % 30 AS INTEGER) AS cert_expires_at
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey""")

_cte("ops_pipeline_health", [], f"""
SELECT 'pl_' || CAST(s_suppkey AS VARCHAR) AS pipeline,
  CASE WHEN s_suppkey % 8 = 0 THEN 'uat' ELSE 'prod' END AS environment,
  CASE s_suppkey % 7 WHEN 0 THEN 'running' WHEN 1 THEN 'running' WHEN 2 THEN 'idle' WHEN 3 THEN 'running'
       WHEN 4 THEN 'stopped' WHEN 5 THEN 'running' ELSE 'idle' END AS state,
  CAST(CASE WHEN s_suppkey % 3 <> 0 THEN (s_suppkey * 13) % 50 ELSE 0 END AS BIGINT) AS queue_depth,
  CAST(CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey * 7) % 20 ELSE 0 END AS BIGINT) AS mq_depth,
  CAST(CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE (s_suppkey % 9) * 1.5 END AS DECIMAL(18,2)) AS consume_rate,
  {AS_OF} - to_minutes(CAST(s_suppkey % 120 AS BIGINT)) AS last_consumed_at
FROM supplier""")

_cte("ref_partner_penalty", [], """
SELECT n_name AS partner, d.doc_type, CAST(d.p AS DECIMAL(18,2)) AS penalty_usd
FROM nation, (VALUES ('204', 250), ('210', 400)) d(doc_type, p)
WHERE n_nationkey % 5 = 0""")

_cte("ref_partner_profile", [], """
SELECT n.n_name AS partner,
  CASE n.n_nationkey % 3 WHEN 0 THEN 'Strategic' WHEN 1 THEN 'Preferred' ELSE 'Standard' END AS tier,
  CASE WHEN n.n_nationkey % 7 = 6 THEN 'Onboarding' ELSE 'Live' END AS onboarding_status,
  r.r_name AS region
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""")

_cte("sla_rules", [], """
SELECT * FROM (VALUES
  (1, '204-990 tender response', 'prod', NULL, '204', 'out', '990', 'in', 'interchange_id', 240),
  (2, '204-214 first status', 'prod', NULL, '204', 'out', '214', 'in', 'interchange_id', 1440),
  (3, '204-210 invoice', 'prod', NULL, '204', 'out', '210', 'in', 'interchange_id', 4320),
  (4, '204-990 NATION_3 tight', 'prod', 'NATION_3', '204', 'out', '990', 'in', 'interchange_id', 60),
  (5, '204-990 uat', 'uat', NULL, '204', 'out', '990', 'in', 'interchange_id', 240),
  (6, 'inbound-997 func ack', 'prod', NULL, NULL, 'in', '997', 'out', 'interchange_id', 15),
  (7, '204-997 functional ack', 'prod', NULL, '204', 'out', '997', 'in', 'control_number', 60)
) t(rule_id, name, environment, partner, trigger_doc_type, trigger_direction, response_doc_type,
    response_direction, correlation_key, threshold_minutes)""")

_cte("diagnostic_rules", [], """
SELECT * FROM (VALUES
  (1, NULL, 'connectivity', 'E0', 'Endpoint unreachable', 'Retry after endpoint check', 'rb/connectivity'),
  (2, NULL, 'mapping_defect', 'E1', 'Map version drift', 'Redeploy map', 'rb/mapping'),
  (3, 'NATION_1', 'mapping_defect', 'E1', 'Partner sends old layout', 'Ask partner to resend', 'rb/nation1'),
  (4, NULL, 'validation_error', NULL, 'Never matches (NULL code)', 'n/a', 'rb/none'),
  (5, NULL, 'validation_error', 'E3', 'Bad segment count', 'Fix envelope', 'rb/validation'),
  (6, NULL, 'ack_timeout', 'E2', 'Partner slow to ack', 'Chase partner', 'rb/ack')
) t(rule_id, partner, reason_category, error_code, likely_cause, suggested_action, runbook_url)""")

_cte("doc_type_catalog", [], """
SELECT * FROM (VALUES
  ('204', 'Load tender', 'Transportation', 'out', 240),
  ('990', 'Tender response', 'Transportation', 'in', 240),
  ('214', 'Shipment status', 'Visibility', 'in', 1440),
  ('997', 'Functional ack', 'Acknowledgment', 'in', 60)
) t(doc_type, label, business_family, typical_direction, sla_minutes)""")

_cte("feed_events", [], """
SELECT event_id, ts AS event_time, 'prod' AS environment, 'feed' AS lob,
  'P' || CAST(user_id % 3 AS VARCHAR) AS partner, 'api' AS channel, 'api' AS protocol, 'in' AS direction,
  event_type AS doc_type, CASE WHEN event_id % 50 = 0 THEN 'failed' ELSE 'ok' END AS status,
  TRUE AS terminal, CAST(NULL AS TIMESTAMP) AS sla_due_at,
  CAST(0 AS DECIMAL(18,2)) AS value_usd, CAST(1 AS DECIMAL(18,2)) AS kchar
FROM events""")

_cte("api_transactions", [], """
SELECT api_call_id, shipment_id, partner_id, carrier_id, api_operation, endpoint, http_method, is_webhook,
  request_ts, response_ts, latency_ms, http_status,
  CASE WHEN http_status < 300 THEN '2xx' WHEN http_status < 500 THEN '4xx' ELSE '5xx' END AS status_class,
  http_status < 400 AS success,
  CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS retry_count,
  http_status = 429 AS rate_limited,
  CASE WHEN is_webhook THEN http_status < 400 END AS webhook_delivered,
  CASE WHEN http_status >= 400 THEN 'HTTP' || CAST(http_status AS VARCHAR) END AS error_code,
  CASE WHEN http_status >= 400 THEN 'status ' || CAST(http_status AS VARCHAR) END AS error_message,
  'COR-' || CAST(event_id AS VARCHAR) AS correlation_id,
  400 AS target_latency_ms, latency_ms <= 400 AS sla_met, request_ts AS created_at
FROM (
  SELECT e.event_id, 'API-' || CAST(e.event_id AS VARCHAR) AS api_call_id,
    CASE WHEN e.event_type <> 'signup' THEN 'ORD-' || lpad(CAST(e.event_id AS VARCHAR), 9, '0') END AS shipment_id,
    n.n_name AS partner_id, 'CAR-' || CAST(e.user_id % 7 AS VARCHAR) AS carrier_id,
    e.event_type AS api_operation, '/v1/' || e.event_type AS endpoint,
    CASE WHEN e.event_type = 'view' THEN 'GET' ELSE 'POST' END AS http_method,
    e.event_type IN ('view', 'click') AS is_webhook,
    e.ts AS request_ts,
    e.ts + to_milliseconds(CAST(15 + floor(e.value * 10) AS BIGINT)) AS response_ts,
    CAST(15 + floor(e.value * 10) AS INTEGER) AS latency_ms,
    CAST(CASE WHEN CAST(json_extract_string(e.props, '$.k') AS INTEGER) < 85 THEN 200
              WHEN CAST(json_extract_string(e.props, '$.k') AS INTEGER) < 90 THEN 400
              WHEN CAST(json_extract_string(e.props, '$.k') AS INTEGER) < 93 THEN 429 ELSE 503 END AS INTEGER) AS http_status
  FROM events e JOIN nation n ON e.user_id % 25 = n.n_nationkey)""")

_cte("shipment_header", ["base"], """
SELECT interchange_id AS shipment_id, partner AS partner_id, 'CAR-' || CAST(k % 7 AS VARCHAR) AS carrier_id,
  CASE k % 4 WHEN 0 THEN 'TL' WHEN 1 THEN 'LTL' WHEN 2 THEN 'IM' ELSE 'AIR' END AS transport_mode,
  o_orderpriority AS priority,
  CASE WHEN o_orderstatus = 'F' THEN 'Delivered' WHEN o_orderstatus = 'O' THEN 'In Transit' ELSE 'Booked' END AS shipment_status,
  o_orderdate AS shipment_date,
  o_orderdate + to_days(CAST(3 + k % 5 AS INTEGER)) AS promised_delivery_date,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_days(CAST(2 + k % 8 AS INTEGER)) END AS actual_delivery_date,
  CAST(o_totalprice AS DECIMAL(18,2)) AS shipment_value
FROM base""")

_cte("trading_partner_master", [], """
SELECT n.n_name AS partner_id, 'Partner ' || n.n_name AS partner_name, r.r_name AS industry_segment,
  CAST(120 + 10 * n.n_nationkey AS INTEGER) AS expected_204_990_minutes
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""")

_cte("edi_transactions", ["txn_events", "acks"], """
SELECT e.business_ref AS transaction_id, e.interchange_id AS shipment_id, e.partner AS partner_id,
  'CAR-' || CAST(CAST(regexp_extract(e.interchange_id, 'ORD-0*(\\d+)', 1) AS BIGINT) % 7 AS VARCHAR) AS carrier_id,
  e.doc_type AS transaction_type, upper(e.direction) AS transaction_direction, e.status AS processing_status,
  e.control_number, e.error_code, e.reason_category AS error_description,
  e.event_time AS transaction_timestamp, a.event_time AS ack_timestamp, e.event_time AS created_at,
  e.doc_type = '204' AS ack_required, (e.doc_type = '204' AND a.event_time IS NOT NULL) AS ack_received
FROM txn_events e LEFT JOIN acks a ON e.interchange_id = a.interchange_id AND e.doc_type = '204'
UNION ALL
SELECT business_ref, interchange_id, partner,
  'CAR-' || CAST(CAST(regexp_extract(interchange_id, 'ORD-0*(\\d+)', 1) AS BIGINT) % 7 AS VARCHAR),
  doc_type, upper(direction), status, control_number, error_code, reason_category,
  event_time, CAST(NULL AS TIMESTAMP), event_time, FALSE, FALSE
FROM acks""")

_cte("anomaly_found", ["base", "txn_events", "acks"], """
SELECT b.k, '990' AS doc, 'MISSING_990' AS kind, 'Critical' AS severity, b.t0 + INTERVAL 4 HOUR AS at, 0 AS actual, 1 AS expected
FROM base b WHERE NOT EXISTS (SELECT 1 FROM txn_events e WHERE e.interchange_id = b.interchange_id AND e.doc_type = '990')
UNION ALL
SELECT b.k, '990', 'LATE_990', 'High', e.event_time, date_diff('minute', b.t0, e.event_time), 240
FROM base b JOIN txn_events e USING (interchange_id)
WHERE e.doc_type = '990' AND e.event_time > b.t0 + INTERVAL 4 HOUR
UNION ALL
SELECT b.k, '204', 'MISSING_997', 'Medium', b.t0 + INTERVAL 1 HOUR, 0, 1
FROM base b ANTI JOIN acks a USING (interchange_id)
UNION ALL
SELECT b.k, '204', 'REJECTED_204', 'High', b.t0, 0, 1
FROM base b JOIN txn_events e USING (interchange_id) WHERE e.doc_type = '204' AND e.status IN ('failed', 'rejected')
UNION ALL
SELECT b.k, '214', 'STATUS_AGING', 'Medium', b.t0 + INTERVAL 1 DAY, 0, 1
FROM base b SEMI JOIN (SELECT * FROM txn_events WHERE doc_type = '214' AND status = 'ok' AND NOT terminal) USING (interchange_id)
UNION ALL
SELECT k, '214', 'LATE_DELIVERY', 'Low', o_orderdate + to_days(CAST(2 + k % 8 AS INTEGER)), 2 + k % 8, 3 + k % 5
FROM base WHERE o_orderstatus = 'F' AND 2 + k % 8 > 3 + k % 5""")

_cte("anomaly_registry", ["base", "anomaly_found"], """
SELECT 'ANO-' || CAST(k AS VARCHAR) || '-' || f.kind AS anomaly_id, b.interchange_id AS shipment_id, b.partner AS partner_id,
  'CAR-' || CAST(k % 7 AS VARCHAR) AS carrier_id, f.doc AS transaction_type, f.kind AS anomaly_type, f.severity,
  ['Open', 'In Progress', 'Resolved'][1 + k % 3] AS anomaly_status,
  CASE b.o_orderstatus WHEN 'F' THEN 'Delivered' WHEN 'O' THEN 'In Transit' ELSE 'Booked' END AS current_status,
  ['Partner system', 'Mapping', 'Network', 'Carrier'][1 + k % 4] AS root_cause_category,
  'Review ' || f.kind AS recommended_action, f.at AS detected_timestamp, f.at AS created_at,
  CAST(b.o_totalprice AS DECIMAL(14,2)) AS business_impact_amount,
  CAST(f.actual AS DECIMAL(14,2)) AS actual_value, CAST(f.expected AS DECIMAL(14,2)) AS expected_value,
  CAST(CAST(f.actual - f.expected AS DOUBLE) * 100 / f.expected AS DECIMAL(8,2)) AS deviation_percent
FROM base b JOIN anomaly_found f USING (k)""")


def world_sql(*needed: str) -> str:
    """``WITH`` list holding ``needed`` CTEs and their dependencies, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        deps, body = _CTES[name]
        for d in deps + (["world_now"] if AS_OF in body else []):
            visit(d)
        order.append(name)

    for n in needed:
        visit(n)
    parts = [f"{n} AS ({_CTES[n][1]}\n)" for n in order]
    return "WITH " + ",\n".join(parts) + "\n"


def with_world(needed: list[str], extra_ctes: str, final: str) -> str:
    """Compose world CTEs + query-specific CTEs (``name AS (...)`` list) + final SELECT."""
    now = ["world_now"] if AS_OF in extra_ctes + final else []
    head = world_sql(*now, *needed)
    if extra_ctes.strip():
        head = head.rstrip() + ",\n" + extra_ctes.strip() + "\n"
    # A text with a WITH list of its own becomes a subquery of the whole.
    return head + (f"SELECT * FROM ({final.strip()})" if final.lstrip().startswith("WITH") else final)
