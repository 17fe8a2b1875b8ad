"""Contract tables derived from the driver's parquet tables.

The reference ships no data, only the table contracts.  This adapter fills
those contracts deterministically from the TPC-H-ish driver tables so every
operator's work grows with the input: one order becomes one 204 tender, one
990 response, one 214 per distinct line and one 210 invoice (closed orders),
plus functional acks, files, monitor state, API calls and the shipment-360
sources.  The rules are written down in FIXTURES.md (section B); the DuckDB
text of the same rules lives in ``flowlens.plans.oracle``.

Everything is a lazy DataFrame built from column expressions.  The only
broadcasts are of ``nation`` (25 rows by the TPC-H definition) -- every
other join is left to AQE, because customer/supplier grow with the data.
"""

from __future__ import annotations

import datetime as _dt
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.timeutil import (
    add_days, add_hours, add_minutes, as_of_col, micros_between, pick)
from flowlens.sources.driver import read_table

# ---------------------------------------------------------------------------
# Fixed values of the adapter (FIXTURES.md section B).
# ---------------------------------------------------------------------------
CHANNELS = ["as2", "sftp", "van", "mq", "api"]
FAILED_REASONS = ["connectivity", "mapping_defect", "ack_timeout", None]
REJECTED_REASONS = ["validation_error", "bad_input_file", None]
SLA_HOURS = [4, 8, 24]
TIERS = ["Strategic", "Preferred", "Standard"]
TRANSPORT_MODES = ["TL", "LTL", "IM", "AIR"]
RESPONSE_MINUTES = 240
ANOMALY_STATES = ["Open", "In Progress", "Resolved"]
ROOT_CAUSES = ["Partner system", "Mapping", "Network", "Carrier"]
PIPELINE_STATES = ["running", "running", "idle", "running", "stopped", "running", "idle"]
HEARTBEAT_INTERVALS = [300, 900, 3600, 86400]
GRACE_MINUTES = [15, 30, 60]

EVENT_COLUMNS = [
    "event_id", "event_time", "interchange_id", "business_ref", "environment", "lob",
    "partner", "channel", "protocol", "direction", "doc_type", "stage", "status",
    "reason_category", "terminal", "sla_due_at", "value_usd", "kchar", "error_code",
    "replayed", "replayed_at", "replay_count", "control_number",
]


def _k() -> Column:
    return F.col("k")


def order_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with the dimensions every message of it carries."""
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer")
    n = F.broadcast(read_table(spark, sf_dir, "nation"))  # 25 rows, fixed size
    k = F.col("o_orderkey")
    base = (o.join(c, o.o_custkey == c.c_custkey)
             .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
             .select(k.alias("k"), "o_custkey", "o_orderstatus", "o_totalprice",
                     "o_orderdate", "o_orderpriority",
                     F.concat(F.lit("ORD-"), F.lpad(k.cast("string"), 9, "0")).alias("interchange_id"),
                     F.col("n_name").alias("partner"), "n_nationkey",
                     F.col("c_mktsegment").alias("lob"),
                     F.when(F.col("o_custkey") % 8 == 0, "uat").otherwise("prod").alias("environment"),
                     pick(F.col("o_custkey") % 5, CHANNELS).alias("channel"),
                     add_hours(F.col("o_orderdate"), (k % 24).cast("int")).alias("t0")))
    return base.withColumn("protocol", F.when(F.col("channel") == "api", "api").otherwise("edi"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with its updates to be: a 214 per distinct line number (``lines``; an order without any: null).

    The pair (order, line number) is not unique in lineitem.  A line number stands in a struct, so that a null one counts like
    the others.
    """
    lines = (read_table(spark, sf_dir, "lineitem").filter(F.col("l_orderkey").isNotNull())
             .groupBy("l_orderkey").agg(F.collect_set(F.struct(F.lit(214).alias("doc"), F.col("l_linenumber").alias("ln"))).alias("lines")))
    base = order_base(spark, sf_dir)
    return base.join(lines, base.k == lines.l_orderkey, "left").drop("l_orderkey")


def _message_skeleton(orders: DataFrame) -> DataFrame:
    """(order dims, doc, ln, event_time, direction) for every lifecycle message, made order by order."""
    k, t0, doc, ln = _k(), F.col("t0"), F.col("m.doc"), F.col("m.ln")
    line = orders.schema["lines"].dataType
    single = F.array(*[F.struct(F.lit(d).alias("doc"), F.lit(0).alias("ln")) for d in (204, 990, 210)]).cast(line)
    dims = [c for c in orders.columns if c != "lines"]
    kept = F.when(doc == 990, k % 20 != 0).when(doc == 210, F.col("o_orderstatus") == "F").otherwise(True)
    at = (F.when(doc == 204, t0).when(doc == 990, add_minutes(t0, ((k * 37) % 600).cast("int")))
           .when(doc == 210, add_hours(t0, (48 + k % 48).cast("int")))
           .otherwise(add_hours(t0, (ln * 9 + k % 11).cast("int"))))
    return (orders.select(*dims, F.explode(F.concat(single, F.coalesce("lines", F.array().cast(line)))).alias("m")).filter(kept)
                  .select(*dims, doc.alias("doc"), ln.alias("ln"), at.alias("event_time"),
                          F.when(doc == 204, "out").otherwise("in").alias("direction")))


def _contract_columns(df: DataFrame) -> DataFrame:
    """Derive the txn_events contract columns from (k, doc, ln, event_time, dims)."""
    k, doc, ln = _k(), F.col("doc"), F.col("ln")
    h = (k * 31 + doc * 17 + ln * 7) % 100
    status = (F.when(h < 4, "failed").when(h < 8, "rejected")
               .when((h < 10) & (doc == 214), "duplicate").otherwise("ok"))
    df = df.withColumn("status", status)
    terminal = (F.col("status").isin("ok", "duplicate")
                & ~((doc == 214) & (F.col("o_orderstatus") == "O") & (k % 5 == 0)))
    df = df.withColumn("terminal", terminal)
    failed = F.col("status") == "failed"
    rejected = F.col("status") == "rejected"
    replay_count = F.when(failed & (k % 2 == 0), (1 + k % 3).cast("int")).otherwise(F.lit(0))
    ctl_ln = F.when(F.col("status") == "duplicate", ln - 1).otherwise(ln)
    return df.select(
        ((k * 1000 + doc) * 100 + ln).cast("bigint").alias("event_id"),
        "event_time",
        "interchange_id",
        F.concat_ws("-", "interchange_id", doc.cast("string"), ln.cast("string")).alias("business_ref"),
        "environment", "lob", "partner", "channel", "protocol", "direction",
        doc.cast("string").alias("doc_type"),
        F.when(~F.col("terminal") & (k % 3 == 0), "received").otherwise("acked").alias("stage"),
        "status",
        F.when(failed, pick(k % 4, FAILED_REASONS))
         .when(rejected, pick(k % 3, REJECTED_REASONS))
         .when(F.col("status") == "duplicate", "duplicate_interchange").alias("reason_category"),
        "terminal",
        add_hours(F.col("event_time"), pick(k % 3, SLA_HOURS).cast("int")).alias("sla_due_at"),
        F.when(doc == 204, F.col("o_totalprice").cast("decimal(18,2)"))
         .otherwise(F.lit(0).cast("decimal(18,2)")).alias("value_usd"),
        (5 + k % 36).cast("decimal(18,2)").alias("kchar"),
        F.when(failed | rejected, F.concat(F.lit("E"), (k % 5).cast("string"))).alias("error_code"),
        (replay_count > 0).alias("replayed"),
        F.when(replay_count > 0, add_hours(F.col("event_time"), 1)).alias("replayed_at"),
        replay_count.alias("replay_count"),
        F.concat(F.lit("CN"), k.cast("string"), F.lit("-"), doc.cast("string"), F.lit("-"),
                 ctl_ln.cast("string")).alias("control_number"),
    )


def txn_events(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """The message-event fact table (one row per message; 204/990/214/210)."""
    return _contract_columns(_message_skeleton(order_lines(spark, sf_dir) if orders is None else orders))


def latest_tender(events: DataFrame) -> DataFrame:
    """One row: the instant of the newest tender, the ``as_of`` of the derived tables."""
    return events.filter(F.col("doc_type") == "204").agg(F.max("event_time").alias("as_of"))


def ack_events(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """997 functional acks: one per tender with k % 10 <> 0, 30 minutes later."""
    k = _k()
    base = (order_base(spark, sf_dir) if orders is None else orders).filter(k % 10 != 0)
    t = add_minutes(F.col("t0"), 30)
    rejected = k % 17 == 0
    return (base.select(
        ((k * 1000 + 997) * 100).cast("bigint").alias("event_id"),
        t.alias("event_time"),
        "interchange_id",
        F.concat(F.col("interchange_id"), F.lit("-997-0")).alias("business_ref"),
        "environment", "lob", "partner", "channel", "protocol",
        F.lit("in").alias("direction"),
        F.lit("997").alias("doc_type"),
        F.lit("acked").alias("stage"),
        F.when(rejected, "rejected").otherwise("ok").alias("status"),
        F.when(rejected, "rejected_by_partner").alias("reason_category"),
        F.lit(True).alias("terminal"),
        F.lit(None).cast("timestamp_ntz").alias("sla_due_at"),
        F.lit(0).cast("decimal(18,2)").alias("value_usd"),
        F.lit(1).cast("decimal(18,2)").alias("kchar"),
        F.lit(None).cast("string").alias("error_code"),
        F.lit(False).alias("replayed"),
        F.lit(None).cast("timestamp_ntz").alias("replayed_at"),
        F.lit(0).alias("replay_count"),
        F.concat(F.lit("CN"), k.cast("string"), F.lit("-204-0")).alias("control_number"),
    ))


def txn_files(spark: SparkSession, sf_dir: str, events: DataFrame | None = None, orders: DataFrame | None = None) -> DataFrame:
    """One file (interchange) per order."""
    k = _k()
    ev = events if events is not None else txn_events(spark, sf_dir)
    children = ev.groupBy("interchange_id").agg(F.count(F.lit(1)).alias("children"))
    f = (order_base(spark, sf_dir) if orders is None else orders).join(children, "interchange_id", "left")
    status = F.when(k % 40 == 0, "rejected").when(k % 3 == 0, "received").otherwise("delivered")
    f = f.withColumn("status", status)
    declared = (F.coalesce(F.col("children"), F.lit(0)) + F.when(k % 12 == 0, 2).otherwise(0)).cast("int")
    return f.select(
        "interchange_id",
        F.concat(F.col("interchange_id"), F.lit(".x12")).alias("file_name"),
        "environment", "partner", "channel", "protocol",
        F.when(k % 8 == 0, "in").otherwise("out").alias("direction"),
        F.col("t0").alias("received_at"),
        F.when(F.col("status").isin("delivered", "rejected"), add_minutes(F.col("t0"), 5)).alias("completed_at"),
        "status",
        F.when(F.col("status") == "rejected", "bad_input_file").alias("reason_category"),
        F.when(F.col("status") != "rejected", declared).alias("declared_txn_count"),
        F.lpad(k.cast("string"), 9, "0").alias("isa_control"),
        k.cast("string").alias("gs_control"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("value_usd"),
        ((5 + k % 36) * F.coalesce(F.col("children"), F.lit(0))).cast("decimal(18,2)").alias("kchar"),
    )


# ---------------------------------------------------------------------------
# Monitor state.  Feeds and heartbeats are derived from the message stream
# (one row per feed / per channel), endpoints and pipelines from supplier.
# ---------------------------------------------------------------------------
def expected_feeds(events: DataFrame, as_of) -> DataFrame:
    now = as_of_col(as_of)
    g = (events.groupBy("partner", "doc_type", "channel", "environment")
               .agg(F.max("event_time").alias("seen"), F.count(F.lit(1)).alias("n")))
    n = F.col("n")
    return g.select(
        "partner", "doc_type", "channel", "environment",
        add_minutes(now, (120 - (n * 13) % 240).cast("int")).alias("expected_next_at"),
        pick(n % 3, GRACE_MINUTES).cast("int").alias("grace_minutes"),
        F.when(n % 11 != 0, F.col("seen")).alias("last_seen_at"),
    )


def monitor_heartbeat(events: DataFrame) -> DataFrame:
    g = (events.groupBy("channel", "environment")
               .agg(F.max("event_time").alias("last_run_at"), F.count(F.lit(1)).alias("n")))
    return g.select(
        F.concat(F.lit("sweep_"), F.col("channel"), F.lit("_"), F.col("environment")).alias("monitor_name"),
        "channel", "environment", "last_run_at",
        pick(F.col("n") % 4, HEARTBEAT_INTERVALS).cast("int").alias("expected_interval_sec"),
    )


def endpoint_health(spark: SparkSession, sf_dir: str, as_of) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier")
    n = F.broadcast(read_table(spark, sf_dir, "nation"))
    key = F.col("s_suppkey")
    now = as_of_col(as_of)
    return (s.join(n, s.s_nationkey == n.n_nationkey).select(
        pick(key % 5, CHANNELS).alias("channel"),
        F.col("s_name").alias("endpoint"),
        F.col("n_name").alias("partner"),
        F.when(key % 8 == 0, "uat").otherwise("prod").alias("environment"),
        F.when(key % 10 == 0, "down").when(key % 10 == 1, "degraded").otherwise("up").alias("status"),
        add_hours(now, (-(key % 48)).cast("int")).alias("last_ok_at"),
        F.date_add(F.to_date(now), (key % 30).cast("int")).alias("cert_expires_at"),
    ))


def pipeline_health(spark: SparkSession, sf_dir: str, as_of) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier", ["s_suppkey"])
    key = F.col("s_suppkey")
    return s.select(
        F.concat(F.lit("pl_"), key.cast("string")).alias("pipeline"),
        F.when(key % 8 == 0, "uat").otherwise("prod").alias("environment"),
        pick(key % 7, PIPELINE_STATES).alias("state"),
        F.when(key % 3 != 0, (key * 13) % 50).otherwise(F.lit(0)).cast("bigint").alias("queue_depth"),
        F.when(key % 2 == 0, (key * 7) % 20).otherwise(F.lit(0)).cast("bigint").alias("mq_depth"),
        F.when(key % 5 == 0, F.lit(0)).otherwise((key % 9) * 1.5).cast("decimal(18,2)").alias("consume_rate"),
        add_minutes(as_of_col(as_of), (-(key % 120)).cast("int")).alias("last_consumed_at"),
    )


# ---------------------------------------------------------------------------
# Reference / config tables.
# ---------------------------------------------------------------------------
def partner_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "nation").filter(F.col("n_nationkey") % 5 == 0)
    pairs = F.array(F.struct(F.lit("204").alias("doc_type"), F.lit(250).alias("p")),
                    F.struct(F.lit("210").alias("doc_type"), F.lit(400).alias("p")))
    return (n.select(F.col("n_name").alias("partner"), F.explode(pairs).alias("x"))
             .select("partner", "x.doc_type", F.col("x.p").cast("decimal(18,2)").alias("penalty_usd")))


def partner_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    return (n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_name").alias("partner"),
        pick(F.col("n_nationkey") % 3, TIERS).alias("tier"),
        F.when(F.col("n_nationkey") % 7 == 6, "Onboarding").otherwise("Live").alias("onboarding_status"),
        F.col("r_name").alias("region")))


def sla_rules(spark: SparkSession) -> DataFrame:
    """Rule rows for the rule-driven response SLA (config, not data)."""
    rows = [
        # rule_id, name, environment, partner, trigger doc/dir,
        # response doc/dir, correlation key, threshold minutes.
        (1, "204-990 tender response", "prod", None, "204", "out", "990", "in", "interchange_id", 240),
        (2, "204-214 first status", "prod", None, "204", "out", "214", "in", "interchange_id", 1440),
        (3, "204-210 invoice", "prod", None, "204", "out", "210", "in", "interchange_id", 4320),
        (4, "204-990 NATION_3 tight", "prod", "NATION_3", "204", "out", "990", "in", "interchange_id", 60),
        (5, "204-990 uat", "uat", None, "204", "out", "990", "in", "interchange_id", 240),
        (6, "inbound-997 func ack", "prod", None, None, "in", "997", "out", "interchange_id", 15),
        (7, "204-997 functional ack", "prod", None, "204", "out", "997", "in", "control_number", 60),
    ]
    schema = ("rule_id int, name string, environment string, partner string, trigger_doc_type string, "
              "trigger_direction string, response_doc_type string, response_direction string, "
              "correlation_key string, threshold_minutes int")
    return spark.createDataFrame(rows, schema)


def diagnostic_rules(spark: SparkSession) -> DataFrame:
    rows = [
        # Generic rules, one partner override, one NULL-code rule.
        (1, None, "connectivity", "E0", "Endpoint unreachable", "Retry after endpoint check", "rb/connectivity"),
        (2, None, "mapping_defect", "E1", "Map version drift", "Redeploy map", "rb/mapping"),
        (3, "NATION_1", "mapping_defect", "E1", "Partner sends old layout", "Ask partner to resend", "rb/nation1"),
        (4, None, "validation_error", None, "Never matches (NULL code)", "n/a", "rb/none"),
        (5, None, "validation_error", "E3", "Bad segment count", "Fix envelope", "rb/validation"),
        (6, None, "ack_timeout", "E2", "Partner slow to ack", "Chase partner", "rb/ack"),
    ]
    schema = ("rule_id int, partner string, reason_category string, error_code string, "
              "likely_cause string, suggested_action string, runbook_url string")
    return spark.createDataFrame(rows, schema)


def doc_type_catalog(spark: SparkSession) -> DataFrame:
    rows = [
        # Fixed values; 210 is left out on purpose (family 'Other', label fallback).
        ("204", "Load tender", "Transportation", "out", 240),
        ("990", "Tender response", "Transportation", "in", 240),
        ("214", "Shipment status", "Visibility", "in", 1440),
        ("997", "Functional ack", "Acknowledgment", "in", 60),
    ]
    return spark.createDataFrame(rows, "doc_type string, label string, business_family string, "
                                       "typical_direction string, sla_minutes int")


# ---------------------------------------------------------------------------
# Feed-anomaly stream: the driver's `events` table as per-feed messages.
# ---------------------------------------------------------------------------
def feed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type"])
    partner = F.concat(F.lit("P"), (F.col("user_id") % 3).cast("string"))
    et = F.col("event_type")
    status = F.when(F.col("event_id") % 50 == 0, "failed").otherwise("ok")
    return (e.select(
        F.col("event_id"), F.col("ts").alias("event_time"),
        F.lit("prod").alias("environment"), F.lit("feed").alias("lob"), partner.alias("partner"),
        F.lit("api").alias("channel"), F.lit("api").alias("protocol"), F.lit("in").alias("direction"),
        et.alias("doc_type"), status.alias("status"),
        F.lit(True).alias("terminal"), F.lit(None).cast("timestamp_ntz").alias("sla_due_at"),
        F.lit(0).cast("decimal(18,2)").alias("value_usd"), F.lit(1).cast("decimal(18,2)").alias("kchar")))


# ---------------------------------------------------------------------------
# API calls and the shipment-360 sources.
# ---------------------------------------------------------------------------
def api_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    n = F.broadcast(read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"]))
    e = e.join(n, (e.user_id % 25) == n.n_nationkey)
    eid, et = F.col("event_id"), F.col("event_type")
    kk = F.get_json_object("props", "$.k").cast("int")
    status = F.when(kk < 85, 200).when(kk < 90, 400).when(kk < 93, 429).otherwise(503)
    latency = (F.lit(15) + F.floor(F.col("value") * 10)).cast("int")
    webhook = et.isin("view", "click")
    df = e.select(
        F.concat(F.lit("API-"), eid.cast("string")).alias("api_call_id"),
        F.when(et != "signup", F.concat(F.lit("ORD-"), F.lpad(eid.cast("string"), 9, "0"))).alias("shipment_id"),
        F.col("n_name").alias("partner_id"),
        F.concat(F.lit("CAR-"), (F.col("user_id") % 7).cast("string")).alias("carrier_id"),
        et.alias("api_operation"),
        F.concat(F.lit("/v1/"), et).alias("endpoint"),
        F.when(et == "view", "GET").otherwise("POST").alias("http_method"),
        webhook.alias("is_webhook"),
        F.col("ts").alias("request_ts"),
        F.timestamp_add("MILLISECOND", latency, F.col("ts")).alias("response_ts"),
        latency.alias("latency_ms"),
        status.cast("int").alias("http_status"),
        eid, webhook.alias("_wh"))
    s = F.col("http_status")
    return df.select(
        "api_call_id", "shipment_id", "partner_id", "carrier_id", "api_operation", "endpoint",
        "http_method", "is_webhook", "request_ts", "response_ts", "latency_ms", "http_status",
        F.when(s < 300, "2xx").when(s < 500, "4xx").otherwise("5xx").alias("status_class"),
        (s < 400).alias("success"),
        F.when(F.col("event_id") % 7 == 0, 1).otherwise(0).alias("retry_count"),
        (s == 429).alias("rate_limited"),
        F.when(F.col("_wh"), s < 400).alias("webhook_delivered"),
        F.when(s >= 400, F.concat(F.lit("HTTP"), s.cast("string"))).alias("error_code"),
        F.when(s >= 400, F.concat(F.lit("status "), s.cast("string"))).alias("error_message"),
        F.concat(F.lit("COR-"), F.col("event_id").cast("string")).alias("correlation_id"),
        F.lit(400).alias("target_latency_ms"),
        (F.col("latency_ms") <= 400).alias("sla_met"),
        F.col("request_ts").alias("created_at"))


def shipment_header(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    k = _k()
    b = order_base(spark, sf_dir) if orders is None else orders
    closed = F.col("o_orderstatus") == "F"
    return b.select(
        F.col("interchange_id").alias("shipment_id"),
        F.col("partner").alias("partner_id"),
        F.concat(F.lit("CAR-"), (k % 7).cast("string")).alias("carrier_id"),
        pick(k % 4, TRANSPORT_MODES).alias("transport_mode"),
        F.col("o_orderpriority").alias("priority"),
        F.when(closed, "Delivered").when(F.col("o_orderstatus") == "O", "In Transit")
         .otherwise("Booked").alias("shipment_status"),
        F.col("o_orderdate").alias("shipment_date"),
        add_days(F.col("o_orderdate"), (3 + k % 5).cast("int")).alias("promised_delivery_date"),
        F.when(closed, add_days(F.col("o_orderdate"), (2 + k % 8).cast("int"))).alias("actual_delivery_date"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("shipment_value"))


def trading_partner_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_name").alias("partner_id"),
        F.concat(F.lit("Partner "), F.col("n_name")).alias("partner_name"),
        F.col("r_name").alias("industry_segment"),
        (120 + 10 * F.col("n_nationkey")).cast("int").alias("expected_204_990_minutes"))


def edi_transactions(events: DataFrame, acks: DataFrame) -> DataFrame:
    """Message rows plus ack rows, in the control-tower column names."""
    key = F.regexp_extract("interchange_id", r"ORD-0*(\d+)", 1).cast("bigint")
    acked = acks.select(F.col("interchange_id").alias("_ic"), F.col("event_time").alias("_ack_ts"))
    tenders = F.col("doc_type") == "204"
    # Only tenders meet acks: the other messages stay where they are.
    is_tender = F.coalesce(tenders, F.lit(False))
    tender = events.filter(is_tender)
    ev = (events.filter(~is_tender).withColumn("_ack_ts", F.lit(None).cast("timestamp_ntz"))
          .unionByName(tender.join(acked, tender.interchange_id == acked._ic, "left").drop("_ic")))
    msg = ev.select(
        F.col("business_ref").alias("transaction_id"),
        F.col("interchange_id").alias("shipment_id"),
        F.col("partner").alias("partner_id"),
        F.concat(F.lit("CAR-"), (key % 7).cast("string")).alias("carrier_id"),
        F.col("doc_type").alias("transaction_type"),
        F.upper("direction").alias("transaction_direction"),
        F.col("status").alias("processing_status"),
        "control_number", "error_code",
        F.col("reason_category").alias("error_description"),
        F.col("event_time").alias("transaction_timestamp"),
        F.col("_ack_ts").alias("ack_timestamp"),
        F.col("event_time").alias("created_at"),
        tenders.alias("ack_required"),
        (tenders & F.col("_ack_ts").isNotNull()).alias("ack_received"))
    ack = acks.select(
        F.col("business_ref").alias("transaction_id"),
        F.col("interchange_id").alias("shipment_id"),
        F.col("partner").alias("partner_id"),
        F.concat(F.lit("CAR-"), (key % 7).cast("string")).alias("carrier_id"),
        F.col("doc_type").alias("transaction_type"),
        F.upper("direction").alias("transaction_direction"),
        F.col("status").alias("processing_status"),
        "control_number", "error_code",
        F.col("reason_category").alias("error_description"),
        F.col("event_time").alias("transaction_timestamp"),
        F.lit(None).cast("timestamp_ntz").alias("ack_timestamp"),
        F.col("event_time").alias("created_at"),
        F.lit(False).alias("ack_required"),
        F.lit(False).alias("ack_received"))
    return msg.unionByName(ack)


def anomaly_registry(spark: SparkSession, sf_dir: str, events: DataFrame, acks: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """One row per order and condition that its messages show.

    No 990 or one later than 240 minutes, no 997, a failed or rejected 204, an
    update that stays open, a delivery after the promised day.  Messages and acks are reduced to one row
    per order before they meet the orders.
    """
    k, t0 = _k(), F.col("t0")
    doc, refused = F.col("doc_type"), F.col("status").isin("failed", "rejected")
    facts = (events.unionByName(acks).groupBy("interchange_id").agg(
        F.min(F.when(doc == "990", F.col("event_time"))).alias("_response"),
        F.bool_or(doc == "997").alias("_acked"),
        F.bool_or((doc == "204") & refused).alias("_refused"),
        F.bool_or((doc == "214") & (F.col("status") == "ok") & ~F.col("terminal")).alias("_open")))
    b = (order_base(spark, sf_dir) if orders is None else orders).join(facts, "interchange_id", "left")
    waited = (micros_between(t0, F.col("_response")) / F.lit(60_000_000)).cast("int")
    promised, taken = (3 + k % 5).cast("int"), (2 + k % 8).cast("int")

    def found(kind, transaction, severity, detected, actual, expected, when):
        return F.struct(F.lit(kind).alias("kind"), F.lit(transaction).alias("transaction"),
                        F.lit(severity).alias("severity"), detected.alias("detected"),
                        actual.cast("decimal(14,2)").alias("actual"),
                        expected.cast("decimal(14,2)").alias("expected"),
                        F.coalesce(when, F.lit(False)).alias("when"))

    zero, one = F.lit(0), F.lit(1)
    conditions = F.array(
        found("MISSING_990", "990", "Critical", add_minutes(t0, F.lit(RESPONSE_MINUTES)), zero, one,
              F.col("_response").isNull()),
        found("LATE_990", "990", "High", F.col("_response"), waited, F.lit(RESPONSE_MINUTES),
              waited > RESPONSE_MINUTES),
        found("MISSING_997", "204", "Medium", add_hours(t0, F.lit(1)), zero, one,
              ~F.coalesce(F.col("_acked"), F.lit(False))),
        found("REJECTED_204", "204", "High", t0, zero, one, F.col("_refused")),
        found("STATUS_AGING", "214", "Medium", add_hours(t0, F.lit(24)), zero, one, F.col("_open")),
        found("LATE_DELIVERY", "214", "Low", add_days(F.col("o_orderdate"), taken), taken, promised,
              (F.col("o_orderstatus") == "F") & (taken > promised)),
    )
    # Filtered after the explode: a lambda over the array would have all conditions evaluated uncompiled.
    a = b.select("*", F.explode(conditions).alias("a")).filter("a.when")
    actual, expected = F.col("a.actual"), F.col("a.expected")
    return a.select(
        F.concat_ws("-", F.lit("ANO"), k.cast("string"), F.col("a.kind")).alias("anomaly_id"),
        F.col("interchange_id").alias("shipment_id"),
        F.col("partner").alias("partner_id"),
        F.concat(F.lit("CAR-"), (k % 7).cast("string")).alias("carrier_id"),
        F.col("a.transaction").alias("transaction_type"),
        F.col("a.kind").alias("anomaly_type"),
        F.col("a.severity").alias("severity"),
        pick(k % 3, ANOMALY_STATES).alias("anomaly_status"),
        F.when(F.col("o_orderstatus") == "F", "Delivered").when(F.col("o_orderstatus") == "O", "In Transit")
         .otherwise("Booked").alias("current_status"),
        pick(k % 4, ROOT_CAUSES).alias("root_cause_category"),
        F.concat(F.lit("Review "), F.col("a.kind")).alias("recommended_action"),
        F.col("a.detected").alias("detected_timestamp"),
        F.col("a.detected").alias("created_at"),
        F.col("o_totalprice").cast("decimal(14,2)").alias("business_impact_amount"),
        actual.alias("actual_value"),
        expected.alias("expected_value"),
        ((actual - expected) * 100 / expected).cast("decimal(8,2)").alias("deviation_percent"))


@dataclass
class World:
    """All contract tables for one driver directory.

    With ``materialize=True`` (the default) the large derived tables are
    written once to the shared checkpoint folder and read back (see
    ``flowlens.sources.store``); otherwise every call rebuilds them lazily.
    """
    spark: SparkSession
    sf_dir: str
    materialize: bool = True
    _stored_key: str | None = None
    _now: str | None = None

    @property
    def as_of(self) -> str:
        """The newest tender's instant: read from the data, never used to filter them."""
        if self._now is None:
            row = self._table("as_of", lambda: latest_tender(self.events()), None).agg(F.max("as_of")).first()[0]
            self._now = (row or _dt.datetime(1970, 1, 1)).strftime("%Y-%m-%d %H:%M:%S.%f")
        return self._now

    def _key(self) -> str:
        from flowlens.sources.store import input_key
        if self._stored_key is not None:
            return self._stored_key
        # Any change to the package's code invalidates the stored tables.
        pkg = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        code = sorted(os.path.join(d, f) for d, _, fs in os.walk(pkg) for f in fs if f.endswith(".py"))
        self._stored_key = input_key(self.spark, self.sf_dir, code)
        return self._stored_key

    def _table(self, name: str, build, order_col: str | None, layout: str = "ranged", tables: tuple[str, ...] = ()) -> DataFrame:
        """``tables`` are the driver tables whose bytes set the number of files of a ranged table."""
        if not self.materialize:
            return build()
        from flowlens.sources.store import pieces, stored
        from flowlens.sources.tables import folder_bytes
        files = pieces(self.spark, sum(folder_bytes(self.spark, f"{self.sf_dir}/{t}.parquet") for t in tables)) if tables else None
        return stored(self.spark, self._key(), name, build, order_col, files, layout)

    def orders(self) -> DataFrame:
        """Orders with their dimensions and line numbers, ranged by time: joined once, read by every table made from orders."""
        return self._table("orders", lambda: order_lines(self.spark, self.sf_dir), "t0", tables=("orders", "lineitem"))

    def events(self) -> DataFrame:
        return self._table("txn_events", lambda: txn_events(self.spark, self.sf_dir, self.orders()), "event_time", "kept")

    def rollup(self) -> DataFrame:
        """The stored hourly rollup (A1 at ``as_of``), as the dashboards read it."""
        from flowlens.operators.rollup import hourly_rollup
        return self._table("txn_rollup_hourly", lambda: hourly_rollup(self.events(), self.as_of), "bucket", "sorted")

    def feed_rollup(self) -> DataFrame:
        """The stored hourly rollup of the feed messages."""
        from flowlens.operators.rollup import hourly_rollup
        return self._table("feed_rollup_hourly", lambda: hourly_rollup(self.feed_events(), self.as_of), "bucket", "sorted")

    def acks(self) -> DataFrame:
        return self._table("acks", lambda: ack_events(self.spark, self.sf_dir, self.orders()), "event_time", "kept")

    def events_with_acks(self) -> DataFrame:
        return self.events().unionByName(self.acks())

    def files(self) -> DataFrame:
        return self._table("txn_files", lambda: txn_files(self.spark, self.sf_dir, self.events(), self.orders()),
                           "received_at", "sorted")

    def feeds(self) -> DataFrame:
        return expected_feeds(self.events(), self.as_of)

    def heartbeats(self) -> DataFrame:
        return monitor_heartbeat(self.events())

    def endpoints(self) -> DataFrame:
        return endpoint_health(self.spark, self.sf_dir, self.as_of)

    def pipelines(self) -> DataFrame:
        return pipeline_health(self.spark, self.sf_dir, self.as_of)

    def penalty(self) -> DataFrame:
        return partner_penalty(self.spark, self.sf_dir)

    def profile(self) -> DataFrame:
        return partner_profile(self.spark, self.sf_dir)

    def sla_rules(self) -> DataFrame:
        return sla_rules(self.spark)

    def rule_pairs(self) -> DataFrame:
        """The stored rule-driven SLA pairs (J4 at ``as_of``), as worklists and histograms read them."""
        from flowlens.operators.sla import sla_rule_pairs
        return self._table("sla_rule_pairs", lambda: sla_rule_pairs(self.events_with_acks(), self.sla_rules(), self.as_of), "trigger_at", "kept")

    def diagnostic_rules(self) -> DataFrame:
        return diagnostic_rules(self.spark)

    def catalog(self) -> DataFrame:
        return doc_type_catalog(self.spark)

    def feed_events(self) -> DataFrame:
        return self._table("feed_events", lambda: feed_events(self.spark, self.sf_dir), "event_time", tables=("events",))

    def api(self) -> DataFrame:
        return self._table("api_transactions", lambda: api_transactions(self.spark, self.sf_dir), "request_ts", tables=("events",))

    def header(self) -> DataFrame:
        return self._table("shipment_header", lambda: shipment_header(self.spark, self.sf_dir, self.orders()),
                           "shipment_date", "kept")

    def partners(self) -> DataFrame:
        return trading_partner_master(self.spark, self.sf_dir)

    def edi_tx(self) -> DataFrame:
        return self._table("edi_transactions", lambda: edi_transactions(self.events(), self.acks()),
                           "transaction_timestamp", "kept")

    def anomalies(self) -> DataFrame:
        return self._table("anomaly_registry", lambda: anomaly_registry(self.spark, self.sf_dir, self.events(), self.acks(), self.orders()),
                           "detected_timestamp", "sorted")
