"""Order lifecycle: order rollup (A4-A7), current state (W1), message detail
(F22, D2) and the grids/KPIs read from them (F13-F17, F21, A24, A25,
A33-A35, A40).

``shipments`` is a single ``groupBy(interchange_id)``: every column is an
aggregate of the group, so Spark does one shuffle with map-side partial
aggregation (``mode`` falls back to ObjectHashAggregate, still partial).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.timeutil import as_of_col, breached, format_ntz, hash_bucket, pct, round_minutes

EXCEPTION_STATUSES = ("failed", "rejected")
# Worst-of ranking per leg, failed > rejected > duplicate > ok.
STATUS_RANK = [("failed", 4), ("rejected", 3), ("duplicate", 2), ("ok", 1)]


def _rank(status: Column) -> Column:
    expr = F.when(status == STATUS_RANK[0][0], STATUS_RANK[0][1])
    for name, r in STATUS_RANK[1:]:
        expr = expr.when(status == name, r)
    return expr.otherwise(0)


def _unrank(r: Column) -> Column:
    expr = None
    for name, v in STATUS_RANK:
        expr = F.when(r == v, name) if expr is None else expr.when(r == v, name)
    return expr


def _leg_status(direction: str) -> Column:
    return _unrank(F.max(F.when(F.col("direction") == direction, _rank(F.col("status")))))


def shipments(ev: DataFrame, as_of=None) -> DataFrame:
    """A4: one row per order (interchange) with modal dims, counts, legs, completeness."""
    now = as_of_col(as_of)
    is_exc = F.col("status").isin(*EXCEPTION_STATUSES)
    exc = F.count_if(is_exc)
    has_invoice = F.bool_or(F.col("doc_type") == "210")
    g = (ev.filter(F.col("interchange_id").isNotNull())
           .groupBy(F.col("interchange_id").alias("shipment_id")).agg(
        F.mode("partner", deterministic=True).alias("partner"),
        F.mode("protocol", deterministic=True).alias("protocol"),
        F.mode("lob", deterministic=True).alias("lob"),
        F.mode("channel", deterministic=True).alias("channel"),
        F.mode("environment", deterministic=True).alias("environment"),
        F.min("event_time").alias("first_msg_ts"),
        F.max("event_time").alias("last_msg_ts"),
        F.count(F.lit(1)).alias("total_messages"),
        F.count_if(F.col("doc_type") == "214").alias("update_count"),
        F.bool_or(F.col("doc_type") == "204").alias("has_order"),
        F.bool_or(F.col("doc_type") == "990").alias("has_confirmation"),
        has_invoice.alias("has_invoice"),
        F.bool_or(breached(now)).alias("sla_breached"),
        exc.alias("exception_cnt"),
        F.count_if(F.col("status") == "duplicate").alias("duplicate_cnt"),
        F.count_if(F.col("status") == "ok").alias("ok_cnt"),
        F.count_if(F.col("direction") == "in").alias("inbound_count"),
        F.count_if(F.col("direction") == "out").alias("outbound_count"),
        _leg_status("in").alias("inbound_status"),
        _leg_status("out").alias("outbound_status"),
        F.max(F.when(F.col("direction") == "in", F.col("event_time"))).alias("last_in_ts"),
        F.max(F.when(F.col("direction") == "out", F.col("event_time"))).alias("last_out_ts"),
        F.sum("value_usd").cast("decimal(28,2)").alias("value_usd")))
    return g.select(
        "*",
        (F.col("has_invoice") & (F.col("exception_cnt") == 0)).alias("complete"),
        F.when(F.col("exception_cnt") > 0, "exceptions")
         .when(~F.col("has_invoice"), "in progress").otherwise("complete").alias("completeness_status"))


def current_state(ev: DataFrame, last_id: bool = False) -> DataFrame:
    """Latest event per business_ref plus first/terminal/replay fields.

    One ``groupBy`` with ``max_by`` on (event_time, event_id) -- partial
    aggregation, no window sort, no per-key collect.  ``last_id`` adds the latest event's id.
    """
    order_key = F.struct("event_time", "event_id")
    latest = F.max_by(F.struct("environment", "lob", "partner", "channel", "protocol", "doc_type",
                               F.col("stage").alias("current_stage"),
                               F.col("status").alias("current_status"),
                               F.col("event_time").alias("last_event_at"),
                               "sla_due_at", "value_usd", "terminal", *(["event_id"] if last_id else [])), order_key)
    g = (ev.filter(F.col("business_ref").isNotNull()).groupBy("business_ref").agg(
        latest.alias("l"),
        F.min("event_time").alias("first_event_at"),
        F.max(F.when(F.col("terminal"), F.col("event_time"))).alias("terminal_at"),
        F.bool_or("replayed").alias("replayed"),
        F.max("replayed_at").alias("replayed_at"),
        F.max("replay_count").alias("replay_count")))
    return g.select("business_ref", "l.environment", "l.lob", "l.partner", "l.channel", "l.protocol",
                    "l.doc_type", "l.current_stage", "l.current_status", "first_event_at",
                    "l.last_event_at", "terminal_at", "l.sla_due_at", "l.value_usd", "l.terminal",
                    "replayed", "replayed_at", "replay_count",
                    *([F.col("l.event_id").alias("last_event_id")] if last_id else []))


def _code(col: Column, n: int) -> Column:
    return F.left(F.upper(F.regexp_replace(col, "[^A-Za-z0-9]", "")), F.lit(n))


def file_names(ev: DataFrame) -> DataFrame:
    """EDI-side and JSON-side file names; which is incoming flips by direction."""
    stamp = format_ntz(F.col("event_time"), "yyyyMMddHHmmssSSS")
    pcode = _code(F.col("partner"), 10)
    syscode = _code(F.coalesce(F.col("lob"), F.lit("INTSYS")), 8)
    edi = F.concat_ws("_", "doc_type", pcode, "business_ref", stamp)
    js = F.concat_ws("_", syscode, "doc_type", "business_ref", stamp)
    return (ev.withColumn("edi_file", F.concat(edi, F.lit(".edi")))
              .withColumn("json_file", F.concat(js, F.lit(".json"))))


def processing_status(as_col: str = "processing_status") -> Column:
    status = F.col("status")
    bucket = hash_bucket(F.col("business_ref"), 10)
    return (F.when(status == "failed", "Failed").when(status == "rejected", "Rejected")
             .when(status == "duplicate", "Duplicate").when(F.col("terminal"), "Processed")
             .when(bucket < 2, "Received").when(bucket < 5, "Validated").otherwise("Processing")
             .alias(as_col))


def message_detail(ev: DataFrame, as_of=None) -> DataFrame:
    """per-message detail with processing_status, is_stuck, file names, payloads."""
    now = as_of_col(as_of)
    named = file_names(ev)
    has_payload = "edi_payload" in ev.columns
    edi_p = F.col("edi_payload") if has_payload else F.lit(None).cast("string")
    js_p = F.col("json_payload") if has_payload else F.lit(None).cast("string")
    inbound = F.col("direction") == "in"
    return named.select(
        F.col("interchange_id").alias("shipment_id"), "business_ref", "partner", "protocol", "lob",
        "channel", "doc_type", "direction", "event_time", "status", "reason_category", "error_code",
        "control_number", "value_usd",
        processing_status(),
        (~F.col("terminal") & ~F.col("status").isin("failed", "rejected", "duplicate")
         & (F.col("sla_due_at") < now)).alias("is_stuck"),
        F.when(inbound, F.col("edi_file")).otherwise(F.col("json_file")).alias("incoming_file"),
        F.when(inbound, F.col("json_file")).otherwise(F.col("edi_file")).alias("outgoing_file"),
        F.when(inbound, edi_p).otherwise(js_p).alias("incoming_payload"),
        F.when(inbound, js_p).otherwise(edi_p).alias("outgoing_payload"))


# --------------------------------------------------------------------------
# Grids and KPIs over current state / detail / orders.
# --------------------------------------------------------------------------
def txn_lookup(cur: DataFrame) -> DataFrame:
    """one current-state row per ref."""
    return cur.select("business_ref", "partner", "doc_type", "current_stage", "current_status",
                      "first_event_at", "last_event_at", "terminal", "replay_count")


def all_transactions(cur: DataFrame, as_of=None) -> DataFrame:
    """all-transactions grid with age in minutes."""
    return cur.select("business_ref", "environment", "lob", "partner", "channel", "protocol", "doc_type",
                      "current_stage", "current_status", "last_event_at", "terminal", "replayed",
                      round_minutes(F.col("last_event_at"), as_of_col(as_of)).alias("age_min"))


def replayed(cur: DataFrame) -> DataFrame:
    """F16: replayed messages."""
    return (cur.filter(F.col("replayed"))
               .select("business_ref", "partner", "doc_type", "current_status", "replay_count", "replayed_at"))


def replay_refailed(cur: DataFrame) -> DataFrame:
    """replayed and failed again."""
    return (cur.filter((F.col("replay_count") > 0) & F.col("current_status").isin(*EXCEPTION_STATUSES))
               .select("business_ref", "partner", "doc_type", "replay_count", "current_status"))


def lob_details(cur: DataFrame) -> DataFrame:
    """LOB details grid."""
    return cur.select("business_ref", "lob", "partner", "doc_type", "channel", "current_stage",
                      "current_status", "last_event_at", "value_usd")


def lob_last(cur: DataFrame) -> DataFrame:
    """Last received and live refs per LOB."""
    return cur.groupBy("lob").agg(F.max("last_event_at").alias("last_received"),
                                  F.count(F.lit(1)).alias("live_refs"))


def status_distribution(cur: DataFrame) -> DataFrame:
    """Current-status distribution."""
    return cur.groupBy("current_status").agg(F.count(F.lit(1)).alias("txns"))


def state_kpis(cur: DataFrame) -> DataFrame:
    """Live, in flight, terminal, replayed, resubmitted exceptions."""
    exc = F.col("current_status").isin(*EXCEPTION_STATUSES)
    return cur.agg(F.count(F.lit(1)).alias("live"),
                   F.count_if(~F.col("terminal")).alias("in_flight"),
                   F.count_if(F.col("terminal")).alias("terminal"),
                   F.count_if(F.col("replayed")).alias("replayed"),
                   F.count_if(exc & (F.col("replay_count") > 0)).alias("resubmitted_exceptions"))


def message_kpis(detail: DataFrame) -> DataFrame:
    """Total, processed, stuck, failed over message detail."""
    ps = F.col("processing_status")
    return detail.agg(F.count(F.lit(1)).alias("total"),
                      F.count_if(ps == "Processed").alias("processed"),
                      F.count_if(F.col("is_stuck")).alias("stuck"),
                      F.count_if(ps == "Failed").alias("failed"))


def status_mix(detail: DataFrame) -> DataFrame:
    """Processing-status mix."""
    return detail.groupBy("processing_status").agg(F.count(F.lit(1)).alias("msgs"))


def order_kpis(ship: DataFrame) -> DataFrame:
    """Orders in scope, flow complete %, invoice coverage %, with exceptions."""
    n = F.count(F.lit(1))
    return ship.agg(n.alias("orders"),
                    pct(F.count_if(F.col("complete")), n).alias("flow_complete_pct"),
                    pct(F.count_if(F.col("has_invoice")), n).alias("invoice_coverage_pct"),
                    F.count_if(F.col("exception_cnt") > 0).alias("with_exceptions"))


def completeness_mix(ship: DataFrame) -> DataFrame:
    return ship.groupBy("completeness_status").agg(F.count(F.lit(1)).alias("orders"))


def order_sla_kpis(ship: DataFrame) -> DataFrame:
    """On-time %, breached, in scope, $ at risk on breached orders."""
    n = F.count(F.lit(1))
    br = F.col("sla_breached")
    return ship.agg(pct(F.count_if(~br), F.count(br)).alias("on_time_pct"),
                    F.count_if(br).alias("breached"),
                    n.alias("orders"),
                    F.coalesce(F.sum(F.when(br, F.col("value_usd"))), F.lit(0))
                     .cast("decimal(28,2)").alias("dollars_at_risk"))
