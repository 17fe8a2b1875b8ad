"""Acknowledgement matching and response SLAs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.timeutil import MICROS_PER_MINUTE, as_of_col, micros_between, pct
from flowlens.operators.joins import first_at_or_after

ACK_TYPES = ("997", "CONTRL")

# The order-lifecycle response pairs (label, order, response doc, threshold minutes).
ORDER_PAIRS = [
    ("204→990 confirmation", 1, "990", 240),
    ("204→214 first update", 2, "214", 1440),
    ("204→210 invoice", 3, "210", 4320),
]


def ack_status(ev: DataFrame, as_of=None, ref_prefix: str | None = None) -> DataFrame:
    """Outbound messages matched to their 997/CONTRL by control number + partner."""
    now = as_of_col(as_of)
    o = ev.filter((F.col("direction") == "out") & ~F.col("doc_type").isin(*ACK_TYPES))
    if ref_prefix:
        o = o.filter(F.col("business_ref").startswith(ref_prefix))
    a = (ev.filter(F.col("doc_type").isin(*ACK_TYPES))
           .select(F.col("control_number").alias("a_ctl"), F.col("partner").alias("a_partner"),
                   F.col("event_time").alias("ack_at"), F.col("status").alias("ack_status")))
    j = o.join(a, (a.a_ctl == o.control_number) & (a.a_partner == o.partner), "left")
    state = (F.when(F.col("ack_at").isNull() & (now > F.col("sla_due_at")), "missing")
              .when(F.col("ack_status") == "rejected", "rejected")
              .when(F.col("ack_at").isNotNull(), "received").otherwise("pending"))
    return j.select("business_ref", "partner", "doc_type", F.col("event_time").alias("sent_at"),
                    "ack_at", "ack_status", state.alias("fa_state"))


def ack_kpis(acks: DataFrame) -> DataFrame:
    """Missing and rejected functional acks."""
    return acks.agg(F.count_if(F.col("fa_state") == "missing").alias("missing_acks"),
                    F.count_if(F.col("fa_state") == "rejected").alias("rejected_acks"))


def _sla_state(trigger: Column, response: Column, threshold: Column, now: Column) -> Column:
    elapsed = micros_between(trigger, response)
    waited = micros_between(trigger, now)
    minute = F.lit(MICROS_PER_MINUTE)
    at_risk_min = F.round(threshold * F.lit(0.8)).cast("bigint")
    return (F.when(response.isNotNull() & (elapsed <= threshold.cast("bigint") * minute), "met")
             .when(response.isNotNull(), "missed")
             .when(waited > threshold.cast("bigint") * minute, "missed")
             .when(waited > at_risk_min * minute, "at_risk")
             .otherwise("pending"))


def _elapsed_min(trigger: Column, response: Column) -> Column:
    return F.round(micros_between(trigger, response) / F.lit(float(MICROS_PER_MINUTE))).cast("int")


def sla_pairs(ev: DataFrame, as_of=None) -> DataFrame:
    """The three order response SLAs in long form.

    One ``groupBy(interchange_id)`` computes every trigger/response time as a
    conditional min; the three pairs are then unpivoted with ``explode`` of
    an array of structs -- one scan and one shuffle instead of a 3-way UNION.
    """
    now = as_of_col(as_of)
    doc = F.col("doc_type")

    def first(d):
        return F.min(F.when(doc == d, F.col("event_time")))

    o = (ev.filter(F.col("interchange_id").isNotNull()).groupBy(F.col("interchange_id").alias("shipment_id"))
           .agg(F.mode("partner", deterministic=True).alias("partner"),
                F.mode("lob", deterministic=True).alias("lob"),
                F.mode("protocol", deterministic=True).alias("protocol"),
                first("204").alias("t_order"),
                *[first(d).alias(f"t_{d}") for _, _, d, _ in ORDER_PAIRS],
                F.max("value_usd").alias("value_usd")))
    pairs = F.array(*[F.struct(F.lit(label).alias("pair"), F.lit(order).alias("pair_order"),
                               F.lit(thr).alias("threshold_min"), F.col(f"t_{d}").alias("response_at"))
                      for label, order, d, thr in ORDER_PAIRS])
    long = (o.filter(F.col("t_order").isNotNull())
             .select("shipment_id", "partner", "lob", "protocol", "value_usd",
                     F.col("t_order").alias("trigger_at"), F.explode(pairs).alias("p"))
             .select("shipment_id", "partner", "lob", "protocol", "value_usd", "p.pair", "p.pair_order",
                     "p.threshold_min", "trigger_at", "p.response_at"))
    t, r, thr = F.col("trigger_at"), F.col("response_at"), F.col("threshold_min")
    return long.select("*", _elapsed_min(t, r).alias("elapsed_min"), _sla_state(t, r, thr, now).alias("sla_state"))


CORRELATION_KEYS = ("business_ref", "interchange_id", "control_number")


def _correlation(keys: tuple[str, ...]):
    """The message column that a rule's ``correlation_key`` names (NULL for any other name)."""
    name = F.col("correlation_key")
    return F.coalesce(*[F.when(name == k, F.col(k)) for k in keys])


def sla_rule_pairs(ev: DataFrame, rules: DataFrame, as_of=None, keys: tuple[str, ...] = CORRELATION_KEYS) -> DataFrame:
    """Rule-driven response SLA -- first response at/after each trigger.

    Each rule names the message column that ties a response to its trigger
    (``correlation_key``, one of ``keys``; NULL means ``business_ref``).
    Rules are joined on (doc_type, direction, environment) with the
    nullable-partner test; the first response comes from
    ``first_at_or_after`` (no pair explosion).
    """
    now = as_of_col(as_of)
    # Rules are config, broadcast: a shuffle by their few (type, direction, environment) values would give a few tasks all messages.
    r = F.broadcast(rules.select(
        "rule_id", "name", F.col("environment").alias("r_env"), F.col("partner").alias("r_partner"),
        "trigger_doc_type", "trigger_direction", "response_doc_type", "response_direction", "threshold_minutes",
        F.coalesce("correlation_key", F.lit("business_ref")).alias("correlation_key")))
    t = ev.select(*keys, "partner", "environment", "doc_type", "direction", F.col("event_time").alias("trigger_at"))
    trig = t.join(r, (t.doc_type == r.trigger_doc_type) & (t.direction == r.trigger_direction)
                  & (t.environment == r.r_env) & (r.r_partner.isNull() | (t.partner == r.r_partner)))
    trig = trig.select("rule_id", "name", "partner", "business_ref", _correlation(keys).alias("_key"), "correlation_key",
                       "trigger_at", "threshold_minutes", "response_doc_type", "response_direction")
    # A response is listed once under each column that some rule ties it by.
    wanted = F.broadcast(r.select("response_doc_type", "response_direction", "correlation_key").distinct())
    resp = (ev.select(*keys, F.col("doc_type").alias("response_doc_type"),
                      F.col("direction").alias("response_direction"), F.col("event_time").alias("response_at"))
              .join(wanted, ["response_doc_type", "response_direction"])
              .withColumn("_key", _correlation(keys)))
    m = first_at_or_after(trig, resp, ["_key", "correlation_key", "response_doc_type", "response_direction"],
                          "trigger_at", "response_at", out="response_at")
    tt, rr, thr = F.col("trigger_at"), F.col("response_at"), F.col("threshold_minutes")
    return m.select("rule_id", "name", "partner", "business_ref", "trigger_at", "response_at",
                    F.round(micros_between(tt, rr) / F.lit(float(MICROS_PER_MINUTE))).cast("bigint").alias("elapsed_min"),
                    "threshold_minutes", _sla_state(tt, rr, thr, now).alias("sla_state"))


def rule_worklist(pairs: DataFrame, *states: str) -> DataFrame:
    """The rule pairs in one of ``states`` (due soon: at_risk and pending; breaches: missed)."""
    return pairs.filter(F.col("sla_state").isin(*states))


def at_risk_tenders(ev: DataFrame, as_of=None, lo_min: int = 24, hi_min: int = 30,
                    trigger=("204", "in"), response=("990", "out"), key: str = "business_ref") -> DataFrame:
    """Triggers aged lo..hi minutes with no response by ``as_of`` (left anti join)."""
    now = as_of_col(as_of)
    age = micros_between(F.col("event_time"), now)
    t = ev.filter((F.col("doc_type") == trigger[0]) & (F.col("direction") == trigger[1])
                  & age.between(lo_min * MICROS_PER_MINUTE, hi_min * MICROS_PER_MINUTE))
    resp = (ev.filter((F.col("doc_type") == response[0]) & (F.col("direction") == response[1]) & (F.col("event_time") <= now))
              .select(F.col(key).alias("_rk")))
    return (t.join(resp, t[key] == resp._rk, "left_anti")
             .select("business_ref", "interchange_id", "partner", "doc_type", "event_time",
                     F.round(age / F.lit(float(MICROS_PER_MINUTE))).cast("bigint").alias("age_min")))


def partner_sla(cur: DataFrame, penalty: DataFrame, as_of=None,
                penalty_key: tuple[str, ...] = ("partner",)) -> DataFrame:
    """Partner SLA scorecard over current state.

    ``penalty_key=("partner",)`` reproduces the reference's fan-out (M12);
    ``("partner", "doc_type")`` joins one penalty per document type.
    """
    now = as_of_col(as_of)
    p = penalty.select(*[F.col(k).alias("p_" + k) for k in penalty_key], "penalty_usd")
    cond = None
    for k in penalty_key:
        c = p["p_" + k] == cur[k]
        cond = c if cond is None else cond & c
    j = cur.join(p, cond, "left")
    met = F.col("terminal_at") <= F.col("sla_due_at")
    missed = (F.col("terminal_at") > F.col("sla_due_at")) | (F.col("terminal_at").isNull() & (now > F.col("sla_due_at")))
    mins = micros_between(F.col("first_event_at"), F.col("terminal_at")) / F.lit(float(MICROS_PER_MINUTE))
    n = F.count(F.lit(1))
    return j.groupBy("partner").agg(
        n.alias("total"), F.count_if(met).alias("met"), F.count_if(missed).alias("missed"),
        pct(F.count_if(met), n, 1).alias("pct_met"),
        F.round(F.avg(mins)).alias("avg_min"), F.round(F.min(mins)).alias("min_min"),
        F.round(F.max(mins)).alias("max_min"),
        F.coalesce(F.sum(F.when(F.col("terminal_at") > F.col("sla_due_at"), F.col("penalty_usd"))), F.lit(0))
         .cast("decimal(28,2)").alias("penalty_usd"))


def pair_sla_kpis(pairs: DataFrame) -> DataFrame:
    """Compliance % = met / (met + missed) per pair, states, avg latency."""
    st = F.col("sla_state")
    return pairs.groupBy("pair", "pair_order").agg(
        F.count(F.lit(1)).alias("orders"),
        F.count_if(st == "met").alias("met"), F.count_if(st == "missed").alias("missed"),
        F.count_if(st == "at_risk").alias("at_risk"), F.count_if(st == "pending").alias("pending"),
        pct(F.count_if(st == "met"), F.count_if(st.isin("met", "missed"))).alias("compliance_pct"),
        F.round(F.avg("elapsed_min")).alias("avg_elapsed_min"))


def pair_sla_overall(pairs: DataFrame) -> DataFrame:
    st = F.col("sla_state")
    return pairs.agg(pct(F.count_if(st == "met"), F.count_if(st.isin("met", "missed"))).alias("compliance_pct"),
                     F.count_if(st == "at_risk").alias("at_risk"))


def missed_by_partner(pairs: DataFrame) -> DataFrame:
    return (pairs.groupBy("partner", "sla_state")
                 .agg(F.count_if(F.col("sla_state") == "missed").alias("missed"),
                      F.count(F.lit(1)).alias("orders")))
