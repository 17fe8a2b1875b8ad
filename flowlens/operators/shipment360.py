"""Shipment integration 360 (J9, J10, A28, A29) and the control-tower daily
metrics (T1-T21).

The reference defines T1-T21 only by their output columns; the formulas here
are this library's definitions (SURVEY section 2.4) over the same inputs.
Every per-shipment side is aggregated to one row per shipment before it is
joined, and the partner master (one row per partner) joins after a size
check, so no join multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.timeutil import (
    MICROS_PER_HOUR, MICROS_PER_MINUTE, as_of_col, div_half_up, micros_between)

# Funnel stages, severity ranks, expected hours in status, SLA minutes.
FUNNEL = [("204", "Tender", 1), ("990", "Response", 2), ("214", "Status", 3), ("210", "Invoice", 4)]
PRIORITY = [("Critical", 1), ("High", 2), ("Medium", 3), ("Low", 4)]
EXPECTED_HOURS = [("Booked", 24), ("In Transit", 72), ("Delivered", 720)]
DEFAULT_EXPECTED_HOURS = 24
UPDATE_SLA_MINUTES = 1440
ACK_SLA_MINUTES = 60


def _mins(a: Column, b: Column) -> Column:
    return micros_between(a, b) / F.lit(float(MICROS_PER_MINUTE))


def _pct52(num: Column, den: Column) -> Column:
    return F.round(F.lit(100.0) * num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0)), 2).cast("decimal(5,2)")


def _partners(partners: DataFrame) -> DataFrame:
    return partners


# ----------------------------------------------------------------- J9 / J10
def shipment_tx_agg(tx: DataFrame) -> DataFrame:
    """Per-shipment message aggregate."""
    t = F.col("transaction_type")
    return tx.groupBy("shipment_id").agg(
        F.count(F.lit(1)).alias("total_messages"),
        *[F.count_if(t == d).alias(f"cnt_{d}") for d in ("204", "990", "214", "210", "997")],
        F.count_if(F.col("ack_required")).alias("ack_required_cnt"),
        F.count_if(F.col("ack_required") & F.col("ack_received")).alias("ack_received_cnt"),
        F.count_if((F.col("processing_status") == "rejected") | F.col("error_code").isNotNull()).alias("error_cnt"),
        F.count_if(F.col("processing_status") == "duplicate").alias("duplicate_cnt"),
        F.min("transaction_timestamp").alias("first_msg_ts"), F.max("transaction_timestamp").alias("last_msg_ts"),
        F.min(F.when(t == "204", F.col("transaction_timestamp"))).alias("ts_204"),
        F.min(F.when(t == "990", F.col("transaction_timestamp"))).alias("ts_990"))


def shipment_anomaly_agg(anom: DataFrame) -> DataFrame:
    """Per-shipment anomaly aggregate."""
    a = F.col("anomaly_type")
    return anom.groupBy("shipment_id").agg(
        F.count(F.lit(1)).alias("anomaly_count"),
        F.count_if(F.col("severity") == "Critical").alias("critical_anomaly_count"),
        F.count_if(a == "MISSING_990").alias("miss_990_anom"),
        F.count_if(a == "MISSING_214").alias("miss_214_anom"),
        F.count_if(a == "MISSING_997").alias("miss_997_anom"),
        F.coalesce(F.sum("business_impact_amount"), F.lit(0)).cast("decimal(28,2)").alias("business_impact_amount"))


def shipment_360(hdr: DataFrame, tx: DataFrame, anom: DataFrame, partners: DataFrame) -> DataFrame:
    """Per-shipment integration scorecard (choreography, latency, acks, anomalies)."""
    p = _partners(partners).select("partner_id", "partner_name", "expected_204_990_minutes")
    j = (hdr.join(p, "partner_id", "left").join(shipment_tx_agg(tx), "shipment_id", "left")
            .join(shipment_anomaly_agg(anom), "shipment_id", "left"))

    def z(c):
        return F.coalesce(F.col(c), F.lit(0))

    miss990 = (z("miss_990_anom") > 0) | ((z("cnt_204") > 0) & (z("cnt_990") == 0))
    miss214 = (z("miss_214_anom") > 0) | (z("cnt_214") == 0)
    pending = F.greatest(z("ack_required_cnt") - z("ack_received_cnt"), F.lit(0))
    ackgap = (z("miss_997_anom") > 0) | (pending > 0)
    resp = _mins(F.col("ts_204"), F.col("ts_990"))
    flag = lambda c: F.when(c, 1).otherwise(0)
    return j.select(
        "shipment_id", "partner_id", "partner_name", "transport_mode", "priority", "shipment_status",
        "shipment_date", "promised_delivery_date", "actual_delivery_date",
        z("total_messages").alias("total_messages"),
        *[z(f"cnt_{d}").alias(f"cnt_{d}") for d in ("204", "990", "214", "210", "997")],
        (z("cnt_204") > 0).alias("has_204"), (z("cnt_990") > 0).alias("has_990"),
        (z("cnt_214") > 0).alias("has_214"), (z("cnt_997") > 0).alias("has_997"),
        flag(miss990).alias("missing_990"), flag(miss214).alias("missing_214"), flag(ackgap).alias("ack_gap"),
        F.when(z("total_messages") == 0, "No messages").when(miss990, "Missing 990")
         .when(miss214, "Missing 214").when(ackgap, "ACK gap").otherwise("Complete").alias("choreography_status"),
        flag((z("total_messages") > 0) & ~miss990 & ~miss214 & ~ackgap).alias("choreography_complete"),
        F.round(resp, 1).alias("response_minutes"), "expected_204_990_minutes",
        flag(F.col("ts_204").isNotNull() & F.col("ts_990").isNotNull()
             & (resp <= F.coalesce(F.col("expected_204_990_minutes").cast("double"), F.lit(1e9)))).alias("response_sla_met"),
        z("ack_required_cnt").alias("ack_required_cnt"), z("ack_received_cnt").alias("ack_received_cnt"),
        pending.alias("ack_pending"), z("error_cnt").alias("error_cnt"), z("duplicate_cnt").alias("duplicate_cnt"),
        z("anomaly_count").alias("anomaly_count"), z("critical_anomaly_count").alias("critical_anomaly_count"),
        F.coalesce(F.col("business_impact_amount"), F.lit(0).cast("decimal(28,2)")).alias("business_impact_amount"),
        "first_msg_ts", "last_msg_ts")


def shipment_messages(tx: DataFrame, partners: DataFrame, hdr: DataFrame) -> DataFrame:
    """Per-message detail enriched with partner name and transport mode."""
    p = _partners(partners).select("partner_id", "partner_name")
    s = hdr.select(F.col("shipment_id").alias("_sid"), "transport_mode")
    j = tx.join(p, "partner_id", "left").join(s, tx.shipment_id == s._sid, "left")
    return j.select("shipment_id", "transaction_id", "transaction_type", "transaction_direction",
                    "transaction_timestamp", "processing_status", "ack_required", "ack_received", "ack_timestamp",
                    "error_code", "error_description", "control_number", "partner_id", "partner_name",
                    "transport_mode")


# -------------------------------------------------------------- T1 - T7
def _sla_status(trigger: Column, response: Column, sla_min: Column, now: Column) -> Column:
    due = F.timestamp_add("MINUTE", sla_min, trigger)
    return (F.when(response.isNull() & (due < now), "missing").when(response.isNull(), "pending")
             .when(_mins(trigger, response) <= sla_min.cast("double"), "met").otherwise("breach"))


def _tender_frame(hdr: DataFrame, tx: DataFrame, partners: DataFrame) -> DataFrame:
    t = F.col("transaction_type")
    agg = tx.groupBy("shipment_id").agg(
        F.min(F.when(t == "204", F.col("transaction_timestamp"))).alias("tender_ts"),
        F.min(F.when(t == "990", F.col("transaction_timestamp"))).alias("response_ts"),
        F.min(F.when(t == "214", F.col("transaction_timestamp"))).alias("first_214_ts"))
    p = _partners(partners).select("partner_id", "partner_name", "expected_204_990_minutes")
    return (hdr.select("shipment_id", "partner_id", "carrier_id", "shipment_date", "shipment_value")
               .join(agg, "shipment_id").filter(F.col("tender_ts").isNotNull())
               .join(p, "partner_id", "left"))


def response_204_990(hdr, tx, partners, as_of=None) -> DataFrame:
    """204 -> 990 response per shipment against the partner's expected minutes."""
    now = as_of_col(as_of)
    f = _tender_frame(hdr, tx, partners)
    sla_min = F.col("expected_204_990_minutes")
    return f.select("shipment_id", "partner_id", "partner_name", "carrier_id", "tender_ts", "response_ts",
                    F.to_date("tender_ts").alias("metric_date"),
                    F.round(_mins(F.col("tender_ts"), F.col("response_ts")), 1).alias("response_minutes"),
                    sla_min.alias("sla_minutes"),
                    _sla_status(F.col("tender_ts"), F.col("response_ts"), sla_min, now).alias("sla_status"))


def first_update_204_214(hdr, tx, partners, as_of=None) -> DataFrame:
    """204 -> first 214 per shipment (1440 minutes)."""
    now = as_of_col(as_of)
    f = _tender_frame(hdr, tx, partners)
    sla_min = F.lit(UPDATE_SLA_MINUTES)
    return f.select("shipment_id", "partner_id", "partner_name", "carrier_id", "tender_ts", "first_214_ts",
                    F.to_date("tender_ts").alias("metric_date"),
                    F.round(_mins(F.col("tender_ts"), F.col("first_214_ts")), 1).alias("first_update_minutes"),
                    sla_min.alias("sla_minutes"),
                    _sla_status(F.col("tender_ts"), F.col("first_214_ts"), sla_min, now).alias("sla_status"))


def _sla_counts(df: DataFrame, keys: list[str], status: str = "sla_status") -> DataFrame:
    st = F.col(status)
    total = F.count_if(st != "pending")
    return df.groupBy(*keys).agg(
        total.alias("total_messages"), F.count_if(st == "met").alias("within_sla_count"),
        F.count_if(st == "breach").alias("breach_count"), F.count_if(st == "missing").alias("missing_count"),
        _pct52(F.count_if(st == "met"), total).alias("sla_percent"))


def message_sla_daily(hdr, tx, partners, as_of=None) -> DataFrame:
    """Per day x partner x SLA type: total, within, breach, missing, %.

    The tender frame is built once; each tender is graded for both SLA types.
    """
    now = as_of_col(as_of)
    tender = F.col("tender_ts")

    def graded(kind, response, sla_min):
        return F.struct(F.lit(kind).alias("sla_type"), _sla_status(tender, F.col(response), sla_min, now).alias("sla_status"))

    kinds = F.array(graded("204-990", "response_ts", F.col("expected_204_990_minutes")),
                    graded("204-214", "first_214_ts", F.lit(UPDATE_SLA_MINUTES)))
    both = _tender_frame(hdr, tx, partners).select(F.to_date(tender).alias("metric_date"), "partner_id", "partner_name",
                                                   F.inline(kinds))
    return _sla_counts(both, ["metric_date", "partner_id", "partner_name", "sla_type"])


def ack_sla_daily(tx: DataFrame, as_of=None, sla_minutes: int = ACK_SLA_MINUTES) -> DataFrame:
    """T4: ack timeliness per day x partner x transaction type."""
    now = as_of_col(as_of)
    r = tx.filter(F.col("ack_required"))
    ts, ack = F.col("transaction_timestamp"), F.col("ack_timestamp")
    st = _sla_status(ts, ack, F.lit(sla_minutes), now)
    g = r.withColumn("_st", st).groupBy(F.to_date(ts).alias("metric_date"), "partner_id", "transaction_type")
    s = F.col("_st")
    total = F.count_if(s != "pending")
    return g.agg(total.alias("total_transactions"), F.count_if(s == "met").alias("ack_within_sla_count"),
                 F.count_if(s == "breach").alias("ack_breach_count"), F.count_if(s == "missing").alias("missing_ack_count"),
                 _pct52(F.count_if(s == "met"), total).alias("ack_sla_percent"))


def transaction_volume(tx: DataFrame) -> DataFrame:
    """T5: EDI volume by date, hour, partner, type, status with ack counts."""
    ts = F.col("transaction_timestamp")
    return (tx.groupBy(F.to_date(ts).alias("transaction_date"), F.hour(ts).alias("transaction_hour"),
                       "partner_id", "transaction_type", "processing_status")
              .agg(F.count(F.lit(1)).alias("transaction_count"),
                   F.count_if(F.col("ack_received")).alias("ack_received_count"),
                   F.count_if(F.col("ack_required") & ~F.col("ack_received")).alias("ack_missing_count")))


def edi_funnel(tx: DataFrame) -> DataFrame:
    """Distinct shipments and messages per funnel stage."""
    t = F.col("transaction_type")
    stage = order = None
    for d, name, o in FUNNEL:
        stage = F.when(t == d, name) if stage is None else stage.when(t == d, name)
        order = F.when(t == d, o) if order is None else order.when(t == d, o)
    f = tx.filter(t.isin(*[d for d, _, _ in FUNNEL]))
    return (f.groupBy(F.to_date("transaction_timestamp").alias("transaction_date"), "partner_id", "transaction_type",
                      stage.alias("funnel_stage"), order.alias("funnel_order"))
             .agg(F.count_distinct("shipment_id").alias("shipment_count"),
                  F.count(F.lit(1)).alias("transaction_count")))


def flow_completeness(hdr: DataFrame, tx: DataFrame, partners: DataFrame) -> DataFrame:
    """Presence of each lifecycle type per shipment and the first gap."""
    t = F.col("transaction_type")
    pres = tx.groupBy("shipment_id").agg(*[F.bool_or(t == d).alias(f"has_{d}") for d, _, _ in FUNNEL])
    p = _partners(partners).select("partner_id", "partner_name")
    j = hdr.select("shipment_id", "partner_id", "shipment_date").join(pres, "shipment_id", "left").join(p, "partner_id", "left")
    flags = {d: F.coalesce(F.col(f"has_{d}"), F.lit(False)) for d, _, _ in FUNNEL}
    status = F.when(flags["204"] & flags["990"] & flags["214"] & flags["210"], "Complete")
    for d, _, _ in FUNNEL:
        status = status.when(~flags[d], f"Missing {d}")
    return j.select("shipment_id", "shipment_date", "partner_id", "partner_name",
                    *[flags[d].alias(f"has_{d}") for d, _, _ in FUNNEL], status.alias("edi_flow_status"))


# -------------------------------------------------------------- T8 - T10
def anomaly_kpis_daily(anom: DataFrame) -> DataFrame:
    """Anomalies per detection day by state and severity, with impact."""
    st, sv = F.col("anomaly_status"), F.col("severity")
    return anom.groupBy(F.to_date("detected_timestamp").alias("metric_date")).agg(
        F.count(F.lit(1)).alias("total_anomalies"), F.count_if(st == "Open").alias("open_anomalies"),
        F.count_if(st == "In Progress").alias("in_progress_anomalies"),
        F.count_if(st == "Resolved").alias("resolved_anomalies"),
        F.count_if(sv == "Critical").alias("critical_anomalies"), F.count_if(sv == "High").alias("high_anomalies"),
        F.count_if(sv == "Medium").alias("medium_anomalies"), F.count_if(sv == "Low").alias("low_anomalies"),
        F.sum("business_impact_amount").cast("decimal(28,2)").alias("total_business_impact"))


def anomaly_summary(anom: DataFrame) -> DataFrame:
    """Anomaly counts per date x partner x type x severity x status."""
    return (anom.groupBy(F.to_date("detected_timestamp").alias("detected_date"), "partner_id", "anomaly_type",
                         "severity", "anomaly_status").agg(F.count(F.lit(1)).alias("anomaly_count")))


def _priority(sev: Column) -> Column:
    expr = None
    for name, r in PRIORITY:
        expr = F.when(sev == name, r) if expr is None else expr.when(sev == name, r)
    return expr


def exception_workbench(anom: DataFrame, hdr: DataFrame, partners: DataFrame, as_of=None) -> DataFrame:
    """Anomaly rows enriched with partner and shipment, priority rank, age."""
    now = as_of_col(as_of)
    p = _partners(partners).select("partner_id", "partner_name")
    s = hdr.select(F.col("shipment_id").alias("_sid"), "transport_mode", "shipment_status", "shipment_value",
                   F.to_date("promised_delivery_date").alias("promised_delivery_date"),
                   F.to_date("actual_delivery_date").alias("actual_delivery_date"))
    j = anom.join(p, "partner_id", "left").join(s, anom.shipment_id == s._sid, "left")
    return j.select("anomaly_id", "shipment_id", "partner_id", "partner_name", "carrier_id", "transport_mode",
                    "shipment_status", "anomaly_type", "severity", "anomaly_status", "root_cause_category",
                    "recommended_action", "detected_timestamp", "business_impact_amount",
                    "transaction_type", "current_status", "actual_value", "expected_value", "deviation_percent",
                    F.to_date("detected_timestamp").alias("detected_date"), "shipment_value",
                    "promised_delivery_date", "actual_delivery_date",
                    _priority(F.col("severity")).alias("priority_rank"),
                    F.round(micros_between(F.col("detected_timestamp"), now) / F.lit(float(MICROS_PER_HOUR)), 1)
                     .alias("age_hours"))


# ------------------------------------------------------------- T11 - T17
def _health(sla_pct: Column, exceptions: Column, shipments: Column) -> Column:
    """Half the SLA % plus half the share of shipments without exceptions, half-up to 2 places.

    Computed in hundredths with integers, so that x.xx5 rounds alike everywhere.
    """
    sla = F.round(sla_pct.cast("double") * 100).cast("bigint")
    n = F.nullif(shipments.cast("bigint"), F.lit(0).cast("bigint"))
    clean = F.greatest(F.lit(0), n - exceptions)
    return div_half_up(sla * n + clean * 10000, n * 2) / F.lit(100.0)


def _risk(score: Column) -> Column:
    return F.when(score < 70, "High").when(score < 85, "Medium").otherwise("Low")


def partner_health_daily(hdr, tx, anom, partners, as_of=None) -> DataFrame:
    """Per partner and shipment day: shipments, exceptions, SLA %, score, risk."""
    r = response_204_990(hdr, tx, partners, as_of)
    st = F.col("sla_status")
    sla = r.groupBy(F.col("metric_date"), "partner_id").agg(
        _pct52(F.count_if(st == "met"), F.count_if(st != "pending")).alias("sla_percent"))
    ships = (hdr.groupBy(F.to_date("shipment_date").alias("metric_date"), "partner_id")
                .agg(F.count(F.lit(1)).alias("shipments_count")))
    exc = (anom.join(hdr.select("shipment_id", F.to_date("shipment_date").alias("metric_date")), "shipment_id")
               .groupBy("metric_date", "partner_id").agg(F.count(F.lit(1)).alias("exception_count")))
    p = _partners(partners).select("partner_id", "partner_name")
    j = (ships.join(exc, ["metric_date", "partner_id"], "left").join(sla, ["metric_date", "partner_id"], "left")
              .join(p, "partner_id", "left"))
    e = F.coalesce(F.col("exception_count"), F.lit(0))
    score = _health(F.col("sla_percent"), e, F.col("shipments_count"))
    return j.select("metric_date", "partner_id", "partner_name", "shipments_count", e.alias("exception_count"),
                    "sla_percent", score.alias("health_score"), _risk(score).alias("partner_risk_status"))


def _partner_totals(hdr, tx, anom, partners, as_of=None) -> DataFrame:
    r = response_204_990(hdr, tx, partners, as_of)
    st = F.col("sla_status")
    sla = r.groupBy(F.col("partner_id").alias("_p")).agg(F.count_if(st == "met").alias("sla_met"), F.count_if(st != "pending").alias("sla_judged"))
    ships = hdr.groupBy("partner_id").agg(F.count(F.lit(1)).alias("shipment_count"),
                                          F.sum("shipment_value").cast("decimal(28,2)").alias("shipment_value"))
    sv = F.col("severity")
    an = anom.groupBy("partner_id").agg(F.count(F.lit(1)).alias("anomaly_count"),
                                        F.count_if(sv == "Critical").alias("critical_anomalies"),
                                        F.count_if(sv.isin("Critical", "High")).alias("severe_anomaly_count"),
                                        F.count_if(sv == "High").alias("high_anomalies"))
    p = _partners(partners).select("partner_id", "partner_name")
    # Shipments without a partner are a group like others.
    j = ships.join(sla, ships["partner_id"].eqNullSafe(sla["_p"]), "left").drop("_p")
    j = j.join(an, "partner_id", "left").join(p, "partner_id", "left").withColumn(
        "sla_compliance_pct", _pct52(F.col("sla_met"), F.col("sla_judged")))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    j = j.select("partner_id", "partner_name", "shipment_count", "shipment_value", z("anomaly_count"),
                 z("critical_anomalies"), z("severe_anomaly_count"), z("high_anomalies"), "sla_compliance_pct",
                 z("sla_met"), z("sla_judged"))
    return j.withColumn("health_score", _health(F.col("sla_compliance_pct"), F.col("anomaly_count"),
                                                F.col("shipment_count")))


def partner_scorecard(hdr, tx, anom, partners, as_of=None) -> DataFrame:
    """All-time partner health scorecard."""
    t = _partner_totals(hdr, tx, anom, partners, as_of)
    return t.select("partner_id", "partner_name", "shipment_count", "anomaly_count", "critical_anomalies",
                    "sla_compliance_pct", "health_score", _risk(F.col("health_score")).alias("partner_risk_status"))


def partner_risk(hdr, tx, anom, partners, as_of=None) -> DataFrame:
    """Partner risk matrix."""
    t = _partner_totals(hdr, tx, anom, partners, as_of)
    return t.select("partner_id", "partner_name", F.col("shipment_count").alias("shipment_volume"),
                    "anomaly_count", "severe_anomaly_count",
                    F.round(F.lit(100.0) * F.col("anomaly_count").cast("double")
                            / F.nullif(F.col("shipment_count").cast("double"), F.lit(0.0)), 2).alias("anomaly_rate_pct"),
                    "shipment_value", "health_score")


def control_tower_kpis(hdr, tx, anom, partners, as_of=None) -> DataFrame:
    """One-row control-tower KPIs, all from the partners' totals."""
    t = _partner_totals(hdr, tx, anom, partners, as_of)
    return t.agg(F.sum("shipment_count").cast("bigint").alias("total_shipments"),
                F.count_if(F.col("shipment_count") > 0).alias("active_partners"),
                F.sum("anomaly_count").cast("bigint").alias("total_anomalies"),
                F.sum("critical_anomalies").cast("bigint").alias("critical_anomalies"),
                F.sum("high_anomalies").cast("bigint").alias("high_anomalies"),
                F.round(F.avg("health_score"), 2).alias("avg_partner_health_score"),
                _pct52(F.sum("sla_met"), F.sum("sla_judged")).alias("sla_compliance_pct"))


def control_tower_daily(hdr, tx, partners, as_of=None) -> DataFrame:
    """Control-tower KPIs per shipment day."""
    r = response_204_990(hdr, tx, partners, as_of)
    st = F.col("sla_status")
    sla = r.groupBy(F.col("metric_date")).agg(
        F.count_if(st == "met").alias("sla_met_count"),
        F.count_if(st.isin("breach", "missing")).alias("sla_breach_count"),
        _pct52(F.count_if(st == "met"), F.count_if(st != "pending")).alias("sla_compliance_pct"))
    ships = hdr.groupBy(F.to_date("shipment_date").alias("metric_date")).agg(
        F.count(F.lit(1)).alias("total_shipments"), F.count_distinct("partner_id").alias("active_partners"),
        F.sum("shipment_value").cast("decimal(28,2)").alias("total_shipment_value"),
        (div_half_up(F.sum((F.col("shipment_value") * 100).cast("bigint")), F.count(F.lit(1))) / 100.0)
        .alias("avg_shipment_value"))
    j = ships.join(sla, "metric_date", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return j.select("metric_date", "total_shipments", "active_partners", z("sla_met_count"),
                    z("sla_breach_count"), "sla_compliance_pct", "total_shipment_value", "avg_shipment_value")


def sla_performance_daily(hdr, tx, partners, as_of=None) -> DataFrame:
    """204->990 SLA per shipment day x partner."""
    r = response_204_990(hdr, tx, partners, as_of)
    st = F.col("sla_status")
    return r.groupBy(F.col("metric_date").alias("shipment_date"), "partner_id").agg(
        F.count(F.lit(1)).alias("total_shipments"), F.count_if(st == "met").alias("sla_met_count"),
        F.count_if(st.isin("breach", "missing")).alias("sla_breach_count"),
        _pct52(F.count_if(st == "met"), F.count_if(st != "pending")).alias("sla_pct"))


def daily_volume_vs_expected(hdr: DataFrame, partners: DataFrame, days: int = 7) -> DataFrame:
    """Daily shipments vs the mean of the previous ``days`` calendar days."""
    d = hdr.groupBy(F.to_date("shipment_date").alias("shipment_date"), "partner_id").agg(
        F.count(F.lit(1)).alias("actual_volume"))
    dn = F.datediff(F.col("shipment_date"), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy("partner_id").orderBy("_dn").rangeBetween(-days, -1)
    e = d.withColumn("_dn", dn).withColumn(
        "expected_volume", F.round(F.coalesce(F.sum("actual_volume").over(w), F.lit(0)).cast("double") / days, 2))
    p = _partners(partners).select("partner_id", "partner_name")
    dev = F.round(F.lit(100.0) * (F.col("actual_volume") - F.col("expected_volume"))
                  / F.nullif(F.col("expected_volume"), F.lit(0.0)), 2)
    return e.join(p, "partner_id", "left").select("shipment_date", "partner_id", "partner_name", "actual_volume",
                                                  "expected_volume", dev.alias("volume_deviation_pct"))


# ------------------------------------------------------------- T18 - T21
def status_aging(hdr: DataFrame, tx: DataFrame, partners: DataFrame, as_of=None) -> DataFrame:
    """Hours in the current status vs the expected hours for that status."""
    now = as_of_col(as_of)
    last = tx.groupBy("shipment_id").agg(F.max("transaction_timestamp").alias("status_timestamp"))
    p = _partners(partners).select("partner_id", "partner_name")
    j = hdr.join(last, "shipment_id").join(p, "partner_id", "left")
    st = F.col("shipment_status")
    expected = None
    for name, h in EXPECTED_HOURS:
        expected = F.when(st == name, h) if expected is None else expected.when(st == name, h)
    expected = expected.otherwise(DEFAULT_EXPECTED_HOURS)
    age_us = micros_between(F.col("status_timestamp"), now)
    hours = F.round(age_us / F.lit(float(MICROS_PER_HOUR)), 2)
    j = j.select("shipment_id", "partner_id", "partner_name", "carrier_id", st.alias("current_status"), st.alias("header_status"),
                 "status_timestamp", F.to_date("status_timestamp").alias("metric_date"),
                 hours.alias("actual_hours_in_status"), expected.alias("expected_hours_in_status"),
                 age_us.alias("_us"))
    # hours / expected at 2 decimals, rounded half-up on the exact microsecond count.
    ratio = div_half_up(F.col("_us"), F.col("expected_hours_in_status").cast("bigint") * F.lit(MICROS_PER_HOUR // 100)) / 100.0
    j = j.withColumn("aging_ratio", ratio).drop("_us")
    sev = (F.when(F.col("aging_ratio") >= 2, "Critical").when(F.col("aging_ratio") >= 1.5, "High")
            .when(F.col("aging_ratio") >= 1, "Medium").otherwise("Normal"))
    insight = F.concat(F.col("current_status"), F.lit(" for "), F.col("actual_hours_in_status").cast("decimal(18,2)").cast("string"),
                       F.lit("h vs "), F.col("expected_hours_in_status").cast("string"), F.lit("h expected"))
    return j.withColumn("aging_severity", sev).withColumn("aging_insight", insight)


def delay_history(hdr: DataFrame, partners: DataFrame) -> DataFrame:
    """Delivered shipments, delay hours vs promise, performance and severity."""
    d = hdr.filter(F.col("actual_delivery_date").isNotNull())
    hours = micros_between(F.col("promised_delivery_date"), F.col("actual_delivery_date")) / F.lit(float(MICROS_PER_HOUR))
    p = _partners(partners).select("partner_id", "partner_name")
    j = d.join(p, "partner_id", "left").withColumn("delay_hours", F.round(hours, 2))
    h = F.col("delay_hours")
    return j.select("shipment_id", "partner_id", "partner_name", "shipment_date", "delay_hours",
                    F.when(h <= 0, "On time").otherwise("Late").alias("delivery_performance"),
                    F.when(h <= 0, "On time").when(h < 24, "Minor").when(h < 72, "Moderate")
                     .otherwise("Severe").alias("delay_severity"), "shipment_value")


def status_distribution(hdr: DataFrame, partners: DataFrame) -> DataFrame:
    """Shipments per partner x current status."""
    p = _partners(partners).select("partner_id", "partner_name")
    return (hdr.groupBy("partner_id", F.col("shipment_status").alias("current_status"))
               .agg(F.count(F.lit(1)).alias("shipment_count")).join(p, "partner_id", "left"))


def root_cause(anom: DataFrame) -> DataFrame:
    """Anomaly counts by type x severity x partner."""
    return anom.groupBy("anomaly_type", "severity", "partner_id").agg(F.count(F.lit(1)).alias("anomaly_count"))


OPEN_STATES = ("Open", "In Progress")


def exception_kpis(anom: DataFrame, open_states=OPEN_STATES) -> DataFrame:
    """Distinct-anomaly KPIs -- all, open critical, open status-aging."""
    is_open = F.col("anomaly_status").isin(*open_states)
    aid = F.col("anomaly_id")
    return anom.agg(
        F.count_distinct(aid).alias("exceptions"),
        F.count_distinct(F.when(is_open & (F.col("severity") == "Critical"), aid)).alias("critical_exceptions"),
        F.count_distinct(F.when(is_open & (F.col("anomaly_type") == "STATUS_AGING"), aid)).alias("aging_exceptions"))
