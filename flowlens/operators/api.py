"""API integration channel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.stats import percentile_cont_by


def api_detail(api: DataFrame, partners: DataFrame, hdr: DataFrame) -> DataFrame:
    """API calls enriched with partner and shipment, plus ``retried``."""
    p = partners.select("partner_id", "partner_name", "industry_segment")
    s = hdr.select(F.col("shipment_id").alias("_sid"), "transport_mode")
    j = api.join(p, "partner_id", "left").join(s, api.shipment_id == s._sid, "left")
    return j.select("api_call_id", "shipment_id", "partner_id", "partner_name", "industry_segment", "carrier_id",
                    "transport_mode", "api_operation", "endpoint", "http_method", "is_webhook", "request_ts",
                    F.to_date("request_ts").alias("request_date"), "response_ts", "latency_ms", "target_latency_ms",
                    "sla_met", "http_status", "status_class", "success", "retry_count",
                    (F.col("retry_count") > 0).alias("retried"), "rate_limited", "webhook_delivered",
                    "error_code", "error_message", "correlation_id")


def _pct_avg(flag) -> F.Column:
    return F.round(F.lit(100.0) * F.avg(flag.cast("int")), 1)


def api_summary(api: DataFrame, partners: DataFrame) -> DataFrame:
    """Per-partner API scorecard.

    The p95 latency is the exact ``percentile_cont`` computed from a
    (partner, latency) histogram, so a partner with a third of all calls
    never has its latencies gathered into one task.
    """
    p = partners.select("partner_id", "partner_name", "industry_segment")
    wh = F.col("is_webhook")
    g = api.groupBy("partner_id").agg(
        F.count(F.lit(1)).alias("total_calls"),
        _pct_avg(F.col("success")).alias("success_pct"),
        F.round(F.avg("latency_ms")).alias("avg_latency_ms"),
        _pct_avg(F.col("sla_met")).alias("latency_sla_pct"),
        F.count_if(F.col("status_class") == "4xx").alias("err_4xx"),
        F.count_if(F.col("status_class") == "5xx").alias("err_5xx"),
        F.count_if(F.col("rate_limited")).alias("rate_limited_cnt"),
        _pct_avg(F.col("retry_count") > 0).alias("retry_pct"),
        F.count_if(wh).alias("webhook_calls"),
        F.round(F.lit(100.0) * F.sum(F.when(wh & F.col("webhook_delivered"), 1).otherwise(0)).cast("double")
                / F.nullif(F.sum(wh.cast("int")).cast("double"), F.lit(0.0)), 1).alias("webhook_delivery_pct"),
        F.min("request_ts").alias("first_call_ts"), F.max("request_ts").alias("last_call_ts"))
    p95 = percentile_cont_by(api, ["partner_id"], "latency_ms", 0.95, "_p95")
    j = g.join(p95, "partner_id", "left").join(p, "partner_id", "left")
    return j.select("partner_id", "partner_name", "industry_segment", "total_calls", "success_pct", "avg_latency_ms",
                    F.round(F.col("_p95")).alias("p95_latency_ms"), "latency_sla_pct", "err_4xx", "err_5xx",
                    "rate_limited_cnt", "retry_pct", "webhook_calls", "webhook_delivery_pct", "first_call_ts",
                    "last_call_ts")
