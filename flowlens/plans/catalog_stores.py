"""Queries over stored layouts: point look-ups (SRC1, F13), co-located joins (J1, J2, J17, D5) and sketch cells.

Each call writes its layout into a folder of its own under ``spark.checkpoint.dir`` and reads it back.  Sketch results are
approximate: their queries return the exact figure's position within the stated error, so that SQL can check them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import derive as de
from flowlens.operators import files as fi
from flowlens.operators import sketches as sk
from flowlens.operators import sla
from flowlens.plans.catalog_io import _folder
from flowlens.plans.catalog_ops import ACKS_SQL, MISSING_SQL
from flowlens.plans.registry import W, register, sql
from flowlens.sources.colocated import store_together
from flowlens.sources.lookup import find, write_lookup

EV = ["txn_events"]


@register("f13_point_lookup", sql(EV, """
SELECT e.* FROM txn_events e
WHERE interchange_id = (SELECT arg_max(interchange_id, (event_time, event_id)) FROM txn_events WHERE doc_type = '204')"""))
def f13_point_lookup(spark, sf_dir):
    """All messages of the newest tender's order, by its interchange."""
    ev, path = W(spark, sf_dir).events(), _folder(spark, "lookup")
    write_lookup(ev, path)
    newest = ev.filter(F.col("doc_type") == "204").agg(F.max_by("interchange_id", F.struct("event_time", "event_id"))).first()[0]
    return find(spark, path, interchange_id=newest)


@register("j1_ack_status_colocated", sql(["events_all"], ACKS_SQL))
def j1_ack_status_colocated(spark, sf_dir):
    w = W(spark, sf_dir)
    ev = store_together(_folder(spark, "by_control"), (w.events_with_acks(), ["control_number", "partner"]))[0]
    return sla.ack_status(ev, w.as_of)


@register("j2_files_missing_txns_colocated", sql(["txn_files"], MISSING_SQL))
def j2_files_missing_txns_colocated(spark, sf_dir):
    w = W(spark, sf_dir)
    files, ev = store_together(_folder(spark, "by_interchange"), (w.files(), ["interchange_id"]), (w.events(), ["interchange_id"]))
    return fi.files_missing_txns(files, ev)


@register("d5_mark_duplicates_colocated", sql(EV, """
SELECT event_id, partner, doc_type, control_number,
  coalesce(row_number() OVER (PARTITION BY partner, doc_type, control_number ORDER BY event_time, event_id) > 1
           AND control_number IS NOT NULL, FALSE) AS is_duplicate
FROM txn_events"""))
def d5_mark_duplicates_colocated(spark, sf_dir):
    """The counts need no shuffle; the few keys seen twice are joined back null-safe, which buckets do not serve."""
    keys = ["partner", "doc_type", "control_number"]
    ev = store_together(_folder(spark, "by_number"), (W(spark, sf_dir).events(), keys))[0]
    return de.mark_duplicates(ev).select("event_id", *keys, "is_duplicate")


@register("a27_latency_cells", sql(["api_transactions"], """
SELECT partner_id, count(latency_ms) AS calls, TRUE AS within_error FROM api_transactions GROUP BY 1 HAVING count(latency_ms) > 0"""))
def a27_latency_cells(spark, sf_dir):
    """Per partner the p95 latency merged from hourly cells, and whether its rank lies within the sketch's error of 95 %."""
    api, path = W(spark, sf_dir).api(), _folder(spark, "latency_cells")
    sk.latency_cells(api).write.parquet(path)
    p95 = sk.latency_quantiles(spark.read.parquet(path), ["partner_id"], (0.95,))
    known = api.filter(F.col("latency_ms").isNotNull())
    ranks = known.join(p95, "partner_id").groupBy("partner_id").agg(
        F.max("calls").alias("calls"), F.count_if(F.col("latency_ms") < F.col("p95")).alias("below"),
        F.count_if(F.col("latency_ms") <= F.col("p95")).alias("upto"))
    low, high = (F.col("calls") * (0.95 + s * 2 * sk.RANK_ERROR) for s in (-1, 1))
    return ranks.select("partner_id", "calls", ((F.col("below") <= high) & (F.col("upto") >= low)).alias("within_error"))


@register("a13_distinct_refs_cells", sql(EV, """
SELECT partner, count(*) AS occurrences, TRUE AS within_error
FROM txn_events WHERE status IN ('failed', 'rejected') AND reason_category IS NOT NULL GROUP BY partner"""))
def a13_distinct_refs_cells(spark, sf_dir):
    """Per partner the failed references counted from daily cells, and whether they lie within the sketch's error of the exact count."""
    ev, path = W(spark, sf_dir).events(), _folder(spark, "failure_cells")
    sk.failure_cells(ev).write.parquet(path)
    merged = sk.distinct_refs(spark.read.parquet(path), ["partner"])
    bad = ev.filter(F.col("status").isin("failed", "rejected") & F.col("reason_category").isNotNull())
    exact = bad.groupBy("partner").agg(F.count_distinct("business_ref").alias("exact"))
    off = F.abs(F.col("refs") - F.col("exact")) <= F.greatest(F.lit(1.0), 4 * sk.DISTINCT_ERROR * F.col("exact"))
    return merged.join(exact, "partner").select("partner", "occurrences", off.alias("within_error"))
