"""Sources, sinks and streaming jobs as queries: write, read back, return the whole table
(SRC1, SRC3, SRC5-SRC8, SNK1-SNK4, ST1-ST6).

Every call writes into a folder of its own under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import math
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.timeutil import add_hours, ts_lit
from flowlens.operators import rollup as ro
from flowlens.plans import catalog_core  # noqa: F401  (the usage query is registered there)
from flowlens.plans.oracle_world import AS_OF
from flowlens.plans.registry import CUR, REGISTRY, RU, W, register, sql
from flowlens.session import checkpoint_path
from flowlens.sources import contracts as C
from flowlens.sources import incremental as inc
from flowlens.sources import io
from flowlens.sources.tables import delete_folder, list_names
from flowlens.streaming import jobs

EV = ["txn_events"]
ONE_BATCH = 1_000_000  # files of a stored table that a backfill takes at once
STATE_ROWS = 300_000  # rows a core, about, that a stream keeps in its state at once


def _folder(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_path(spark, "flowlens-io"), uuid.uuid4().hex, name)


def _written(df: DataFrame, name: str) -> str:
    path = _folder(df.sparkSession, name)
    df.write.parquet(path)
    return path


# ------------------------------------------------------------ sources, sinks
@register("src1_stored_events", sql(EV, "SELECT * FROM txn_events"))
def src1_stored_events(spark, sf_dir):
    path = _folder(spark, "txn_events")
    io.write_events(W(spark, sf_dir).events(), path)
    return io.read_events(spark, path)


@register("src3_snk2_rollup_rebuild", sql(EV, "SELECT * FROM txn_rollup_hourly", RU))
def src3_snk2_rollup_rebuild(spark, sf_dir):
    w, path = W(spark, sf_dir), _folder(spark, "txn_rollup_hourly")
    io.rebuild_rollup(w.events(), path, w.as_of, grain="month")
    return io.read_rollup(spark, path)


@register("snk1_rollup_refresh", sql(EV, "SELECT * FROM txn_rollup_hourly", RU))
def snk1_rollup_refresh(spark, sf_dir):
    """Three ingest batches, each followed by a refresh: most events until a year before the end, the rest, and every
    tenth event of all times, up to years late."""
    w = W(spark, sf_dir)
    ev, log, path = w.events(), _folder(spark, "event_log"), _folder(spark, "txn_rollup_hourly")
    cut = add_hours(ts_lit(w.as_of), -365 * 24)
    late, early = F.col("event_id") % 10 == 0, F.col("event_time") < cut
    for batch, (rows, as_of) in enumerate([(early & ~late, cut), (~early & ~late, ts_lit(w.as_of)), (late, ts_lit(w.as_of))]):
        inc.append_events(ev.filter(rows), log, batch, grain="month")
        inc.refresh_rollup(spark, log, path, as_of, grain="month")
    return io.read_rollup(spark, path)


def _receipts(files: DataFrame) -> DataFrame:
    """The files as known on arrival: received, not yet parsed."""
    return files.withColumns({"status": F.lit("received"), "reason_category": F.lit(None).cast("string"),
                              "declared_txn_count": F.lit(None).cast("int"),
                              "completed_at": F.lit(None).cast("timestamp_ntz")})


@register("snk3_file_upsert", sql(["txn_files"], "SELECT * FROM txn_files"))
def snk3_file_upsert(spark, sf_dir):
    files, path = W(spark, sf_dir).files(), _folder(spark, "txn_files")
    io.upsert_files(_receipts(files), path)
    io.upsert_files(files, path)
    return io.read_files(spark, path)


@register("snk4_usage_export", REGISTRY["a22_monthly_usage"][1])
def snk4_usage_export(spark, sf_dir):
    path = _folder(spark, "usage")
    usage = ro.monthly_usage(W(spark, sf_dir).rollup())
    io.export_csv(usage, path)
    return spark.read.schema(usage.schema).option("header", True).csv(path)


@register("src5_monitor_tables", sql(["ops_endpoint_health", "ops_expected_feeds", "ops_monitor_heartbeat",
                                      "ops_pipeline_health"], """
SELECT 'ops_endpoint_health' AS monitor, endpoint AS subject, environment, last_ok_at AS last_at FROM ops_endpoint_health
UNION ALL SELECT 'ops_expected_feeds', partner || ' ' || doc_type, environment, last_seen_at FROM ops_expected_feeds
UNION ALL SELECT 'ops_monitor_heartbeat', monitor_name, environment, last_run_at FROM ops_monitor_heartbeat
UNION ALL SELECT 'ops_pipeline_health', pipeline, environment, last_consumed_at FROM ops_pipeline_health"""))
def src5_monitor_tables(spark, sf_dir):
    """When each monitored subject was last well, over the four stored monitor tables."""
    w, base = W(spark, sf_dir), _folder(spark, "monitors")
    for name, df in {"ops_endpoint_health": w.endpoints(), "ops_expected_feeds": w.feeds(),
                     "ops_monitor_heartbeat": w.heartbeats(), "ops_pipeline_health": w.pipelines()}.items():
        df.write.parquet(f"{base}/{name}")
    read = io.read_monitors(spark, base)
    subject = {"ops_endpoint_health": (F.col("endpoint"), "last_ok_at"),
               "ops_expected_feeds": (F.concat_ws(" ", "partner", "doc_type"), "last_seen_at"),
               "ops_monitor_heartbeat": (F.col("monitor_name"), "last_run_at"),
               "ops_pipeline_health": (F.col("pipeline"), "last_consumed_at")}
    parts = [read[name].select(F.lit(name).alias("monitor"), who.alias("subject"), "environment",
                               F.col(at).alias("last_at")) for name, (who, at) in subject.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("src6_reference_tables", sql(["ref_partner_penalty", "ref_partner_profile"], """
SELECT partner, tier, onboarding_status, region, doc_type, penalty_usd
FROM ref_partner_profile LEFT JOIN ref_partner_penalty USING (partner)"""))
def src6_reference_tables(spark, sf_dir):
    w, base = W(spark, sf_dir), _folder(spark, "refs")
    w.penalty().write.parquet(f"{base}/ref_partner_penalty")
    w.profile().write.parquet(f"{base}/ref_partner_profile")
    refs = io.read_refs(spark, base)
    return refs["ref_partner_profile"].join(refs["ref_partner_penalty"], "partner", "left")


@register("src7_shipment_source", sql(["shipment_header"], "SELECT * FROM shipment_header"))
def src7_shipment_source(spark, sf_dir):
    header = W(spark, sf_dir).header()
    return io.read_table(spark, _written(header, "shipment_header"), header.schema)


@register("src8_api_source", sql(["api_transactions"], "SELECT * FROM api_transactions"))
def src8_api_source(spark, sf_dir):
    return io.read_table(spark, _written(W(spark, sf_dir).api(), "api_transactions"))


# ----------------------------------------------------------------- streaming
def _event_stream(spark, ev: DataFrame) -> DataFrame:
    return jobs.event_stream(spark, _written(jobs.as_stream_time(ev), "stream"), ONE_BATCH)


def _in_runs(spark, name: str, batches: list[DataFrame], run) -> None:
    """The batches arrive one after the other; ``run(stream, name)`` takes each, resuming from its checkpoint.

    A run ends when it has taken all files that are there; they go then."""
    path = _folder(spark, name)
    for b in batches:
        b.write.mode("append").option("compression", "zstd").parquet(path)
        run(spark.readStream.schema(b.schema).option("maxFilesPerTrigger", ONE_BATCH).parquet(path), f"{name}-{path.split('/')[-2]}")
        _drop(spark, path)


def _drop(spark, path: str) -> None:
    """Deletes the files of a stream's folder, all of which a run has taken."""
    for taken in list_names(spark, path):
        delete_folder(spark, f"{path}/{taken}")


def _arrivals(w, columns: list[str] | None = None) -> list[DataFrame]:
    """The events in three batches: those until a year before the end, the rest, and every tenth of all, up to years late.

    ``columns`` are those that the stream's job reads; without them a batch has all.
    """
    ev = jobs.as_stream_time(w.events())
    late, early = F.col("event_id") % 10 == 0, F.col("event_time") < add_hours(ts_lit(w.as_of), -365 * 24).cast("timestamp")
    return [ev.filter(rows).select(*(columns or ev.columns)) for rows in (early & ~late, ~early & ~late, late)]


@register("st1_rollup_stream", sql(EV, "SELECT * EXCLUDE (breached_count) FROM txn_rollup_hourly", RU))
def st1_rollup_stream(spark, sf_dir):
    """The stored rollup after three batches with rows years late, the second of which comes twice."""
    batches, table = _arrivals(W(spark, sf_dir)), _folder(spark, "stream_rollup")
    handle = jobs.rollup_batch(table, "st1")
    _in_runs(spark, "st1", batches, lambda s, name: jobs.run_available_now(s, name, foreach_batch=handle, resume=True))
    handle(batches[1], 1)
    return jobs.stream_rollup_table(spark, table).read()


@register("st2_current_state_stream", sql(EV, "SELECT * FROM txn_current", CUR))
def st2_current_state_stream(spark, sf_dir):
    """The state after three batches, the last of which holds events older than the state."""
    state = _folder(spark, "txn_current")
    handle = jobs.current_state_batch(state)
    _in_runs(spark, "st2", _arrivals(W(spark, sf_dir), jobs.STATE_COLUMNS), lambda s, name: jobs.run_available_now(s, name, foreach_batch=handle, resume=True))
    return jobs.read_state(spark, state).drop("last_event_id")


@register("st3_dedupe_stream", sql(EV, f"""
SELECT DISTINCT partner, doc_type, control_number FROM txn_events
WHERE NOT (event_id % 50 = 0 AND event_time < {AS_OF} - INTERVAL 370 DAY)"""))
def st3_dedupe_stream(spark, sf_dir):
    """The control numbers that pass in three batches: the second repeats the last half hour of the first, which the
    state knows; the third brings messages from before the watermark, which are dropped."""
    w, out = W(spark, sf_dir), _folder(spark, "deduped")
    ev, at = jobs.as_stream_time(w.events()), F.col("event_time")
    cut, long_ago = (add_hours(ts_lit(w.as_of), -h).cast("timestamp") for h in (365 * 24, 370 * 24))
    late = (F.col("event_id") % 50 == 0) & (at < long_ago)
    first, rest = ev.filter(~late & (at < cut)), ev.filter(~late & (at >= cut))
    newest = first.select(F.max("event_time")).scalar()
    again = first.filter(at >= newest - F.expr("INTERVAL 30 MINUTES"))
    _in_runs(spark, "st3", [first, again, rest.unionByName(ev.filter(late))], lambda s, name: jobs.run_available_now(
        jobs.dedupe(s), name, sink="parquet", path=out, resume=True))
    return spark.read.schema(C.events_schema(C.TS)).parquet(out).select("partner", "doc_type", "control_number")


@register("st4_response_match_stream", sql(EV, """
WITH clock AS (SELECT least(max(event_time) FILTER (WHERE doc_type = '204'),
                            max(event_time) FILTER (WHERE doc_type IN ('990', '214'))) - INTERVAL 1 HOUR AS watermark FROM txn_events)
SELECT q.interchange_id AS t_key, q.business_ref AS trigger_ref, q.event_time AS trigger_at, min(r.event_time) AS response_at,
  CASE WHEN count(r.event_time) = 0 THEN 'missed' ELSE 'met' END AS sla_state
FROM txn_events q LEFT JOIN txn_events r ON r.doc_type IN ('990', '214') AND r.interchange_id = q.interchange_id
  AND r.event_time BETWEEN q.event_time AND q.event_time + INTERVAL 24 HOUR
WHERE q.doc_type = '204' AND q.event_time < (SELECT watermark FROM clock) - INTERVAL 24 HOUR
GROUP BY 1, 2, 3"""))
def st4_response_match_stream(spark, sf_dir):
    """First answer (990 or 214) to each tender within a day: every row that the stream has emitted, which is every tender
    whose day is over at the watermark.  Tenders and answers arrive in the order of time, in two batches each, or in as many as
    keep the state of one in the executors' memory; batches that were taken go."""
    w, out = W(spark, sf_dir), _folder(spark, "matches")
    ev, doc = jobs.as_stream_time(w.events()).select("doc_type", *jobs.MATCH_COLUMNS), F.col("doc_type")
    tenders, answers = _folder(spark, "tenders"), _folder(spark, "answers")
    for since, until in _spans(ev, add_hours(ts_lit(w.as_of), -365 * 24).cast("timestamp")):
        part = ev.filter(since <= F.col("event_time")) if since is not None else ev
        part = part.filter(F.col("event_time") < until) if until is not None else part
        for path, rows in ((tenders, part.filter(doc == "204")), (answers, part.filter(doc.isin("990", "214")))):
            rows.select(*jobs.MATCH_COLUMNS).write.mode("append").option("compression", "zstd").parquet(path)
        matched = jobs.match_responses(jobs.event_stream(spark, tenders, ONE_BATCH), jobs.event_stream(spark, answers, ONE_BATCH),
                                       "interchange_id", 24 * 60)
        jobs.run_available_now(matched, f"st4-{out.split('/')[-2]}", sink="parquet", path=out, resume=True)
        for path in (tenders, answers):
            _drop(spark, path)
    return spark.read.parquet(out).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("trigger_at", "response_at")})


def _spans(ev: DataFrame, cut) -> list[tuple]:
    """Spans of event time, from and until, that meet at ``cut`` and hold about ``STATE_ROWS`` rows a core at most."""
    spark, at = ev.sparkSession, F.col("event_time")
    n = math.ceil(ev.count() / (STATE_ROWS * spark.sparkContext.defaultParallelism))
    edges = []
    if n > 1:
        # Whole microseconds; an edge is exact whatever the share of rows before it.
        micros = ev.agg(F.percentile_approx(F.unix_micros(at), [i / n for i in range(1, n)], 100 * n)).first()[0]
        edges = [F.timestamp_micros(F.lit(m)) for m in sorted(set(micros or []))]
    both = ev.sparkSession.range(1).select(*[e.alias(f"e{i}") for i, e in enumerate([*edges, cut])])
    values = sorted({v for v in both.select(*[F.unix_micros(c).alias(c) for c in both.columns]).first() if v is not None})
    edges = [None, *(F.timestamp_micros(F.lit(m)) for m in values), None]
    return list(zip(edges, edges[1:]))


@register("st5_silent_feeds_stream", sql(["ops_expected_feeds"], """
WITH seen AS (SELECT partner, doc_type, channel, environment, max(event_time) AS newest FROM txn_events GROUP BY ALL),
clock AS (SELECT max(event_time) - INTERVAL 1 HOUR AS watermark FROM txn_events)
SELECT f.partner, f.doc_type, f.channel, f.environment, expected_next_at,
  expected_next_at + to_minutes(CAST(grace_minutes AS BIGINT)) AS silent_at
FROM ops_expected_feeds f LEFT JOIN seen USING (partner, doc_type, channel, environment)
WHERE (SELECT watermark FROM clock) > expected_next_at + to_minutes(CAST(grace_minutes AS BIGINT))
  AND (newest IS NULL OR newest < expected_next_at)"""))
def st5_silent_feeds_stream(spark, sf_dir):
    """The feeds that are silent after three batches of messages: F1 at the stream's watermark."""
    w, out, feeds = W(spark, sf_dir), _folder(spark, "turns"), _folder(spark, "feeds")
    expected = w.feeds().select(*jobs.FEED, "expected_next_at", "grace_minutes", F.lit(None).cast("timestamp_ntz").alias("last_seen_at"))
    expected.write.parquet(feeds)
    _in_runs(spark, "st5", _arrivals(w, [*jobs.FEED, "event_time"]), lambda s, name: jobs.run_available_now(
        jobs.silent_feeds(spark.readStream.schema(expected.schema).parquet(feeds), s), name, sink="parquet", path=out, resume=True))
    turns = spark.read.parquet(out)
    # A feed's turns alternate; it is silent if it went silent once more than it came back.
    count = lambda turn: F.count_if(F.col("turn") == turn)
    ntz = lambda c: F.max(c).cast("timestamp_ntz")
    return turns.groupBy(*jobs.FEED).agg(
        ntz("expected_next_at").alias("expected_next_at"), ntz("turned_at").alias("silent_at"), (count("silent") - count("back")).alias("n")).filter("n = 1").drop("n")


@register("st6_file_stream", sql(["txn_files"], "SELECT * FROM txn_files"))
def st6_file_stream(spark, sf_dir):
    """Receipt and parse rows arrive in one batch; the table holds one row per file."""
    files, table = W(spark, sf_dir).files(), _folder(spark, "txn_files")
    source = _written(_receipts(files).unionByName(files), "stream")
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", ONE_BATCH).parquet(source)
    jobs.run_available_now(stream, "st6", foreach_batch=jobs.file_upsert_batch(table))
    return io.read_files(spark, table)
