"""Structured Streaming forms of the event-at-a-time behaviours (ST1-ST6).

The reference refreshes tables on a timer; here the same contracts are kept
up to date by streaming queries.  Event time must be ``TIMESTAMP`` (a
watermark on TIMESTAMP_NTZ fails analysis), so ``as_stream_time`` converts
the batch contract with the session time zone pinned to UTC.

Every job writes through a checkpoint under ``spark.checkpoint.dir`` (the
shared folder the cluster names), so a lost executor or driver restarts
from the last committed micro-batch.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators import files as fi
from flowlens.operators import lifecycle as lc
from flowlens.operators.rollup import ROLLUP_DIMS, hourly_rollup
from flowlens.session import ensure_checkpoint_dir
from flowlens.sources import contracts as C
from flowlens.sources import io
from flowlens.sources.keyed import KeyedTable

TS_COLUMNS = ("event_time", "sla_due_at", "replayed_at")


def as_stream_time(ev: DataFrame) -> DataFrame:
    """Batch contract (NTZ) -> streaming contract (TIMESTAMP, UTC session)."""
    return ev.select(*[F.col(c).cast("timestamp").alias(c) if c in TS_COLUMNS else F.col(c) for c in ev.columns])


def event_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Streaming source over the event folder (explicit schema, bounded batches)."""
    return (spark.readStream.schema(C.events_schema(C.TS)).option("maxFilesPerTrigger", max_files)
                 .parquet(path))


def checkpoint_for(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "streams", name)


# ------------------------------------------------------------------ ST1
def windowed_rollup(ev: DataFrame, watermark: str | None = "2 hours") -> DataFrame:
    """ST1: hourly tumbling-window rollup with late data up to ``watermark``.

    ``breached_count`` depends on ``now()`` and cannot live in state, so it is
    applied when the rollup is read (compare sla_due_at at read time).
    Works on batch input too (``watermark=None``).
    """
    src = ev.withWatermark("event_time", watermark) if watermark else ev
    g = src.groupBy(F.window("event_time", "1 hour").alias("w"), *ROLLUP_DIMS).agg(
        F.count(F.lit(1)).alias("txn_count"),
        F.sum("value_usd").cast("decimal(28,2)").alias("value_sum"),
        F.sum("kchar").cast("decimal(28,2)").alias("kchar_sum"),
        F.count_if(F.col("status") == "failed").alias("failed_count"),
        F.count_if(F.col("status") == "rejected").alias("rejected_count"),
        F.count_if(F.col("status") == "duplicate").alias("duplicate_count"))
    return g.select(F.col("w.start").alias("bucket"), *ROLLUP_DIMS, "txn_count", "value_sum", "kchar_sum",
                    "failed_count", "rejected_count", "duplicate_count")


# ------------------------------------------------------------------ ST3
def dedupe(ev: DataFrame, keys=("partner", "doc_type", "control_number"), watermark: str = "1 hour") -> DataFrame:
    """ST3: suppress repeated control numbers that arrive within the watermark."""
    return ev.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(list(keys))


# ------------------------------------------------------------------ ST4
#: What a match is made from.
MATCH_COLUMNS = ["event_time", "interchange_id", "business_ref"]


def match_responses(triggers: DataFrame, responses: DataFrame, key: str, threshold_minutes: int,
                    watermark: str = "1 hour") -> DataFrame:
    """ST4: one row per trigger with its first response within the SLA.

    A stream-stream left outer join bounded by the SLA, reduced to the earliest
    response.  A trigger is emitted once the watermark passes its bound; with no
    response within ``threshold_minutes`` the response is NULL: a miss.
    """
    t = triggers.select(F.col(key).alias("t_key"), F.col("business_ref").alias("trigger_ref"),
                        F.col("event_time").alias("trigger_at")).withWatermark("trigger_at", watermark)
    r = responses.select(F.col(key).alias("r_key"), F.col("event_time").alias("response_at")) \
                 .withWatermark("response_at", watermark)
    cond = ((F.col("t_key") == F.col("r_key")) & (F.col("response_at") >= F.col("trigger_at"))
            & (F.col("response_at") <= F.col("trigger_at") + F.expr(f"INTERVAL {int(threshold_minutes)} MINUTES")))
    j = (t.join(r, cond, "leftOuter").groupBy("t_key", "trigger_ref", "trigger_at")
          .agg(F.min("response_at").alias("response_at")))
    return j.select("t_key", "trigger_ref", "trigger_at", "response_at",
                    F.when(F.col("response_at").isNull(), "missed").otherwise("met").alias("sla_state"))


# ------------------------------------------------------------------ ST5
def feed_sessions(ev: DataFrame, gap: str = "1 day", watermark: str | None = "1 day",
                  keys=("environment", "partner", "doc_type")) -> DataFrame:
    """ST5: activity sessions per feed; a closed session means the feed went silent.

    ``session_end`` is the last message plus the gap -- the moment the feed
    is overdue.  Works on batch input too (``watermark=None``).  A feed that never sends has no
    session: ``silent_feeds`` is seeded with the expected feeds.
    """
    src = ev.withWatermark("event_time", watermark) if watermark else ev
    g = src.groupBy(*keys, F.session_window("event_time", gap).alias("s")).agg(
        F.count(F.lit(1)).alias("messages"), F.max("event_time").alias("last_message_at"))
    return g.select(*keys, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                    "messages", "last_message_at")


FEED = ["partner", "doc_type", "channel", "environment"]
FEED_STATE = "due long, grace long, seen long, silent boolean"


def silent_feeds(expected: DataFrame, ev: DataFrame, delay: str = "1 hour") -> DataFrame:
    """ST5: each expected feed's turns to silence and back, fired by event time.

    ``expected`` is a stream of ``ops_expected_feeds`` rows (a later row of a feed sets its new due time), ``ev`` the
    event stream.  A feed keeps its due time, grace and last message as state and a timer at due + grace: once the
    watermark (newest event less ``delay``) is past it and no message came since the due time, the feed is ``silent``,
    whether or not it ever sent one.  A message at or after the due time makes it ``back``.  So the feeds that are silent
    after a batch are those of F1 at the watermark.

    Messages are reduced to one row per feed and Arrow batch before the shuffle, so a feed that holds a third of all
    messages costs its task a row per batch.  A message behind the watermark still counts.
    """
    at = F.col("event_time").alias("s")
    seen = ev.select(*FEED, at).mapInArrow(_newest_per_feed, ", ".join(f"{k} string" for k in FEED) + ", s timestamp, clock timestamp")
    seen = seen.select(*FEED, F.lit(None).cast("timestamp").alias("d"), F.lit(None).cast("int").alias("grace"), "s", "clock")
    due = expected.select(*FEED, F.col("expected_next_at").cast("timestamp").alias("d"), F.col("grace_minutes").cast("int").alias("grace"),
                          F.col("last_seen_at").cast("timestamp").alias("s"), F.lit(None).cast("timestamp").alias("clock"))
    return seen.unionByName(due).withWatermark("clock", delay).groupBy(*FEED).applyInPandasWithState(
        _feed_turns, ", ".join(f"{k} string" for k in FEED) + ", turn string, expected_next_at timestamp, last_seen_at timestamp, "
        "turned_at timestamp", FEED_STATE, "append", "EventTimeTimeout")


def _newest_per_feed(batches):
    """The newest message of each feed, and of all; only the latter carries the clock, so that no message is too late to count."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        newest = table.group_by(FEED).aggregate([("s", "max")]).rename_columns([*FEED, "s"])
        none = pa.nulls(1, table.schema.field("s").type)
        last = newest.slice(pc.index(newest["s"], pc.max(newest["s"])).as_py(), 1)
        yield from newest.append_column("clock", pa.chunked_array([pa.nulls(len(newest), none.type)])).to_batches()
        yield from last.append_column("clock", last["s"]).set_column(len(FEED), "s", pa.chunked_array([none])).to_batches()


def _feed_turns(key, frames, state):
    """One feed's rows of a batch, or its timer; times are microseconds."""
    import pandas as pd

    due, grace, seen, silent = state.get if state.exists else (None, None, None, False)
    out = []

    def turn(name: str, at: int) -> None:
        stamp = lambda t: None if t is None else pd.Timestamp(t, unit="us")
        out.append((*key, name, stamp(due), stamp(seen), stamp(at)))

    if not state.hasTimedOut:
        for frame in frames:
            micros = {c: frame[c].astype("datetime64[us]") for c in ("d", "s")}
            told = micros["d"].dropna()
            if len(told) and (due is None or _micros(told.max()) >= due):
                at = told.idxmax()
                due, grace = _micros(told.max()), int(frame["grace"][at])
            newest = micros["s"].dropna()
            if len(newest):
                seen = max(_micros(newest.max()), seen if seen is not None else -(2**62))
    if due is not None:
        heard, end = seen is not None and seen >= due, due + grace * 60_000_000
        past = state.getCurrentWatermarkMs() * 1000 > end
        if silent and heard:
            silent = False
            turn("back", seen)
        elif not silent and not heard and past:
            silent = True
            turn("silent", end)
        state.update((due, grace, seen, silent))
        if not silent and not heard:
            # Timers are whole milliseconds, and must lie ahead of the watermark.
            state.setTimeoutTimestamp(max(end // 1000 + 1, state.getCurrentWatermarkMs() + 1))
    elif seen is not None:
        state.update((due, grace, seen, silent))
    if out:
        columns = [*FEED, "turn", "expected_next_at", "last_seen_at", "turned_at"]
        yield pd.DataFrame(out, columns=columns).astype({c: "datetime64[us]" for c in columns[-3:]})


def _micros(t) -> int:
    return t.value // 1000


# ------------------------------------------------------------- ST1 / ST2 / ST6
def _as_batch_time(batch: DataFrame) -> DataFrame:
    return batch.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in TS_COLUMNS else F.col(c) for c in batch.columns])


def _upserting(table_of, rows_of, writer: str):
    """A ``foreachBatch`` handler: ``rows_of`` a batch are merged into the table once, and old data goes."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        table = table_of(batch.sparkSession)
        if table.upsert(rows_of(batch), writer, batch_id):
            table.remove_old(keep=2)
    return handle


ROLLUP_KEY = ["bucket", *ROLLUP_DIMS]


def stream_rollup_table(spark: SparkSession, path: str) -> KeyedTable:
    """ST1's stored rollup: the hourly rollup without ``breached_count``, which depends on the instant of reading."""
    schema = C.T.StructType([f for f in C.ROLLUP if f.name != "breached_count"])
    sums = [f for f in schema if f.name not in ROLLUP_KEY]

    def add(batch: DataFrame, old: DataFrame) -> DataFrame:
        return batch.unionByName(old).groupBy(*ROLLUP_KEY).agg(
            *[F.sum(f.name).cast(f.dataType).alias(f.name) for f in sums])
    return KeyedTable(spark, path, schema, ROLLUP_KEY, add)


def rollup_batch(path: str, writer: str):
    """ST1: ``foreachBatch`` handler adding each micro-batch's partial buckets to the stored rollup.

    Counts and sums add up, so a late event enters its bucket however late it is; no state is kept and no watermark
    drops it.  ``writer`` names the stream (one checkpoint): a batch id that comes again is not added again.
    """
    return _upserting(lambda spark: stream_rollup_table(spark, path),
                      lambda batch: hourly_rollup(_as_batch_time(batch)).drop("breached_count"), writer)


#: What the current state is made from.
STATE_COLUMNS = ["event_id", "event_time", "business_ref", "environment", "lob", "partner", "channel", "protocol", "doc_type", "stage",
                 "status", "sla_due_at", "value_usd", "terminal", "replayed", "replayed_at", "replay_count"]


def state_table(spark: SparkSession, path: str) -> KeyedTable:
    """ST2's current state per business_ref, with the id of its latest event, which decides between events of one instant."""
    schema = lc.current_state(spark.createDataFrame([], C.events_schema()), last_id=True).schema
    return KeyedTable(spark, path, schema, ["business_ref"], lambda batch, old: _merge_state(old, batch))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return state_table(spark, path).read()


def current_state_batch(path: str, writer: str = "current_state"):
    """ST2: ``foreachBatch`` handler keeping the current state per business_ref; it writes the rows of the batch's refs only."""
    return _upserting(lambda spark: state_table(spark, path), lambda batch: lc.current_state(_as_batch_time(batch), last_id=True), writer)


def _merge_state(prev: DataFrame, fresh: DataFrame) -> DataFrame:
    """Upsert rule of the current-state table: latest event wins, flags accumulate."""
    u = prev.unionByName(fresh)
    latest = F.max_by(F.struct(*[c for c in u.columns if c not in (
        "business_ref", "first_event_at", "terminal_at", "replayed", "replayed_at", "replay_count")]),
        F.struct("last_event_at", "last_event_id"))
    g = u.groupBy("business_ref").agg(
        latest.alias("l"), F.min("first_event_at").alias("first_event_at"), F.max("terminal_at").alias("terminal_at"),
        F.bool_or("replayed").alias("replayed"), F.max("replayed_at").alias("replayed_at"),
        F.max("replay_count").alias("replay_count"))
    return g.select("business_ref", "l.*", "first_event_at", "terminal_at", "replayed", "replayed_at",
                    "replay_count").select(*fresh.columns)


def file_upsert_batch(path: str, writer: str | None = None):
    """ST6: ``foreachBatch`` handler merging receipt-then-parse file rows (SNK3).

    Merging a batch again gives the same rows, so ``writer`` is needed only to skip such batches.
    """
    return _upserting(lambda spark: io.file_table(spark, path), lambda batch: batch.select(*fi.FILE_COLUMNS),
                      writer or uuid.uuid4().hex)


def run_available_now(df: DataFrame, name: str, sink: str = "memory", output_mode: str = "append",
                      foreach_batch=None, path: str | None = None, resume: bool = False):
    """Run a streaming DataFrame over everything available and stop (tests, backfills).

    ``resume=True`` keeps a stable checkpoint per ``name`` (continue where the
    last run stopped); otherwise the run gets its own checkpoint folder.

    Executors hold one version of the state, and a checkpoint the versions that a restart needs.
    """
    spark = df.sparkSession
    before = {k: spark.conf.get(k) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        return _run_available_now(df, name, sink, output_mode, foreach_batch, path, resume)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


STATE_CONF = {"spark.sql.streaming.maxBatchesToRetainInMemory": "1", "spark.sql.streaming.minBatchesToRetain": "2",
              "spark.sql.streaming.stateStore.minDeltasForSnapshot": "2", "spark.sql.streaming.stateStore.maintenanceInterval": "10s"}


def _run_available_now(df, name, sink, output_mode, foreach_batch, path, resume):
    spark = df.sparkSession
    ckpt = checkpoint_for(spark, name if resume else f"{name}-{uuid.uuid4().hex[:12]}")
    w = (df.writeStream.outputMode(output_mode).option("checkpointLocation", ckpt)
           .trigger(availableNow=True))
    if foreach_batch is not None:
        q = w.foreachBatch(foreach_batch).start()
    elif sink == "memory":
        q = w.format("memory").queryName(name).start()
    else:
        q = w.format(sink).start(path)
    q.awaitTermination()
    return q
