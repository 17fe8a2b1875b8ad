"""Sources/sinks and Structured Streaming jobs, checked against the batch operators."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from flowlens.functions.timeutil import add_days, ts_lit
from flowlens.operators import lifecycle as lc
from flowlens.operators import rollup as ro
from flowlens.sources import io
from flowlens.sources.fixtures import World
from flowlens.sources.keyed import KeyedTable
from flowlens.streaming import jobs


def _rows(df, order):
    return sorted(tuple(r) for r in df.select(*order).collect())


def _world(spark):
    return World(spark, SF_SMALL)


def test_events_roundtrip_and_partition_pruning(spark):
    w = _world(spark)
    path = tempfile.mkdtemp(prefix="fl-ev-")
    io.write_events(w.events(), path)
    back = io.read_events(spark, path, start="2001-07-01 00:00:00", end=w.as_of)
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "event_date" in plan
    want = w.events().filter((F.col("event_time") >= "2001-07-01") & (F.col("event_time") < ts_lit(w.as_of)))
    assert back.count() == want.count() > 0


def test_incremental_rollup_equals_full_rebuild(spark):
    w = _world(spark)
    ev = w.events()
    full, inc = tempfile.mkdtemp(prefix="fl-ru-"), tempfile.mkdtemp(prefix="fl-ru-")
    io.rebuild_rollup(ev, full, w.as_of, grain="month")
    # Build the rollup from data known 3 days earlier, then refresh at as_of back to those days.
    early = add_days(ts_lit(w.as_of), -3)
    io.rebuild_rollup(ev.filter(F.col("event_time") <= early), inc, early, grain="month")
    io.refresh_rollup_days(ev, inc, w.as_of, hours=72, grain="month")
    cols = ["bucket"] + ro.ROLLUP_DIMS + ["txn_count", "value_sum", "failed_count"]
    assert _rows(io.read_rollup(spark, inc), cols) == _rows(io.read_rollup(spark, full), cols)


def test_export_csv_and_file_upsert(spark):
    w = _world(spark)
    out = tempfile.mkdtemp(prefix="fl-csv-")
    io.export_csv(ro.monthly_usage(ro.hourly_rollup(w.events(), w.as_of)), os.path.join(out, "usage"))
    assert spark.read.option("header", True).csv(os.path.join(out, "usage")).count() > 0
    files = w.files()
    table = tempfile.mkdtemp(prefix="fl-files-")
    receipt = files.withColumn("status", F.lit("received")).withColumn("declared_txn_count", F.lit(None).cast("int"))
    io.upsert_files(receipt, table, 1)
    io.upsert_files(files, table, 2)
    got = io.read_files(spark, table)
    assert _rows(got, ["interchange_id", "status", "declared_txn_count"]) == \
        _rows(files, ["interchange_id", "status", "declared_txn_count"])


def _stream_source(spark, w):
    path = tempfile.mkdtemp(prefix="fl-stream-")
    jobs.as_stream_time(w.events()).repartition(4).write.mode("overwrite").parquet(path)
    return jobs.event_stream(spark, path, max_files=1)


def test_streaming_rollup_equals_batch(spark):
    w = _world(spark)
    stream = _stream_source(spark, w)
    # complete mode: the final result table (append would hold back windows newer than the watermark)
    jobs.run_available_now(jobs.windowed_rollup(stream, watermark="3650 days"), "st1_rollup", output_mode="complete")
    got = spark.table("st1_rollup")
    batch = jobs.windowed_rollup(jobs.as_stream_time(w.events()), watermark=None)
    cols = ["bucket"] + ro.ROLLUP_DIMS + ["txn_count", "failed_count"]
    assert _rows(got, cols) == _rows(batch, cols)


def test_streaming_dedupe_and_sessions(spark):
    w = _world(spark)
    stream = _stream_source(spark, w)
    jobs.run_available_now(jobs.dedupe(stream, watermark="3650 days"), "st3_dedupe")
    ev = w.events()
    keys = ["partner", "doc_type", "control_number"]
    assert spark.table("st3_dedupe").count() == ev.select(*keys).distinct().count()
    stream2 = _stream_source(spark, w)
    jobs.run_available_now(jobs.feed_sessions(stream2, gap="30 days", watermark="3650 days"), "st5_sessions",
                           output_mode="complete")
    batch = jobs.feed_sessions(jobs.as_stream_time(ev), gap="30 days", watermark=None)
    cols = ["environment", "partner", "doc_type", "session_start", "messages"]
    assert _rows(spark.table("st5_sessions"), cols) == _rows(batch, cols)


def test_stream_stream_response_match(spark):
    w = _world(spark)
    ev = jobs.as_stream_time(w.events())
    trig_path, resp_path = tempfile.mkdtemp(prefix="fl-t-"), tempfile.mkdtemp(prefix="fl-r-")
    ev.filter(F.col("doc_type") == "204").write.mode("overwrite").parquet(trig_path)
    ev.filter(F.col("doc_type") == "990").write.mode("overwrite").parquet(resp_path)
    t = jobs.event_stream(spark, trig_path)
    r = jobs.event_stream(spark, resp_path)
    jobs.run_available_now(jobs.match_responses(t, r, "interchange_id", 240, watermark="1 hour"), "st4_match")
    # A trigger is emitted once its time is up: the newest day's are still in the state.
    settled = F.lit(w.as_of).cast("timestamp") - F.expr("INTERVAL 1 DAY")
    states = spark.table("st4_match").filter(F.col("trigger_at") < settled).groupBy("sla_state").count().collect()
    got = {r.sla_state: r["count"] for r in states}
    # batch truth: tenders whose 990 came within 240 minutes
    t0 = (ev.filter((F.col("doc_type") == "204") & (F.col("event_time") < settled))
            .select("interchange_id", F.col("event_time").alias("t")))
    r0 = ev.filter(F.col("doc_type") == "990").select("interchange_id", F.col("event_time").alias("r"))
    want = (t0.join(r0, "interchange_id")
              .filter((F.col("r") >= F.col("t")) & (F.col("r") <= F.col("t") + F.expr("INTERVAL 240 MINUTES")))
              .count())
    assert got == {"met": want, "missed": t0.count() - want} and want > 0


def test_foreach_batch_current_state_and_files(spark):
    w = _world(spark)
    stream = _stream_source(spark, w)
    state = tempfile.mkdtemp(prefix="fl-state-")
    jobs.run_available_now(stream, "st2", foreach_batch=jobs.current_state_batch(state))
    got = jobs.read_state(spark, state)
    want = lc.current_state(w.events())
    cols = ["business_ref", "current_status", "last_event_at", "replay_count"]
    assert _rows(got, cols) == _rows(want, cols)


def test_foreach_batch_file_receipt_then_parse(spark):
    """ST6: receipt rows land first, parse rows later; the table ends at the parsed state."""
    w = _world(spark)
    files = w.files()
    src = tempfile.mkdtemp(prefix="fl-files-src-")
    receipt = files.withColumn("status", F.lit("received")).withColumn("declared_txn_count", F.lit(None).cast("int"))
    receipt.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(src)
    table = tempfile.mkdtemp(prefix="fl-files-tbl-")
    jobs.run_available_now(stream, "st6_receipt", foreach_batch=jobs.file_upsert_batch(table))
    files.coalesce(1).write.mode("append").parquet(src)
    stream2 = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(src)
    ckpt = jobs.checkpoint_for(spark, "st6-" + os.path.basename(table))
    for _ in range(2):  # the second run resumes from the checkpoint and sees only the new file
        (stream2.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True)
                .foreachBatch(jobs.file_upsert_batch(table)).start().awaitTermination())
    got = io.read_files(spark, table)
    assert _rows(got, ["interchange_id", "status", "declared_txn_count"]) == \
        _rows(files, ["interchange_id", "status", "declared_txn_count"])


def test_receipt_and_parse_in_one_batch_make_one_row(spark):
    from flowlens.operators import files as fi

    files = _world(spark).files()
    receipt = files.withColumns({"status": F.lit("received"), "declared_txn_count": F.lit(None).cast("int"),
                                 "completed_at": F.lit(None).cast("timestamp_ntz")})
    merged = fi.upsert_files(receipt.unionByName(files).select(*fi.FILE_COLUMNS), files.limit(0))
    assert _rows(merged, ["interchange_id", "received_at"]) == _rows(files, ["interchange_id", "received_at"])
    again = fi.upsert_files(files.select(*fi.FILE_COLUMNS), merged)
    assert again.count() == files.select("interchange_id").distinct().count()


def test_state_read_that_fails_is_raised(spark, monkeypatch):
    state = tempfile.mkdtemp(prefix="fl-state-")
    handle, ev = jobs.current_state_batch(state), _world(spark).events()
    handle(ev, 0)
    before = _rows(jobs.read_state(spark, state), ["business_ref"])

    def broken(*_):
        raise OSError("storage is away")

    monkeypatch.setattr(KeyedTable, "_read", broken)
    try:
        handle(ev.limit(5), 1)
        raise AssertionError("the failure was swallowed")
    except OSError:
        pass
    monkeypatch.undo()
    assert _rows(jobs.read_state(spark, state), ["business_ref"]) == before


def test_store_key_follows_nested_input(spark):
    import os
    import shutil

    from conftest import SF_SMALL
    from flowlens.sources.store import input_key

    src = tempfile.mkdtemp(prefix="fl-input-")
    nested = os.path.join(src, "orders.parquet", "part=1")
    os.makedirs(nested)
    shutil.copy(f"{SF_SMALL}/orders.parquet", os.path.join(nested, "a.parquet"))
    keys = [input_key(spark, d, []) for d in (src, f"file://{src}")]
    shutil.copy(f"{SF_SMALL}/orders.parquet", os.path.join(nested, "b.parquet"))
    assert all(input_key(spark, d, []) != k for d, k in zip((src, f"file://{src}"), keys, strict=True))


def _order_of_2030(spark):
    """The small tables with one more order, dated 2030."""
    import shutil

    src = tempfile.mkdtemp(prefix="fl-input-")
    for t in ("nation", "region", "customer", "lineitem", "orders"):
        shutil.copy(f"{SF_SMALL}/{t}.parquet", f"{src}/{t}.parquet")
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    late = (orders.orderBy("o_orderkey").limit(1).withColumn("o_orderkey", F.lit(900_001).cast("bigint"))
                  .withColumn("o_orderdate", F.expr("TIMESTAMP_NTZ '2030-05-05 00:00:00'").cast(
                      orders.schema["o_orderdate"].dataType)))
    os.remove(f"{src}/orders.parquet")
    orders.unionByName(late.select(*orders.columns)).write.parquet(f"{src}/orders.parquet")
    return src


def test_order_later_than_all_others_is_kept(spark):
    w = World(spark, _order_of_2030(spark))
    assert w.as_of.startswith("2030-05-05")
    shipments = lc.shipments(w.events(), w.as_of)
    small = spark.read.parquet(f"{SF_SMALL}/orders.parquet").count()
    assert shipments.count() == w.files().count() == w.header().count() == small + 1
    assert shipments.filter(F.col("shipment_id") == "ORD-000900001").count() == 1


def _messages(spark, *rows):
    """(business_ref, interchange_id, doc_type, minutes after noon, event_id, status) rows as events."""
    from flowlens.sources import contracts as C

    schema = C.events_schema()
    blank = dict.fromkeys(schema.fieldNames())
    noon = dt.datetime(2024, 5, 1, 12)
    full = [blank | dict(business_ref=r, interchange_id=i, doc_type=d, event_time=noon + dt.timedelta(minutes=m),
                         event_id=n, status=s, partner="P", environment="prod", control_number=r, terminal=False,
                         replayed=False, replay_count=0) for r, i, d, m, n, s in rows]
    return spark.createDataFrame([tuple(x[c] for c in schema.fieldNames()) for x in full], schema)


def _streamed(spark, *batches):
    """The batches as a stream that takes them one by one, in order."""
    path = tempfile.mkdtemp(prefix="fl-stream-")
    for i, b in enumerate(batches):
        jobs.as_stream_time(b).coalesce(1).write.mode("append").parquet(path)
        for f in os.listdir(path):
            if f.endswith(".parquet") and os.path.getmtime(f"{path}/{f}") > 1_000_000_000:
                os.utime(f"{path}/{f}", (1_000_000 + i, 1_000_000 + i))
    return jobs.event_stream(spark, path, max_files=1)


def test_two_responses_make_one_met_row_and_silence_a_miss(spark):
    asked = _messages(spark, ("A", "A", "204", 0, 1, "ok"), ("B", "B", "204", 0, 2, "ok"),
                      ("Z", "Z", "204", 6000, 3, "ok"))
    said = _messages(spark, ("A1", "A", "214", 30, 4, "ok"), ("A2", "A", "214", 20, 5, "ok"),
                     ("B1", "B", "214", 300, 6, "ok"), ("Z1", "Z", "214", 6000, 7, "ok"))
    m = jobs.match_responses(_streamed(spark, asked), _streamed(spark, said), "interchange_id", 240)
    jobs.run_available_now(m, "st4_first")
    got = {r.t_key: (r.sla_state, r.response_at) for r in spark.table("st4_first").collect()}
    assert got == {"A": ("met", dt.datetime(2024, 5, 1, 12, 20)), "B": ("missed", None)}


def test_row_later_than_the_watermark_is_dropped(spark):
    first = _messages(spark, ("A", "A", "204", 0, 1, "ok"), ("B", "B", "204", 600, 2, "ok"))
    second = _messages(spark, ("C", "C", "204", 30, 3, "ok"), ("D", "D", "204", 550, 4, "ok"))
    last = _messages(spark, ("E", "E", "204", 6000, 5, "ok"))
    # Lateness is judged one batch behind the newest watermark, hence the batch between.
    between = _messages(spark, ("F", "F", "204", 601, 6, "ok"))
    jobs.run_available_now(jobs.windowed_rollup(_streamed(spark, first, between, second, last), watermark="2 hours"), "st1_late")
    hours = {r.bucket.hour: r.txn_count for r in spark.table("st1_late").collect()}
    # C (12:30) is behind the watermark of 20:00 that B set; D (21:10) is not.
    assert hours == {12: 1, 21: 1, 22: 2}


def test_state_of_one_instant_is_the_highest_event_id(spark):
    state = tempfile.mkdtemp(prefix="fl-state-")
    handle = jobs.current_state_batch(state)
    high = _messages(spark, ("A", "A", "204", 0, 9, "failed"), ("B", "B", "204", 0, 1, "failed"))
    low = _messages(spark, ("A", "A", "204", 0, 2, "ok"), ("B", "B", "204", 0, 5, "ok"))
    handle(high, 0)
    handle(low, 1)
    want = lc.current_state(high.unionByName(low))
    cols = ["business_ref", "current_status"]
    assert _rows(jobs.read_state(spark, state), cols) == _rows(want, cols) == [("A", "failed"), ("B", "ok")]
