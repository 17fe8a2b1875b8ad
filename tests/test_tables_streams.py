"""Upserted tables, the rollup that follows late events, and streams in several batches."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from flowlens.functions.timeutil import add_days, ts_lit
from flowlens.operators import monitors as mo
from flowlens.operators import rollup as ro
from flowlens.sources import contracts as C
from flowlens.sources import incremental as inc
from flowlens.sources import io
from flowlens.sources import keyed
from flowlens.sources.fixtures import World
from flowlens.streaming import jobs

SCHEMA = "k string, g int, v long"


def _folder(name):
    return tempfile.mkdtemp(prefix=f"fl-{name}-") + "/t"


def _files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet") and "_refreshes" not in d}


def _sum_table(spark, path):
    from pyspark.sql.types import _parse_datatype_string

    def add(batch, old):
        return batch.unionByName(old).groupBy("k", "g").agg(F.sum("v").alias("v"))
    return keyed.KeyedTable(spark, path, _parse_datatype_string(SCHEMA), ["k", "g"], add)


@pytest.mark.parametrize("target,share,most", [(128 << 20, 0.5, 32), (300, 10.0, 3)])
def test_upserts_equal_a_full_merge(spark, monkeypatch, target, share, most):
    monkeypatch.setattr(keyed, "TARGET_BYTES", target)
    monkeypatch.setattr(keyed, "COMPACT_SHARE", share)
    monkeypatch.setattr(keyed, "MOST_DELTAS", most)
    table, want = _sum_table(spark, _folder("keyed")), {}
    for b in range(4):
        rows = [(f"k{(b * 7 + i) % 23}" if i % 5 else None, i % 2, b * 100 + i) for i in range(12)]
        assert table.upsert(spark.createDataFrame(rows, SCHEMA), "w", b)
        for k, g, v in rows:
            want[k, g] = want.get((k, g), 0) + v
        # The same batch again, and one before it, change nothing.
        assert not table.upsert(spark.createDataFrame(rows, SCHEMA), "w", b)
        assert not table.upsert(spark.createDataFrame(rows, SCHEMA), "w", 0)
        table.remove_old(keep=0)
        assert {(r.k, r.g): r.v for r in table.read().collect()} == want
    assert table.upsert(spark.createDataFrame([("k1", 1, 1)], SCHEMA), "other", 0)
    assert table.upsert(spark.createDataFrame([("k1", 1, 1)], SCHEMA))


def test_a_batch_writes_what_it_changes(spark):
    path = _folder("keyed")
    table = _sum_table(spark, path)
    table.upsert(spark.createDataFrame([(f"key-{i}", i % 3, i) for i in range(20_000)], SCHEMA), "w", 0)
    before = _files(path)
    table.upsert(spark.createDataFrame([("key-5", 2, 1), ("new", 0, 7)], SCHEMA), "w", 1)
    new = _files(path) - before
    assert before <= _files(path)
    assert sum(map(os.path.getsize, new)) < 0.05 * sum(map(os.path.getsize, before))
    got = {r.k: r.v for r in table.read().filter("k IN ('key-5', 'new', 'key-6')").collect()}
    assert got == {"key-5": 6, "new": 7, "key-6": 6}


@pytest.mark.parametrize("when", ["commit", "compact"])
def test_a_crash_between_write_and_commit_loses_nothing(spark, monkeypatch, when):
    path = _folder("keyed")
    table = _sum_table(spark, path)
    table.upsert(spark.createDataFrame([("a", 0, 1), ("b", 0, 2)], SCHEMA), "w", 0)
    if when == "compact":
        monkeypatch.setattr(keyed, "MOST_DELTAS", 1)
    commits = []

    def dies(self, epoch, *rows):
        commits.append(rows)
        if when == "commit" or rows[0][1] == "base":
            raise OSError("gone")
        return real(self, epoch, *rows)

    real = keyed.KeyedTable._commit
    monkeypatch.setattr(keyed.KeyedTable, "_commit", dies)
    with pytest.raises(OSError):
        table.upsert(spark.createDataFrame([("a", 0, 10)], SCHEMA), "w", 1)
    monkeypatch.setattr(keyed.KeyedTable, "_commit", real)
    done = when == "compact"  # the delta was committed, its compaction was not
    assert {r.k: r.v for r in table.read().collect()} == ({"a": 11, "b": 2} if done else {"a": 1, "b": 2})
    assert table.upsert(spark.createDataFrame([("a", 0, 10)], SCHEMA), "w", 1) is not done
    table.remove_old(keep=0)
    assert {r.k: r.v for r in table.read().collect()} == {"a": 11, "b": 2}


# ------------------------------------------------------------------- rollup
@pytest.mark.parametrize("grain", ["day", "month"])
def test_late_events_enter_the_rollup(spark, grain):
    w = World(spark, SF_SMALL)
    ev, log, rollup, full = w.events(), _folder("log"), _folder("rollup"), _folder("full")
    cut = add_days(ts_lit(w.as_of), -30)
    old = F.col("event_time") < cut
    # A few messages of three old days come a month late.
    days = [r.d for r in ev.filter(old).select(F.to_date("event_time").alias("d")).distinct().orderBy("d").limit(40).collect()][::15]
    late = old & F.to_date("event_time").isin(days) & (F.col("event_id") % 3 == 0)
    early = spark.sql(f"SELECT TIMESTAMP_NTZ '{w.as_of}' - INTERVAL 30 DAY AS t").first().t
    inc.append_events(ev.filter(old & ~late), log, 0, grain)
    assert inc.refresh_rollup(spark, log, rollup, early, grain) > 0
    inc.append_events(ev.filter(~old), log, 1, grain)
    inc.refresh_rollup(spark, log, rollup, w.as_of, grain)
    before = _files(rollup)
    inc.append_events(ev.filter(late), log, 2, grain)
    n = inc.refresh_rollup(spark, log, rollup, w.as_of, grain)
    after = _files(rollup)
    touched = {f"part={d.isoformat() if grain == 'day' else d.replace(day=1).isoformat()}" for d in days}
    assert n == len(touched)
    assert {f.split("/")[-2] for f in before - after} == touched and {f.split("/")[-2] for f in after - before} == touched
    assert inc.refresh_rollup(spark, log, rollup, w.as_of, grain) == 0 and _files(rollup) == after
    io.rebuild_rollup(ev, full, w.as_of, grain)
    rows = [sorted(map(str, io.read_rollup(spark, p).collect())) for p in (rollup, full)]
    assert rows[0] == rows[1]


def test_a_refresh_that_dies_is_done_again(spark, monkeypatch):
    w = World(spark, SF_SMALL)
    ev, log, rollup = w.events().limit(2000), _folder("log"), _folder("rollup")
    ev = spark.createDataFrame(ev.collect(), ev.schema)
    inc.append_events(ev.filter("event_id % 2 = 0"), log, 0, "month")
    inc.refresh_rollup(spark, log, rollup, w.as_of, "month")
    inc.append_events(ev.filter("event_id % 2 = 1"), log, 1, "month")
    real = inc.append_row
    monkeypatch.setattr(inc, "append_row", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        inc.refresh_rollup(spark, log, rollup, w.as_of, "month")
    monkeypatch.setattr(inc, "append_row", real)
    inc.append_events(ev.filter("event_id % 2 = 1"), log, 1, "month")  # the batch is written again, too
    inc.refresh_rollup(spark, log, rollup, w.as_of, "month")
    assert sorted(map(str, io.read_rollup(spark, rollup).collect())) == sorted(map(str, ro.hourly_rollup(ev, w.as_of).select(
        *C.ROLLUP.names).collect()))


# ------------------------------------------------------------------ streams
def _runs(spark, name, batches, job, schema=None):
    """The batches as files of one stream, each taken by a run of its own that resumes from the checkpoint."""
    path = _folder(name)
    for b in batches:
        b.write.mode("append").parquet(path)
        job(spark.readStream.schema(schema or b.schema).parquet(path))


def test_stream_rollup_counts_rows_however_late(spark):
    w, path = World(spark, SF_SMALL), _folder("st1")
    ev = jobs.as_stream_time(w.events())
    cut = ts_lit(w.as_of).cast("timestamp") - F.expr("INTERVAL 400 DAYS")
    late, old = F.col("event_id") % 10 == 0, F.col("event_time") < cut
    batches = [ev.filter(old & ~late), ev.filter(~old & ~late), ev.filter(late)]
    handle, name = jobs.rollup_batch(path, "st1"), os.path.basename(os.path.dirname(path))
    _runs(spark, "st1-src", batches, lambda s: jobs.run_available_now(s, name, foreach_batch=handle, resume=True))
    handle(batches[1], 1)  # a batch that comes again
    got = jobs.stream_rollup_table(spark, path).read()
    want = ro.hourly_rollup(w.events(), w.as_of).drop("breached_count").select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


NOON = dt.datetime(2024, 5, 1, 12)


def _at(minutes):
    return None if minutes is None else NOON + dt.timedelta(minutes=minutes)


def _messages(spark, *rows):
    schema = C.events_schema()
    blank = dict.fromkeys(schema.fieldNames())
    full = [blank | dict(event_id=i, event_time=_at(m), partner=p, doc_type="204", channel="as2", environment="prod")
            for i, (p, m) in enumerate(rows)]
    return jobs.as_stream_time(spark.createDataFrame([tuple(x[c] for c in schema.fieldNames()) for x in full], schema))


def test_silent_feeds_equal_the_rule_at_each_instant(spark):
    """Feeds that come, that come late, that never come, that come back and that get a new due time."""
    due = {"never": (0, 10, None), "on_time": (0, 10, -500), "late": (0, 30, -60), "back": (5, 10, None), "later": (200, 10, 20), "other": (900, 5, None)}
    expected = spark.createDataFrame([(p, "204", "as2", "prod", _at(d), g, _at(s)) for p, (d, g, s) in due.items()],
                                     "partner string, doc_type string, channel string, environment string, "
                                     "expected_next_at timestamp_ntz, grace_minutes int, last_seen_at timestamp_ntz")
    again = spark.createDataFrame([("on_time", "204", "as2", "prod", _at(300), 10, None)], expected.schema)
    none = expected.limit(0)
    batches = [(expected, [("clock", -100)]), (none, [("on_time", 3), ("clock", 40)]), (none, [("clock", 100), ("late", 90)]),
               (again, [("back", 130), ("clock", 180), ("late", 1)]), (none, [("clock", 500)]), (none, [("later", 205), ("clock", 501)])]
    seeds, msgs = _folder("feeds"), _folder("msgs")
    delay, open_feeds, seen, dues, rows_before = 20, {}, {p: s for p, (_, _, s) in due.items()}, {p: (d, g) for p, (d, g, _) in due.items()}, 0
    out, watermark = _folder("turns"), None
    turns = []
    for feed_rows, messages in batches:
        feed_rows.coalesce(1).write.mode("append").parquet(seeds)
        _messages(spark, *messages).coalesce(1).write.mode("append").parquet(msgs)
        stream = jobs.silent_feeds(spark.readStream.schema(expected.schema).parquet(seeds), jobs.event_stream(spark, msgs),
                                   f"{delay} minutes")
        jobs.run_available_now(stream, "st5-" + out.split("/")[-2], sink="parquet", path=out, resume=True)
        for p, m in messages:
            if p in dues:
                seen[p] = m if seen[p] is None else max(seen[p], m)
        if feed_rows is again:
            dues["on_time"] = (300, 10)
        watermark = max(m for _, m in messages) - delay if watermark is None else max(watermark, max(m for _, m in messages) - delay)
        table = spark.createDataFrame([(p, "204", "as2", "prod", _at(d), g, _at(seen[p])) for p, (d, g) in dues.items()], expected.schema)
        rule = {r.partner for r in mo.missing_feeds(table, _at(watermark)).collect()}
        got = spark.read.parquet(out).collect()
        last = {}
        for r in sorted(got, key=lambda r: (r.expected_next_at, r.turn != "silent")):
            last[r.partner] = r.turn
        assert {p for p, t in last.items() if t == "silent"} == rule, (watermark, last, rule)
        turns.append(sorted(rule))
    assert turns[0] == [] and turns[1] == ["back", "never"]
    assert "never" in turns[5] and "back" not in turns[5] and "on_time" in turns[5]


def test_file_stream_skips_a_batch_it_holds(spark):
    files, path = World(spark, SF_SMALL).files().limit(50), _folder("st6")
    files = spark.createDataFrame(files.collect(), files.schema)
    handle = jobs.file_upsert_batch(path, "st6")
    handle(files.limit(20), 0)
    before = _files(path)
    handle(files.limit(20), 0)
    assert _files(path) == before
    handle(files, 1)
    assert io.read_files(spark, path).count() == 50


@pytest.mark.parametrize("part", [20_000, 1 << 30])
def test_batches_merged_by_parts_leave_only_what_the_log_names(spark, monkeypatch, part):
    monkeypatch.setattr(keyed, "PART_BYTES", part)
    monkeypatch.setattr(keyed, "TARGET_BYTES", 15_000)
    monkeypatch.setattr(keyed, "free_shuffles", lambda spark: None)
    path, want = _folder("parts"), {}
    table, written = _sum_table(spark, path), []
    real = table._write_base
    monkeypatch.setattr(table, "_write_base", lambda rows, *a: (written.append(rows.count()), real(rows, *a)))
    # Keys of another type than the table's, null ones, new ones and known ones.
    for b, (low, high) in enumerate([(0, 3000), (3000, 3200), (2950, 3050), (0, 10)]):
        rows = spark.range(low, high, 1, 4).select(F.when(F.col("id") % 7 > 0, F.concat(F.lit("k"), "id")).alias("k"),
                                                   (F.col("id") % 2).alias("g"), (F.col("id") + b).alias("v"))
        assert table.upsert(rows.groupBy("k", "g").agg(F.sum("v").alias("v")), "w", b)
        for r in rows.collect():
            want[r.k, r.g] = want.get((r.k, r.g), 0) + r.v
        assert {(r.k, r.g): r.v for r in table.read().collect()} == want and table.read().count() == len(want)
    # The first batch was the base, written in parts if it was large; what was staged is gone.
    assert (len(written) > 2 and max(written) < 1500) if part == 20_000 else len(written) == 1
    kept = {c.folder for c in table._epoch()[1] if c.folder}
    assert {f"data/{n}".removesuffix(keyed.REPLACED) for n in os.listdir(f"{path}/data")} == kept
    assert [c.n_old == 0 for c in table._epoch()[1]][1:] == [False] * 3  # null keys come again
    table.compact()
    table.remove_old(keep=0)
    assert len(os.listdir(f"{path}/data")) == 1 and {(r.k, r.g): r.v for r in table.read().collect()} == want


def test_a_table_that_is_added_to_is_read_without_a_shuffle(spark):
    table = _sum_table(spark, _folder("added"))
    for b in range(3):
        table.upsert(spark.range(b * 50, b * 50 + 50).selectExpr("concat('k', id) AS k", "int(0) AS g", "id AS v"), "w", b)
    assert "Exchange" not in table.read()._jdf.queryExecution().executedPlan().toString() and table.read().count() == 150
    table.upsert(spark.createDataFrame([("k7", 0, 1000)], SCHEMA), "w", 3)
    assert table.read().count() == 150 and table.read().filter("k = 'k7'").first().v == 1007


def test_the_state_stream_keeps_no_copies_of_its_input(spark):
    from flowlens.plans import catalog_io
    folders = []
    real = catalog_io._folder
    catalog_io._folder = lambda *a: folders.append(real(*a)) or folders[-1]
    try:
        got = catalog_io.st2_current_state_stream(spark, SF_SMALL)
    finally:
        catalog_io._folder = real
    state, source = folders
    assert _files(source) == set() and got.count() == World(spark, SF_SMALL).events().select("business_ref").distinct().count()
    commits = jobs.state_table(spark, state)._epoch()[1]
    assert len([n for n in os.listdir(f"{state}/data")]) == len([c for c in commits if c.folder])


def test_large_backlogs_are_matched_span_by_span(spark, duck, monkeypatch):
    import __spark_entry__ as entry
    from flowlens.plans import catalog_io
    from flowlens.plans.check import compare
    ev = jobs.as_stream_time(World(spark, SF_SMALL).events())
    cut = F.lit(dt.datetime(1995, 6, 1))
    assert len(catalog_io._spans(ev, cut)) == 2
    monkeypatch.setattr(catalog_io, "STATE_ROWS", 700)
    spans, at = catalog_io._spans(ev, cut), F.col("event_time")
    sizes = [ev.filter((F.lit(True) if a is None else at >= a) & (F.lit(True) if b is None else at < b)).count() for a, b in spans]
    assert sum(sizes) == ev.count() and max(sizes) < 1.2 * 700 * spark.sparkContext.defaultParallelism and len(sizes) > 3
    taken = []
    real = jobs.run_available_now
    monkeypatch.setattr(jobs, "run_available_now", lambda *a, **k: taken.append(real(*a, **k)))
    name = "st4_response_match_stream"
    ok, info = compare(entry.queries()[name](spark, SF_SMALL), duck, entry.oracle_sql()[name])
    assert ok, info
    assert len(taken) > 3 and spark.conf.get("spark.sql.streaming.maxBatchesToRetainInMemory") == "2"
