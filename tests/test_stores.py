"""Point look-ups, co-located joins and sketch cells."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from flowlens.operators import derive as de
from flowlens.operators import files as fi
from flowlens.operators import sketches as sk
from flowlens.operators import sla
from flowlens.sources import colocated as co
from flowlens.sources import lookup as lo
from flowlens.sources.fixtures import World


def _folder(name):
    return tempfile.mkdtemp(prefix=f"fl-{name}-") + "/t"


def _rows_read(df):
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.apply(0).metrics().apply("numOutputRows").value()


def test_a_look_up_reads_few_row_groups(spark):
    ev, path = World(spark, SF_SMALL).events(), _folder("lookup")
    lo.write_lookup(ev, path, row_group=16 * 1024)
    total = ev.count()
    one = ev.filter("control_number IS NOT NULL").orderBy("event_id").first()
    for c in lo.COLUMNS:
        got = lo.find(spark, path, **{c: one[c]})
        assert sorted(map(str, got.collect())) == sorted(map(str, ev.filter(F.col(c) == one[c]).collect()))
        assert _rows_read(got) < 0.6 * total, c
    # Clustered by reference: one row group, or two where it crosses an edge.
    assert _rows_read(lo.find(spark, path, business_ref=one.business_ref)) < 0.2 * total
    assert lo.find(spark, path, business_ref="no such").count() == 0
    with pytest.raises(ValueError):
        lo.find(spark, path, partner="x")


def test_joins_of_co_located_tables_do_not_shuffle(spark):
    w = World(spark, SF_SMALL)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        acks = co.store_together(_folder("a"), (w.events_with_acks(), ["control_number", "partner"]), n_buckets=4)[0]
        files, ev = co.store_together(_folder("f"), (w.files(), ["interchange_id"]), (w.events(), ["interchange_id"]), target=200_000)
        numbers = co.store_together(_folder("n"), (w.events(), ["partner", "doc_type", "control_number"]), n_buckets=4)[0]
        pairs = [(sla.ack_status(acks, w.as_of), sla.ack_status(w.events_with_acks(), w.as_of)),
                 (fi.files_missing_txns(files, ev), fi.files_missing_txns(w.files(), w.events())),
                 (fi.file_children(ev, files), fi.file_children(w.events(), w.files())),
                 (de.mark_duplicates(numbers), de.mark_duplicates(w.events()))]
        for n, (got, want) in enumerate(pairs):
            plan = got._jdf.queryExecution().executedPlan().toString()
            if n == 3:  # the counting does not shuffle; the few keys seen twice are joined back null-safe, which does
                plan = plan[plan.index("Aggregate"):]
                plan = plan[:plan.index("FileScan")]
            assert "Exchange" not in plan, plan
            assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_hot_key_is_not_bucketed(spark):
    assert [co.buckets_for(n, 100) for n in (0, 99, 101, 250, 900)] == [1, 1, 2, 4, 16]
    df = spark.range(1000).select(F.when(F.col("id") < 600, 0).otherwise(F.col("id")).alias("k"), "id")
    stored = co.store_together(_folder("hot"), (df, ["k"]), n_buckets=16)[0]
    assert "Exchange" in stored.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert stored.count() == 1000
    even = co.store_together(_folder("even"), (spark.range(1000), ["id"]), n_buckets=16)[0]
    assert "Exchange" not in even.groupBy("id").count()._jdf.queryExecution().executedPlan().toString()


def test_sketch_cells_stay_within_their_errors(spark):
    r = np.random.default_rng(1)
    rows = [(f"P{i % 3}", f"2024-01-{1 + i % 28:02d} {i % 24:02d}:00:00", int(v)) for i, v in enumerate(r.lognormal(5, 1, 30_000))]
    api = spark.createDataFrame(rows, "partner_id string, t string, latency_ms int").withColumn("request_ts", F.col("t").cast("timestamp_ntz"))
    cells = sk.latency_cells(api.unionByName(api.limit(1).withColumns({"partner_id": F.lit("none"), "latency_ms": F.lit(None).cast("int")})))
    scopes = {"partner": ["partner_id"], "week": [F.weekofyear("bucket").alias("week")], "all": []}
    for by in scopes.values():
        for row in sk.latency_quantiles(cells, by).collect():
            values = np.array([v for p, t, v in rows if not by or p == row[0] or isinstance(row[0], int)])
            if by and isinstance(row[0], int):
                continue
            for q, x in ((0.5, row.p50), (0.95, row.p95)):
                assert (values < x).mean() - 2 * sk.RANK_ERROR <= q <= (values <= x).mean() + 2 * sk.RANK_ERROR
            assert row.calls == len(values)
    schema = "event_time timestamp_ntz, status string, reason_category string, error_code string, stage string, partner string, business_ref string"
    base = spark.range(40_000).select(
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, int(id % 60))").alias("event_time"), F.lit("failed").alias("status"),
        F.lit("r").alias("reason_category"), F.lit(None).cast("string").alias("error_code"), F.lit("s").alias("stage"),
        F.concat(F.lit("P"), F.col("id") % 2).alias("partner"), (F.col("id") % 9000).cast("string").alias("business_ref"))
    assert base.columns == [c.split()[0] for c in schema.split(", ")]
    stored = sk.failure_cells(base)
    for row in sk.distinct_refs(stored, ["partner"]).collect():
        assert row.occurrences == 20_000 and abs(row.refs - 4500) <= 4 * sk.DISTINCT_ERROR * 4500
    assert abs(sk.distinct_refs(stored, []).first().refs - 9000) <= 4 * sk.DISTINCT_ERROR * 9000
