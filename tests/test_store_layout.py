"""The shared tables: what they hold, and that what one task gets does not grow with the input."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from flowlens.operators import doctypes, sla
from flowlens.plans import catalog_analytics, catalog_io
from flowlens.sources import colocated, fixtures, keyed, store
from flowlens.sources.fixtures import World

AT = dt.datetime(2024, 1, 5)


def _folder(name):
    return tempfile.mkdtemp(prefix=f"fl-{name}-") + "/t"


@pytest.fixture(scope="module")
def odd(spark):
    """Orders that come twice, have a null key or no lines; lines that come twice, have a null number or a null key."""
    src = tempfile.mkdtemp(prefix="fl-input-")
    tables = {
        "nation": ([(0, "NATION_0", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(1, 0, "auto")], "c_custkey long, c_nationkey int, c_mktsegment string"),
        "orders": ([(k, 1, "F", 10.0, AT, "1-URGENT") for k in (1, 2, 2, 3, None)],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        "lineitem": ([(1, 1), (1, 1), (1, None), (1, None), (2, 4), (None, 5)], "l_orderkey long, l_linenumber int")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{src}/{name}.parquet")
    return src


def test_each_order_row_has_its_messages_and_one_214_per_distinct_line(spark, odd):
    got = sorted(map(str, World(spark, odd).events().groupBy("interchange_id", "doc_type").count().collect()))
    want = [("ORD-000000001", "204", 1), ("ORD-000000001", "990", 1), ("ORD-000000001", "210", 1), ("ORD-000000001", "214", 2),
            ("ORD-000000002", "204", 2), ("ORD-000000002", "990", 2), ("ORD-000000002", "210", 2), ("ORD-000000002", "214", 2),
            ("ORD-000000003", "204", 1), ("ORD-000000003", "990", 1), ("ORD-000000003", "210", 1),
            (None, "204", 1), (None, "210", 1)]
    assert got == sorted(map(str, spark.createDataFrame(want, "interchange_id string, doc_type string, count long").collect()))


def test_only_tenders_meet_acks(spark, odd):
    w = World(spark, odd)
    rows = w.edi_tx().groupBy("shipment_id", "transaction_type").agg(F.count("ack_timestamp").alias("acked"), F.count("*").alias("n"))
    found = {(r.shipment_id, r.transaction_type): (r.acked, r.n) for r in rows.collect()}
    # Two tenders of order 2 meet its two acks.
    assert found["ORD-000000002", "204"] == (4, 4) and found["ORD-000000001", "204"] == (1, 1)
    assert found["ORD-000000002", "214"] == (0, 2) and found[None, "204"] == (0, 1)
    plan = fixtures.edi_transactions(w.events(), w.acks())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("Join LeftOuter")


def test_more_input_makes_more_files_not_larger_ones(spark, monkeypatch):
    base = store.pieces(spark, 0)
    assert store.pieces(spark, 100 * base * store.PIECE_BYTES) == 100 * base
    monkeypatch.setattr(store, "PIECE_BYTES", 4096)
    made = store.stored(spark, _folder("key").replace("/", "_"), "t", lambda: World(spark, SF_SMALL).header(), "shipment_date",
                        store.pieces(spark, 40 * 4096))
    assert len(made.inputFiles()) > 30


def test_tables_made_from_orders_do_not_shuffle(spark):
    w = World(spark, SF_SMALL)
    for df in (fixtures.txn_events(spark, SF_SMALL, w.orders()), fixtures.ack_events(spark, SF_SMALL, w.orders()),
               fixtures.shipment_header(spark, SF_SMALL, w.orders())):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_only_named_sources_are_built(spark, monkeypatch):
    for name in ("edi_tx", "anomalies"):
        monkeypatch.setattr(World, name, lambda self: pytest.fail("not asked for"))
    assert catalog_analytics.t19_delay_history(spark, SF_SMALL).count() > 0


def test_config_tables_are_broadcast(spark):
    w = World(spark, SF_SMALL)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = doctypes.with_doc_catalog(w.rollup(), w.catalog())._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        seen = []
        real = sla.first_at_or_after
        sla.first_at_or_after = lambda left, right, *a, **k: (seen.extend((left, right)), real(left, right, *a, **k))[1]
        try:
            sla.sla_rule_pairs(w.events_with_acks(), w.sla_rules(), w.as_of)
        finally:
            sla.first_at_or_after = real
        for side in seen:
            assert "SortMergeJoin" not in side._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_task_writes_one_bucket_of_a_base(spark, monkeypatch):
    monkeypatch.setattr(keyed, "TARGET_BYTES", 2000)
    schema = spark.range(0).select(F.col("id").alias("k"), F.lit(0).alias("v")).schema
    t = keyed.KeyedTable(spark, _folder("keyed"), schema, ["k"], lambda batch, old: batch)
    t.upsert(spark.range(4000).select(F.col("id").alias("k"), F.lit(0).alias("v")))
    base = next(c for c in t._epoch()[1] if c.kind == "base")
    files = [f.rsplit("/", 2)[1:] for f in spark.read.parquet(f"{t.path}/{base.folder}").inputFiles()]
    assert base.buckets > 4 and len(files) == base.buckets
    # The task's number stands in the file's name: no two buckets are of one task.
    assert len({name.split("-")[1] for _, name in files}) == base.buckets
    assert t.read().count() == 4000


def test_hot_buckets_are_found_without_a_shuffle_of_keys(spark):
    rows = spark.range(6000).select(F.col("id").alias("k"))
    assert "Exchange" not in colocated.store_together(_folder("even"), (rows, ["k"]), n_buckets=8)[0].groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    hot = rows.select(F.when(F.col("k") < 4000, 7).otherwise(F.col("k")).alias("k"))
    assert "Exchange" in colocated.store_together(_folder("hot"), (hot, ["k"]), n_buckets=8)[0].groupBy("k").count()._jdf.queryExecution().executedPlan().toString()


def test_the_silent_feed_stream_is_written_with_the_columns_it_reads(spark):
    w = World(spark, SF_SMALL)
    narrow = catalog_io._arrivals(w, ["partner", "event_time"])
    assert [b.columns for b in narrow] == [["partner", "event_time"]] * 3
    assert sum(b.count() for b in narrow) == w.events().count()
