"""Forward as-of match and exact percentile against brute force."""

import datetime as dt
import random

import numpy as np
import pytest

from flowlens.functions.stats import percentile_cont_by
from flowlens.operators.joins import first_at_or_after

T0 = dt.datetime(2024, 1, 1)


def _brute(left, right):
    out = {}
    for lid, key, lt in left:
        cands = [rt for k, rt in right if k == key and rt >= lt]
        out[lid] = min(cands) if cands else None
    return out


@pytest.mark.parametrize("partitions,batch", [(1, 10_000), (8, 10_000), (40, 7)])
def test_first_at_or_after_matches_brute_force(spark, partitions, batch):
    """One key holds most rows: it spans many partitions, some of which hold no right row at all."""
    conf = {"spark.sql.shuffle.partitions": partitions, "spark.sql.adaptive.coalescePartitions.enabled": False,
            "spark.sql.execution.arrow.maxRecordsPerBatch": batch}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    rnd = random.Random(7)
    keys = ["hot"] * 6 + ["k1", "k2", "k3", None]  # one hot key with most rows, a NULL key
    left = [(i, rnd.choice(keys), T0 + dt.timedelta(minutes=rnd.randint(0, 5000))) for i in range(400)]
    right = [(rnd.choice(keys), T0 + dt.timedelta(minutes=rnd.randint(0, 5000))) for _ in range(300)]
    right += [(k, t) for _, k, t in left[:20]]  # exact ties count as "at or after"
    right += [("late", T0 + dt.timedelta(days=9))]  # one match at the end of a long run of left rows
    left += [(1000 + i, "late", T0 + dt.timedelta(minutes=i // 3)) for i in range(300)] + [(2000, "hot", None), (2001, "late", None)]
    ldf = spark.createDataFrame(left, "lid int, key string, lt timestamp_ntz")
    rdf = spark.createDataFrame(right, "key string, rt timestamp_ntz")
    got = {r.lid: r.match_ts for r in first_at_or_after(ldf, rdf, ["key"], "lt", "rt").collect()}
    for k, v in before.items():
        spark.conf.set(k, v)
    want = _brute([r for r in left if r[2]], [(k, t) for k, t in right if k is not None])
    assert got == {lid: want[lid] if key is not None and t is not None else None for lid, key, t in left}


def test_percentile_cont_matches_numpy(spark):
    rnd = np.random.default_rng(3)
    rows = [("hot", int(v)) for v in rnd.integers(10, 900, 2000)] + [("small", int(v)) for v in [5, 1, 9, 7]] + \
           [("one", 42)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = {r.g: r.p for r in percentile_cont_by(df, ["g"], "v", 0.95, "p").collect()}
    for g in ("hot", "small", "one"):
        vals = np.array([v for k, v in rows if k == g], dtype=float)
        assert got[g] == pytest.approx(np.percentile(vals, 95), rel=1e-12)


@pytest.mark.parametrize("values", [[3, 1, 1, None, 7, 7, 7, 2, None] * 30 + [9], [5], [None, None], [4] * 9, list(range(500))])
def test_percent_rank_matches_a_sort(spark, values):
    from flowlens.plans.shapes import percent_rank

    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v int")
    ranked = percent_rank(df, "v")
    got = {r.i: r.rank_pct for r in ranked.collect()}
    order = sorted(values, key=lambda v: (v is None, v or 0))
    want = {i: order.index(v) / (len(values) - 1) if len(values) > 1 else 0.0 for i, v in enumerate(values)}
    assert got == want
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "SinglePartition, ENSURE" not in plan.split("Window")[1].split("\n")[1]


def test_duplicates_of_a_null_partner_are_marked(spark):
    from flowlens.operators.derive import mark_duplicates

    rows = [(1, 5, None, "204", "c1"), (2, 5, None, "204", "c1"), (3, 1, None, "204", "c1"), (4, 1, "P", "204", "c1"), (5, 1, "P", None, None),
            (6, 1, "P", None, None), (7, 2, "P", None, "c2"), (7, 2, "P", None, "c2"), (8, 1, "P", None, "c2")]
    df = spark.createDataFrame(rows, "event_id long, event_time int, partner string, doc_type string, control_number string")
    got = sorted((r.event_id, r.is_duplicate) for r in mark_duplicates(df).collect())
    assert got == [(1, True), (2, True), (3, False), (4, False), (5, False), (6, False), (7, True), (7, True), (8, False)]


def test_silent_days_have_rows_and_states(spark):
    from pyspark.sql import functions as F

    from flowlens.operators.anomaly import trailing_baseline

    day0 = dt.date(2024, 1, 1)
    rnd = random.Random(2)
    volumes = {"stops": lambda d: 10 + rnd.randint(0, 2) if d < 60 else 0, "steady": lambda d: 10, "sinks": lambda d: 10 if d < 70 else 3,
               "dips": lambda d: (10 + d % 3 * 3) if d < 85 else 10, "rare": lambda d: 60 if d % 7 == 0 else 0}
    rows = [("prod", f, "204", day0 + dt.timedelta(days=d), v(d)) for f, v in volumes.items() for d in range(100)]
    full = {(f, day): n for _, f, _, day, n in rows}
    daily = spark.createDataFrame([r for r in rows if r[4]], "environment string, partner string, doc_type string, day date, txns long")
    got = {(r.partner, r.day): r for r in trailing_baseline(daily).collect()}
    assert all((f, day0 + dt.timedelta(days=d)) in got for f in ("stops", "steady", "sinks", "dips") for d in range(40, 80))
    for (f, day), r in got.items():
        base = [full.get((f, day - dt.timedelta(days=k)), 0) for k in range(7, 28)]
        cur = [full.get((f, day - dt.timedelta(days=k)), 0) for k in range(7)]
        assert r.txns == full[f, day] and abs(r.base_mean - sum(base) / 21) < 0.051 and abs(r.cur_mean - sum(cur) / 7) < 0.051
    assert got["stops", day0 + dt.timedelta(days=66)].status == "Silent"
    assert {r.status for r in got.values()} == {"Silent", "Severe drop", "Watch", "Normal"}
