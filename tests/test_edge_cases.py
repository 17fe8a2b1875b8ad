"""Hand-made edge cases with a literal as_of (the seeded stories of the reference)."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from conftest import AS_OF
from flowlens.operators import anomaly as an
from flowlens.operators import exceptions as ex
from flowlens.operators import files as fi
from flowlens.operators import lifecycle as lc
from flowlens.operators import monitors as mo
from flowlens.operators import sla
from flowlens.sources import contracts as C

NOW = dt.datetime(2024, 5, 1, 12, 0, 0)


def ago(minutes=0, hours=0, days=0):
    return NOW - dt.timedelta(minutes=minutes, hours=hours, days=days)


EVENT_DEFAULTS = dict(
    event_id=0, event_time=NOW, interchange_id="IC-1", business_ref="REF-1", environment="prod", lob="RETAIL",
    partner="ACME", channel="as2", protocol="edi", direction="in", doc_type="204", stage="acked", status="ok",
    reason_category=None, terminal=True, sla_due_at=None, value_usd=Decimal("0.00"), kchar=Decimal("1.00"),
    error_code=None, replayed=False, replayed_at=None, replay_count=0, control_number=None)


def events(spark, *rows):
    schema = C.events_schema()
    data = []
    for i, r in enumerate(rows):
        d = dict(EVENT_DEFAULTS, **{"event_id": i + 1, **r})
        data.append(tuple(d[f.name] for f in schema.fields))
    return spark.createDataFrame(data, schema)


def test_missing_feeds(spark):
    feeds = spark.createDataFrame([
        ("P1", "204", "as2", "prod", ago(35), 15, None),
        ("P2", "850", "sftp", "prod", ago(120), 30, ago(200)),
        ("P3", "810", "van", "prod", NOW + dt.timedelta(minutes=40), 15, None),
        ("P4", "856", "as2", "prod", ago(120), 30, ago(60)),  # seen after due
    ], C.MONITORS["ops_expected_feeds"])
    rows = {r.partner: r.mins_overdue for r in mo.missing_feeds(feeds, AS_OF).collect()}
    assert rows == {"P1": 35, "P2": 120}


def test_stale_monitor_and_reporting(spark):
    hb = spark.createDataFrame([("late", "as2", "prod", ago(18), 300)] +
                               [(f"ok{i}", "as2", "prod", ago(1), 300) for i in range(4)],
                               C.MONITORS["ops_monitor_heartbeat"])
    assert [(r.monitor_name, r.mins_silent) for r in mo.stale_monitors(hb, AS_OF).collect()] == [("late", 18)]
    assert mo.monitors_reporting(hb, AS_OF).first().reporting == 4


def test_hung_pipeline(spark):
    p = spark.createDataFrame([("p1", "prod", "running", 20, 0, Decimal("0"), ago(30)),
                               ("p2", "prod", "idle", 0, 0, Decimal("0"), ago(30))], C.MONITORS["ops_pipeline_health"])
    assert [r.pipeline for r in mo.hung_pipelines(p).collect()] == ["p1"]


def test_endpoints_and_certs(spark):
    d0 = NOW.date()
    ep = spark.createDataFrame([
        ("as2", "e1", "A", "prod", "down", ago(60), d0 + dt.timedelta(days=5)),
        ("as2", "e2", "B", "prod", "degraded", ago(60), d0 + dt.timedelta(days=3)),
        ("as2", "e3", "C", "prod", "up", ago(1), d0 + dt.timedelta(days=11)),
        ("as2", "e4", "D", "prod", "up", ago(1), d0 + dt.timedelta(days=120)),
        ("as2", "e5", "E", "prod", "up", ago(1), d0 + dt.timedelta(days=90)),
    ], C.MONITORS["ops_endpoint_health"])
    assert mo.endpoints_down(ep).count() == 2
    certs = {r.endpoint: (r.days_left, r.severity) for r in mo.cert_expiry(ep, AS_OF, 14).collect()}
    assert certs == {"e1": (5, "critical"), "e2": (3, "critical"), "e3": (11, "warning")}


def _file(spark, icid, declared, status="delivered"):
    row = dict(interchange_id=icid, file_name=icid + ".x12", environment="prod", partner="ACME", channel="as2",
               protocol="edi", direction="in", received_at=ago(60), completed_at=None, status=status,
               reason_category=None, declared_txn_count=declared, isa_control=None, gs_control=None,
               value_usd=None, kchar=None)
    return spark.createDataFrame([tuple(row[f.name] for f in C.FILES.fields)], C.FILES)


def test_lost_inside_file_and_rejected_at_receipt(spark):
    ev = events(spark, *[dict(interchange_id="F1", business_ref=f"R{i}", stage="received", terminal=False)
                         for i in range(187)])
    files = _file(spark, "F1", 200).unionByName(_file(spark, "F2", None, "rejected"))
    m = fi.files_missing_txns(files, ev).collect()
    assert [(r.interchange_id, r.actual_txns, r.missing_inside_file) for r in m] == [("F1", 187, 13)]
    assert [r.interchange_id for r in fi.rejected_at_receipt(files).collect()] == ["F2"]


def test_multi_stage_current_state(spark):
    ev = events(spark,
                dict(stage="received", event_time=ago(40), terminal=False),
                dict(stage="validated", event_time=ago(30), terminal=False),
                dict(stage="transformed", event_time=ago(20), terminal=False),
                dict(stage="customs", status="failed", event_time=ago(10), terminal=False))
    r = lc.current_state(ev).first()
    assert (r.current_stage, r.current_status, r.first_event_at, r.last_event_at) == ("customs", "failed", ago(40), ago(10))


def test_at_risk_tender(spark):
    ev = events(spark, dict(business_ref="T1", doc_type="204", direction="in", event_time=ago(25)),
                dict(business_ref="T2", doc_type="204", direction="in", event_time=ago(25)),
                dict(business_ref="T2", doc_type="990", direction="out", event_time=ago(5), event_id=99))
    assert [r.business_ref for r in sla.at_risk_tenders(ev, AS_OF).collect()] == ["T1"]
    rules = spark.createDataFrame([(1, "r", "prod", None, "204", "in", "990", "out", "business_ref", 30)],
                                  "rule_id int, name string, environment string, partner string, trigger_doc_type string,"
                                  " trigger_direction string, response_doc_type string, response_direction string,"
                                  " correlation_key string, threshold_minutes int")
    states = {r.business_ref: r.sla_state for r in sla.sla_rule_pairs(ev, rules, AS_OF).collect()}
    assert states == {"T1": "at_risk", "T2": "met"}


def test_refailed_replay(spark):
    ev = events(spark, dict(status="failed", replayed=True, replay_count=2, replayed_at=ago(5), terminal=False))
    rows = lc.replay_refailed(lc.current_state(ev)).collect()
    assert [(r.business_ref, r.replay_count) for r in rows] == [("REF-1", 2)]


def test_kb_override_and_null_code(spark):
    ev = events(spark, dict(business_ref="A", partner="ACME", status="failed", reason_category="mapping_defect",
                            error_code="E1"),
                dict(business_ref="B", partner="OTHER", status="failed", reason_category="mapping_defect",
                     error_code="E1"),
                dict(business_ref="C", partner="OTHER", status="rejected", reason_category="validation_error",
                     error_code=None))
    rules = spark.createDataFrame([
        (1, None, "mapping_defect", "E1", "generic", "g", "rb/g"),
        (2, "ACME", "mapping_defect", "E1", "partner", "p", "rb/p"),
        (3, None, "validation_error", None, "null code", "n", "rb/n"),
    ], "rule_id int, partner string, reason_category string, error_code string, likely_cause string,"
       " suggested_action string, runbook_url string")
    got = {r.business_ref: r.likely_cause for r in ex.resolution_kb(ev, rules).collect()}
    assert got == {"A": "partner", "B": "generic", "C": None}


def test_anomaly_edges(spark):
    # asof = 2024-03-29; base window 03-02..03-22, current 03-23..03-29
    rows = []
    for d in range(21):
        day = dt.date(2024, 3, 2) + dt.timedelta(days=d)
        rows += [("prod", "FLAT", "204", day, 6), ("prod", "DROP4", "204", day, 4), ("prod", "TINY", "204", day, 2)]
    for d in range(7):
        day = dt.date(2024, 3, 23) + dt.timedelta(days=d)
        rows += [("prod", "FLAT", "204", day, 6), ("prod", "TINY", "204", day, 2)]
    daily = spark.createDataFrame(rows, "environment string, partner string, doc_type string, day date, txns bigint")
    fa = {r.partner: r for r in an.feed_anomaly(daily, F.lit(dt.date(2024, 3, 29))).collect()}
    assert "TINY" not in fa                                   # base mean < 3 is ignored
    assert fa["FLAT"].zscore is None and fa["FLAT"].status == "Normal"   # sigma 0 -> drop test only
    assert fa["DROP4"].status == "Severe drop" and fa["DROP4"].days_silent == 7  # mean 4 -> not Silent


def test_mode_tie_null_due_and_empty_percent(spark):
    ev = events(spark,
                dict(business_ref="a", partner="ZED", sla_due_at=None, terminal=False),
                dict(business_ref="b", partner="ALPHA", sla_due_at=None, terminal=False))
    s = lc.shipments(ev, AS_OF).first()
    assert s.partner == "ALPHA"            # tie -> smallest value
    assert s.sla_breached is None          # NULL due date never breaches
    empty = lc.shipments(ev.filter(F.lit(False)), AS_OF)
    k = lc.order_sla_kpis(empty).first()
    assert k.on_time_pct is None and k.orders == 0
