import datetime as dt

import pytest

from casemill.operators import analytics, audit, manifest, metrics

SCHEMA = "ticket_id string, created_at timestamp_ntz, product_area string, issue_type string, status string, is_resolved boolean, resolution_time_hours double, response_time_hours double, csat_score double, escalated boolean, sla_breached boolean"
ROWS = [
    ("T1", dt.datetime(2023, 1, 1), "Payments", "Billing", "resolved", True, 2.0, 1.0, 5.0, True, True),
    ("T2", dt.datetime(2023, 1, 2), "Payments", "Billing", "resolved", True, 4.0, 2.0, 3.0, False, False),
    ("T3", dt.datetime(2023, 1, 3), "Auth", "Billing", "resolved", True, 6.0, None, None, None, None),
    ("T4", dt.datetime(2023, 1, 4), "Auth", "Technical", "resolved", True, None, None, 4.0, False, None),
    ("T5", dt.datetime(2023, 1, 5), "Auth", "Technical", "open", False, None, None, None, False, None),
    ("T6", dt.datetime(2023, 1, 6), "Payments", "Technical", "resolved", True, 0.0, 3.0, None, True, None),
]


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_block_by_hand(cases):
    r = metrics.metric_block(cases).first()
    assert (r.resolution_mean, r.resolution_n, r.response_mean, r.response_n) == (4.0, 3, 2.0, 3)
    assert (r.escalation_rate, r.escalation_n, r.sla_breach_rate, r.sla_n) == (0.4, 5, 0.5, 2)
    assert (r.csat_mean, r.csat_n, r.csat_response_rate) == (4.0, 3, 0.5)


def test_nothing_is_null_not_zero(cases):
    r = metrics.metric_block(cases.limit(0)).first()
    assert r.ticket_volume == 0 and r.resolution_n == 0 and r.resolution_mean is None and r.csat_mean is None and r.csat_response_rate is None


def test_views_agree(cases):
    whole = analytics.overview(cases).first()
    assert (whole.resolved_count, whole.open_count) == (5, 1)
    for part in (analytics.by_dimension(cases, "product_area"), analytics.timeseries(cases, "W"), analytics.timeseries(cases, "QE")):
        rows = part.collect()
        assert sum(r.ticket_volume for r in rows) == whole.ticket_volume and sum(r.csat_n for r in rows) == whole.csat_n
    sets = {(r.dimension, r.category): r for r in metrics.grouping_sets(cases, ["product_area", "issue_type"]).collect()}
    assert len(sets) == 5 and sets["overview", None].resolution_mean == 4.0 and sets["product_area", "Auth"].ticket_volume == 3


def test_group_without_resolved_cases_keeps_its_hours(spark):
    rows = [("a", None, "X", "t", "open", False, 3.0, None, None, None, None), ("b", None, "X", "t", None, None, 5.0, None, None, None, None)]
    r = metrics.metric_block(spark.createDataFrame(rows, SCHEMA), ["product_area"]).first()
    assert (r.resolution_mean, r.resolution_n) == (4.0, 2)


def test_filters_and_pages(cases):
    kept, ignored = analytics.apply_filters(cases, {"product_area": "Auth", "nope": 1, "status": []}, date_from="2023-01-04")
    assert sorted(r.ticket_id for r in kept.collect()) == ["T4", "T5"] and set(ignored) == {"nope"}
    page = analytics.paginate(cases, "ticket_id", 2, 4, ["ticket_id"]).collect()
    assert [r.ticket_id for r in page] == ["T5", "T6"]


def test_metric_record(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1.23456, 0), (1.23456, 5), (1.23456, 50)], "v double, n long")
    a, b, c = [r.m for r in df.select(metrics.metric_record(F.col("v"), F.col("n"), "d").alias("m")).collect()]
    assert a.value is None and a.note and b.value == 1.2346 and b.warning and c.warning is None


def test_audit_by_hand(spark, cases):
    p = {r.field: r for r in audit.profile(cases, ["csat_score", "status"]).collect()}
    assert (p["csat_score"].non_null, p["csat_score"].null_pct, p["status"].n_distinct) == (3, 50.0, 2)
    o = audit.outcome(cases, "status", "escalated").first()
    assert (o.positive, o.negative, o.both_classes, o.deterministic_from_status) == (2, 3, True, False)
    t = {r.field: r for r in audit.triage(spark.createDataFrame([(f"some long text number {i} that goes on and on", "x") for i in range(60)], "a string, b string"), ["a", "b"]).collect()}
    assert t["a"].verdict == "good" and t["b"].verdict == "unusable"
    assert audit.time_profile(cases.withColumn("resolved_at", cases.created_at)).first().split_feasible is False


def test_manifest(cases):
    rows = {r.metric: r for r in manifest.metric_availability(cases, least=3).collect()}
    assert rows["csat"].enabled and not rows["sla_breach_rate"].enabled and "fewer" in rows["sla_breach_rate"].reason
    ladder = manifest.risk_target(cases, least=2).collect()
    assert [r.target for r in ladder if r.chosen] == ["escalated"]
