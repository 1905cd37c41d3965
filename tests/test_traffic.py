from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from fwlens.operators import investigate, report_tables, traffic
from fwlens.operators.correlate import correlate_alerts
from tests.conftest import EVENT_SCHEMA, START

LOGS = [("a", "x", 443, "ALLOW", 1, 3), ("a", "y", 443, "BLOCK", 2, 4), ("b", "x", 9999, "BLOCK", 10, 20)]
NAMES = "src_ip string, dst_ip string, dst_port int, action string, bytes_sent bigint, bytes_received bigint"


@pytest.fixture
def logs(spark):
    return spark.createDataFrame(LOGS, NAMES)


def test_rankings(spark, logs):
    alerts = spark.createDataFrame([("b",), ("b",)], "src_ip string")
    incidents = spark.createDataFrame([("b", 60), ("b", 25)], "src_ip string, risk_score int")
    sources = traffic.top_source_ips(logs, alerts, incidents, 5).collect()
    assert [(r.src_ip, r.total_events, r.allowed_events, r.blocked_events, r.bytes_sent_total, r.alert_count,
             r.highest_incident_risk_score) for r in sources] == [("a", 2, 1, 1, 3, 0, 0), ("b", 1, 0, 1, 10, 2, 60)]
    assert (sources[0].unique_dst_ips, sources[0].unique_dst_ports, sources[0].blocked_ratio) == (2, 1, 0.5)
    ports = traffic.top_destination_ports(logs, 5).collect()
    assert [(r.dst_port, r.service_name, r.blocked_ratio) for r in ports] == [(443, "HTTPS", 0.5), (9999, "Unknown", 1.0)]
    assert [r.dst_ip for r in traffic.top_destination_ips(logs, 1).collect()] == ["x"]
    assert traffic.top_source_ips(logs, top_n=0).count() == 1
    assert traffic.port_labels(traffic.top_destination_ports(logs)).first().port_label == "443 - HTTPS"


def test_rankings_without_optional_columns(spark):
    bare = spark.createDataFrame([("a",), ("a",)], "src_ip string")
    row = traffic.top_source_ips(bare).first()
    assert (row.total_events, row.blocked_events, row.unique_dst_ips, row.bytes_sent_total) == (2, 0, 0, 0)
    assert traffic.top_destination_ports(bare).isEmpty() and traffic.top_destination_ips(bare).isEmpty()


def test_counters(spark, logs, alert_rows, config):
    alerts = alert_rows([(0, "a", "Port scan"), (1, "a", "Host scan")])
    incidents = correlate_alerts(alerts, config)
    assert traffic.kpi_summary(logs, alerts, incidents).first().asDict() == {
        "events": 3, "allowed": 1, "blocked": 2, "alerts": 2, "incidents": 1, "critical_incidents": 0, "highest_risk": 60,
    }
    assert [tuple(r) for r in traffic.action_counts(logs).collect()] == [("ALLOW", 1), ("BLOCK", 2)]
    assert [tuple(r) for r in traffic.severity_histogram(incidents).collect()] == [("Low", 0), ("Medium", 0), ("High", 1), ("Critical", 0)]
    assert [tuple(r) for r in traffic.severity_histogram(incidents.limit(0)).collect()][0] == ("Low", 0)


@pytest.mark.parametrize("span,unit,bins", [(600, "second", 601), (601, "minute", 11), (7200, "minute", 121), (7201, "hour", 3), (172800, "hour", 49), (172801, "day", 3)])
def test_bins_follow_the_span(events, span, unit, bins):
    rows = traffic.events_over_time(events([(0, {}), (1, {}), (span, {})])).collect()
    assert len(rows) == bins and {r.bin_unit for r in rows} == {unit} and sum(r.events for r in rows) == 3
    assert rows[1].events == (1 if unit == "second" else 0)


def test_no_events_no_bins(spark):
    assert traffic.events_over_time(spark.createDataFrame([], EVENT_SCHEMA)).isEmpty()


def test_domains(events):
    logs = events([(0, {}), (86400, {"src_ip": "b", "dst_port": 80})])
    assert tuple(traffic.date_domain(logs).first()) == (date(2026, 7, 1), date(2026, 7, 2))
    assert [r.src_ip for r in traffic.value_domain(logs, "src_ip").collect()] == ["10.0.0.1", "b"]
    assert tuple(traffic.observed_counts(logs).first()) == (2, 2, 0.0)


def test_filters(events, alert_rows, config):
    logs = events([(0, {}), (86399 - 9 * 3600, {}), (86400, {"src_ip": "b"})])
    alerts = alert_rows([(0, "10.0.0.1", "Port scan"), (3000, "b", "Host scan")])
    incidents = correlate_alerts(alerts, config)
    day = investigate.FilterSpec(start=date(2026, 7, 1), end=date(2026, 7, 1))
    assert [df.count() for df in investigate.filter_views(logs, alerts, incidents, day)] == [2, 1, 1]
    source = investigate.FilterSpec(sources=("b",))
    assert [df.count() for df in investigate.filter_views(logs, alerts, incidents, source)] == [1, 1, 1]
    kind = investigate.FilterSpec(severities=("Low",), alert_types=("Host scan",))
    assert [df.count() for df in investigate.filter_views(logs, alerts, incidents, kind)] == [3, 1, 1]
    assert investigate.search(alerts.select("alert_id", "alert_type"), "HOST|nothing").count() == 1


def test_threshold_views(spark):
    rows = [("ALT-1", '{"threshold_source": "per_asset_baseline", "effective_threshold": 6, "observed_value": 9}'), ("ALT-2", "{bad"), ("ALT-3", None)]
    table = spark.createDataFrame(rows, "alert_id string, evidence string")
    found = {r.alert_id: (r.threshold_mode, r.effective_threshold, r.observed_value) for r in investigate.evidence_fields(table).collect()}
    assert found == {"ALT-1": ("per-asset", 6.0, 9.0), "ALT-2": ("global", None, None), "ALT-3": ("global", None, None)}
    assert {tuple(r) for r in investigate.threshold_modes(table).collect()} == {("per-asset", 1), ("global", 2)}


def test_investigation(events, alert_rows, config):
    alerts = alert_rows([(0, "10.0.0.1", "Port scan"), (10, "10.0.0.1", "Host scan"), (0, "b", "Port scan")])
    incidents = correlate_alerts(alerts, config)
    logs = events([(-1, {}), (0, {"dst_port": 80}), (300, {}), (600, {"action": "ALLOW", "dst_ip": "z"}), (601, {}), (0, {"src_ip": "c"})])
    related = investigate.incident_events(logs, incidents).orderBy("timestamp").collect()
    assert [(r.incident_id, (r.timestamp - START).total_seconds()) for r in related] == [("INC-000001", 0), ("INC-000001", 300), ("INC-000001", 600)]
    timeline = [tuple(r)[1:] for r in investigate.incident_timeline(logs, alerts, incidents).collect() if r.incident_id == "INC-000001"]
    assert timeline == [
        (START, "First related event", "BLOCK TCP to 192.0.2.1:80"),
        (START, "Port scan threshold reached", "3 event(s), score +25"),
        (START + timedelta(minutes=10), "Host scan threshold reached", "3 event(s), score +25"),
        (START + timedelta(minutes=10), "Last related event", "ALLOW TCP to z:22"),
    ]
    assert investigate.incident_by_id(incidents, "INC-000002").first().src_ip == "b"
    assert investigate.incident_labels(incidents).first().label == "INC-000001 | High | risk 60 | 10.0.0.1"
    assert investigate.incident_view(incidents).first().incident_id == "INC-000001"


def test_report_tables(spark, alert_rows, config):
    incidents = correlate_alerts(alert_rows([(0, "a", "Port scan"), (5, "a", "Host scan"), (0, "b", "Port scan")]), config)
    lines = report_tables.incident_cards(incidents).collect()
    assert [r.incident_rank for r in lines] == [1] * 18 + [2] * 15
    assert lines[0].line == "INC-000001 - High - Risk 60/100"
    assert lines[2].line == "Window: 2026-07-01 09:00:00 to 2026-07-01 09:05:00"
    assert lines[9].line == "Host scan: +20; Port scan: +25; Multiple alert types bonus: +15; Final score: 60"
    assert lines[11].line == "- Investigate why the source contacted many systems."
    assert report_tables.top_incidents(incidents, 1).first().incident_id == "INC-000001"
    summary = spark.createDataFrame([(5, 4, 1, 0, 0, 0)], ", ".join(f"{n} bigint" for n in report_tables.SUMMARY_LABELS))
    assert [tuple(r)[1:] for r in report_tables.cleaning_table(summary).collect()][:2] == [("Original rows", 5), ("Final rows", 4)]
    row = spark.range(1).select(report_tables.report_summary_lines(F.lit(12345), F.lit(2), F.lit(1), F.lit(60)).alias("l")).first()
    assert row.l == ["- Log events: 12,345", "- Alerts: 2", "- Incidents: 1", "- Highest risk score: 60"]


def test_extremes_from_hours_equal_all_related_events(spark, events):
    """First and last events of incidents that begin, end and lie inside hours, with ties in time."""
    import random

    rng = random.Random(4)
    logs = events([(rng.randrange(6 * 3600), {"src_ip": rng.choice("ab"), "dst_port": rng.randrange(9)}) for _ in range(400)])
    spans = [(f"INC-{i:06d}", rng.choice("abc"), *sorted(rng.sample(range(6 * 3600), 2))) for i in range(40)]
    rows = [(name, source, START + timedelta(seconds=low), START + timedelta(seconds=high)) for name, source, low, high in spans]
    incidents = spark.createDataFrame(rows, "incident_id string, src_ip string, start_time timestamp_ntz, end_time timestamp_ntz")
    found = {r.incident_id: (r.first.row_id, r.last.row_id) for r in investigate.incident_extremes(logs, incidents).collect()}
    related = {}
    for r in investigate.incident_events(logs, incidents).collect():
        related.setdefault(r.incident_id, []).append((r.timestamp, r.row_id))
    assert found == {name: (min(rows)[1], max(rows)[1]) for name, rows in related.items()} and len(found) > 20
