import json
import random
from dataclasses import replace

import pytest

from fwlens.config import Config, OffHours
from fwlens.operators import detect
from fwlens.operators.baseline import compute_baseline
from tests.conftest import START


@pytest.mark.parametrize("n,step,fires", [(49, 1, False), (50, 1, True), (50, 2, False)])
def test_blocked_burst_boundary(events, config, n, step, fires):
    alerts = detect.detect_blocked_burst(events([(i * step, {}) for i in range(n)]), config).collect()
    assert len(alerts) == fires
    if fires:
        alert = alerts[0]
        assert alert.alert_type == "Repeated blocked connections" and alert.event_count == 50 and alert.severity == "Medium"
        assert alert.dst_ip == "192.0.2.1" and alert.ports == [22] and alert.first_seen == START
        assert alert.evidence.blocked_connections == 50 and alert.evidence.threshold_source == "global_config"


def test_other_ports_and_allowed_rows_do_not_count(events, config):
    rows = [(i, {"dst_port": 80}) for i in range(60)] + [(i, {"action": "ALLOW"}) for i in range(60)]
    assert detect.detect_blocked_burst(events(rows), config).isEmpty()


@pytest.mark.parametrize("n,fires", [(19, False), (20, True)])
def test_port_scan_boundary(events, config, n, fires):
    alerts = detect.detect_port_scan(events([(i, {"dst_port": 1000 + i, "action": "ALLOW"}) for i in range(n)]), config).collect()
    assert len(alerts) == fires
    if fires:
        assert alerts[0].evidence.unique_destination_ports == 20 and alerts[0].evidence.ports_sample[0] == 1000


@pytest.mark.parametrize("n,fires", [(29, False), (30, True)])
def test_host_scan_boundary(events, config, n, fires):
    alerts = detect.detect_host_scan(events([(i, {"dst_ip": f"192.0.2.{i}"}) for i in range(n)]), config).collect()
    assert len(alerts) == fires
    if fires:
        assert alerts[0].dst_ip == "multiple" and alerts[0].evidence.unique_destinations == 30


def test_only_rows_up_to_the_trigger_count_among_ties(events, small_windows):
    rows = [(0, {"dst_port": 1}), (5, {"dst_port": 2}), (5, {"dst_port": 3}), (5, {"dst_port": 3}), (5, {"dst_port": 4}),
            (5, {"dst_port": 5}), (5, {"dst_port": 1})]
    alert = detect.detect_port_scan(events(rows), small_windows).first()
    assert alert.event_count == 5 and alert.ports == [1, 2, 3, 4]


def test_large_transfer_at_the_threshold_and_merging(events, config):
    rows = [(i, {"bytes_sent": 10}) for i in range(500)]
    rows += [(600, {"bytes_sent": 10_000_000}), (600, {"bytes_sent": 20_000_000, "dst_port": 443}), (601, {"bytes_sent": 9_999_999})]
    alerts = detect.detect_large_transfer(events(rows), config).collect()
    # equal time, source and target: the row with the lower id stays
    assert [(a.event_count, a.evidence.bytes_sent, a.ports, a.window_minutes) for a in alerts] == [(1, 10_000_000, [22], 0)]


def test_large_threshold_uses_the_quantile_above_the_minimum(events, config):
    logs = events([(i, {"bytes_sent": 10_000_000 + i * 1000}) for i in range(101)])
    assert detect.large_threshold(logs, config).first()["threshold"] == pytest.approx(10_099_000.0)
    below = events([(i, {"bytes_sent": i}) for i in range(101)])
    assert detect.large_threshold(below, config).first()["threshold"] == 10_000_000.0
    straddle = events([(0, {"bytes_sent": 9_000_000})] * 100 + [(1, {"bytes_sent": 30_000_000})])
    half = replace(config, large_transfer=replace(config.large_transfer, percentile=0.995))
    assert detect.large_threshold(straddle, half).first()["threshold"] == pytest.approx(9_000_000 + 0.5 * 21_000_000)
    assert detect.large_threshold(logs.limit(0), config).first()["threshold"] == 10_000_000.0


@pytest.mark.parametrize("start,end,hours", [(0, 5, {0, 4}), (22, 5, {0, 4, 22, 23}), (9, 9, {0, 4, 5, 9, 12, 22, 23})])
def test_off_hours(events, config, start, end, hours):
    rows = [((h - 9) * 3600, {"src_ip": f"10.0.0.{h}"}) for h in (0, 4, 5, 9, 12, 22, 23)]
    chosen = replace(config, off_hours=OffHours(start, end))
    alerts = detect.detect_off_hours(events(rows), chosen).collect()
    assert {int(a.src_ip.rsplit(".", 1)[1]) for a in alerts} == hours
    assert alerts[0].evidence.off_hours_window == f"{start:02d}:00-{end:02d}:00"


def test_off_hours_needs_another_reason(events, config):
    quiet = {"action": "ALLOW", "dst_port": 443}
    rows = [(-8 * 3600 + i, quiet) for i in range(10)]
    rows += [(-8 * 3600, {"src_ip": "b", "action": "ALLOW", "dst_port": 445}), (-8 * 3600, {**quiet, "src_ip": "c", "bytes_sent": 10**8})]
    alerts = {a.src_ip: a.evidence for a in detect.detect_off_hours(events(rows), config).collect()}
    assert set(alerts) == {"b", "c"}
    assert alerts["b"].rare_ports == [445] and alerts["c"].large_transfer_events == 1 and alerts["c"].blocked_events == 0


def test_all_detectors_are_numbered_by_time(events, small_windows):
    rows = [(i, {"dst_port": 20 + i, "dst_ip": f"192.0.2.{i}"}) for i in range(4)]
    rows += [(100 + i, {"src_ip": "10.0.0.2", "dst_port": 22}) for i in range(4)] + [(50, {"bytes_sent": 10**8, "action": "ALLOW"})]
    run = detect.run_all_detectors(events(rows), small_windows)
    table = detect.alerts_table(run.alerts).orderBy("alert_id").collect()
    assert [(a.alert_id, a.alert_type) for a in table] == [
        ("ALT-000001", "Port scan"), ("ALT-000002", "Host scan"), ("ALT-000003", "Large outbound transfer"),
        ("ALT-000004", "Repeated blocked connections"),
    ]
    assert run.skipped == () and tuple(table[0].asDict()) == detect.ALERT_COLUMNS
    evidence = json.loads(table[0].evidence)
    assert evidence["ports_sample"] == [20, 21, 22, 23] and "asset_baseline_value" not in evidence


def test_missing_columns_skip_detectors(events, small_windows):
    run = detect.run_all_detectors(events([(0, {})]), small_windows, {"timestamp", "src_ip", "action"})
    assert set(run.skipped) == set(detect.REQUIREMENTS) and run.alerts.isEmpty()
    assert tuple(detect.alerts_table(run.alerts).columns) == detect.ALERT_COLUMNS
    some = detect.run_all_detectors(events([(0, {})]), small_windows, {"timestamp", "src_ip", "dst_ip", "dst_port"})
    assert set(some.skipped) == {"Repeated blocked connections", "Large outbound transfer", "Suspicious off-hours activity"}


def test_baselines_make_the_difference(events, config):
    adaptive = replace(config.with_baselining(True), baselining=replace(config.with_baselining(True).baselining, min_history_events=20, deviation_multiplier=2.0))
    history = [(w * 300 + i, {"src_ip": "busy", "dst_port": 1000 + i}) for w in range(15) for i in range(20)]
    history += [(w * 300 + i, {"src_ip": "quiet", "dst_port": 443}) for w in range(15) for i in range(3)]
    scan = [(50_000 + i, {"src_ip": s, "dst_port": 2000 + i}) for s in ("busy", "quiet") for i in range(25)]
    baselines = compute_baseline(events(history), adaptive)
    alerts = detect.detect_port_scan(events(scan), adaptive, baselines).collect()
    assert [(a.src_ip, a.evidence.threshold_source, a.evidence.effective_threshold, a.evidence.asset_baseline_value) for a in alerts] == [
        ("quiet", "per_asset_baseline", 5, 1.0)
    ]
    off = detect.detect_port_scan(events(scan), config).collect()
    assert {a.src_ip for a in off} == {"busy", "quiet"}
    assert all(a.evidence.threshold_source == "global_config" and a.evidence.observed_value == 20 for a in off)


@pytest.mark.parametrize("baselining", [False, True])
@pytest.mark.parametrize("host_minutes", [1, 2])
def test_one_run_equals_its_detectors(spark, events, small_windows, host_minutes, baselining):
    """What detectors share does not change what each of them finds, with ties in time and missing values."""
    rng = random.Random(host_minutes)
    rows = []
    for _ in range(1500):
        rows.append((rng.randrange(7200) - 3600 * 7, {
            "src_ip": rng.choice(["a", "a", "a", "b", "c", None]), "dst_ip": rng.choice([None, *"uvwxyz"]), "dst_port": rng.choice([None, 22, 23, 80, 443, 3306]),
            "action": rng.choice(["BLOCK", "ALLOW"]), "bytes_sent": rng.choice([None, 5, 900, 10_000_000, 10_000_001 + rng.randrange(50)]),
        }))
    logs = events(rows)
    config = replace(small_windows, host_scan=replace(small_windows.host_scan, window_minutes=host_minutes)).with_baselining(baselining)
    history = compute_baseline(logs, config) if baselining else None
    limit = detect.large_threshold(logs, config).first()["threshold"]
    single = [
        detect.detect_blocked_burst(logs, config, history), detect.detect_port_scan(logs, config, history),
        detect.detect_host_scan(logs, config, history), detect.detect_large_transfer(logs, config, history, limit),
        detect.detect_off_hours(logs, config, limit),
    ]
    together = detect.run_all_detectors(logs, config, baselines=history).stored
    plain = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert plain(together) == sorted(row for part in single for row in plain(part)) and len({r.alert_type for r in together.collect()}) >= 3
