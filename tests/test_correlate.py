import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fwlens.config import Config
from fwlens.operators.correlate import INCIDENT_COLUMNS, alert_anchors, correlate_alerts, incidents_table, with_anchor


def greedy(times, window):
    anchors, current = [], None
    for t in sorted(times):
        if current is None or t > current + window:
            current = t
            anchors.append(t)
    return anchors


@pytest.mark.parametrize("spread", [60, 400, 5000])
def test_anchors_equal_the_greedy_grouping(spark, spread):
    rng = random.Random(spread)
    window = 50
    rows = [(f"s{int(6 * rng.random() ** 2)}", rng.randrange(-spread, spread * 4)) for _ in range(700)]
    groups = defaultdict(list)
    for source, us in rows:
        groups[source].append(us)
    found = defaultdict(list)
    for row in alert_anchors(spark.createDataFrame(rows, "src_ip string, us bigint"), window).collect():
        found[row.src_ip].append(row.anchor)
    assert {s: sorted(a) for s, a in found.items()} == {s: greedy(t, window) for s, t in groups.items()}


def test_many_times_in_one_slot_and_a_long_chain(spark):
    """Thousands of times inside one window, and one session of hundreds of windows without a gap."""
    rng = random.Random(8)
    window = 10_000
    rows = [("hot", 50_000 + rng.randrange(window)) for _ in range(3000)] + [("long", 90 * i + rng.randrange(90)) for i in range(30_000)]
    found = defaultdict(list)
    for row in alert_anchors(spark.createDataFrame(rows, "src_ip string, us bigint"), window).collect():
        found[row.src_ip].append(row.anchor)
    for source in ("hot", "long"):
        assert sorted(found[source]) == greedy([us for s, us in rows if s == source], window)


def test_every_alert_finds_its_anchor(alert_rows):
    rng = random.Random(1)
    rows = [(rng.randrange(600), rng.choice("ab"), "Port scan") for _ in range(150)]
    window = 15 * 60_000_000
    found = with_anchor(alert_rows(rows), window)
    late = found.withColumn("us", F.unix_micros(F.col("timestamp").cast("timestamp"))).filter(
        (F.col("us") < F.col("anchor")) | (F.col("us") > F.col("anchor") + window) | F.col("anchor").isNull()
    )
    assert found.count() == 150 and late.isEmpty()


@pytest.mark.parametrize("rows,counts", [
    ([(0, "a", "Port scan"), (10, "a", "Host scan")], [2]),
    ([(0, "a", "Port scan"), (15, "a", "Host scan")], [2]),
    ([(0, "a", "Port scan"), (20, "a", "Host scan")], [1, 1]),
    ([(0, "a", "Port scan"), (0, "b", "Port scan")], [1, 1]),
    ([(0, "a", "Port scan"), (10, "a", "Port scan"), (20, "a", "Port scan"), (30, "a", "Port scan")], [2, 2]),
])
def test_windows_are_anchored_at_the_first_alert(alert_rows, config, rows, counts):
    incidents = correlate_alerts(alert_rows(rows), config).orderBy("incident_id").collect()
    assert [i.alert_count for i in incidents] == counts


def test_incident_fields(alert_rows, config):
    rows = [(0, "b", "Port scan"), (5, "b", "Host scan"), (0, "a", "Port scan")]
    table = incidents_table(correlate_alerts(alert_rows(rows), config))
    assert tuple(table.columns) == INCIDENT_COLUMNS
    first, second = table.orderBy("incident_id").collect()
    assert (first.incident_id, first.src_ip, second.incident_id, second.src_ip) == ("INC-000001", "a", "INC-000002", "b")
    assert second.alert_types == "Host scan, Port scan" and second.risk_score == 60 and second.severity == "High"
    assert second.affected_ports == "1000, 22" and second.event_count == 6
    assert second.explanation == (
        "The source IP b produced 2 alert(s) involving 6 event(s). Observed alert type(s): Host scan, Port scan. The activity"
        " affected 1 destination value(s). The activity involved 2 destination port value(s). These suspicious behaviors produced"
        " a risk score of 60 out of 100 and require investigation."
    )


def test_no_alerts_no_incidents(alert_rows):
    empty = correlate_alerts(alert_rows([]), Config())
    assert empty.isEmpty() and set(INCIDENT_COLUMNS) <= set(empty.columns)


def test_unknown_targets_and_repeated_values(alert_rows, config):
    rows = alert_rows([(0, "a", "Port scan"), (5, "a", "Port scan")]).withColumn(
        "destinations", F.when(F.col("alert_id") == "ALT-000000", F.expr("array(cast(NULL AS string), 'x')")).otherwise(F.expr("array('x', 'w')"))
    )
    found = correlate_alerts(rows, config).first()
    assert (found.alert_count, found.affected_destinations, found.affected_ports) == (2, "w, x", "1000, 22")
