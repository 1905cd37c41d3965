"""Shared session and small tables."""

from __future__ import annotations

import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from fwlens.config import BlockedBurst, Config, HostScan, PortScan  # noqa: E402
from fwlens.session import build_session  # noqa: E402

START = datetime(2026, 7, 1, 9, 0, 0)
EVENT_SCHEMA = (
    "timestamp timestamp_ntz, src_ip string, dst_ip string, src_port int, dst_port int, protocol string, action string,"
    " bytes_sent bigint, bytes_received bigint, row_id bigint"
)
ALERT_SCHEMA = (
    "alert_id string, timestamp timestamp_ntz, src_ip string, dst_ip string, alert_type string, severity string,"
    " event_count bigint, window_minutes int, score_contribution int, first_seen timestamp_ntz, last_seen timestamp_ntz,"
    " destinations array<string>, ports array<int>"
)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "fwlens-tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def config():
    return Config()


@pytest.fixture
def events(spark):
    """Rows of (second offset, overrides) as a canonical log."""

    def build(rows):
        data = []
        for place, (seconds, change) in enumerate(rows):
            row = {
                "timestamp": START + timedelta(seconds=seconds), "src_ip": "10.0.0.1", "dst_ip": "192.0.2.1",
                "src_port": 50000, "dst_port": 22, "protocol": "TCP", "action": "BLOCK", "bytes_sent": 100,
                "bytes_received": 0, "row_id": place,
            }
            row.update(change)
            data.append(tuple(row.values()))
        return spark.createDataFrame(data, EVENT_SCHEMA)

    return build


@pytest.fixture
def alert_rows(spark):
    """Alerts from (minute offset, source, type) for correlation."""

    def build(rows):
        data = []
        for place, (minutes, src_ip, kind) in enumerate(rows):
            when = START + timedelta(minutes=minutes)
            data.append(
                (f"ALT-{place:06d}", when, src_ip, "multiple", kind, "Low", 3, 5, 25, when, when, ["192.0.2.1"], [1000, 22])
            )
        return spark.createDataFrame(data, ALERT_SCHEMA)

    return build


@pytest.fixture(scope="session")
def small_windows():
    """Low thresholds for hand-made tables."""
    return Config(
        brute_force=BlockedBurst(blocked_attempts=4, window_minutes=1),
        port_scan=PortScan(unique_ports=4, window_minutes=1),
        host_scan=HostScan(unique_destinations=4, window_minutes=1),
    )
