"""The five rule detectors and their union."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Callable, Iterable

from pyspark.sql import Column, DataFrame, Observation, functions as F

from fwlens.config import ALERT_SECTIONS, Config
from fwlens.functions.columns import hour_in
from fwlens.functions.scoring import severity_of
from fwlens.operators.baseline import ThresholdRule, compute_baseline
from fwlens.operators.quantiles import quantiles
from fwlens.operators.windows import (
    MINUTE_US, combined_rows, first_count_window, first_distinct_window, numbered, rows_of_windows, with_time,
)
from fwlens.session import checkpointed, concurrently, settled, written

BURST, PORT_SCAN, HOST_SCAN, LARGE, OFF_HOURS = ALERT_SECTIONS

# Ports whose use off hours is suspicious, and the nominal window of that detector.
RARE_PORTS = (23, 445, 1433, 3306, 3389, 5900)
OFF_HOURS_WINDOW = 5
SAMPLE = 50

REQUIREMENTS = {
    BURST: {"timestamp", "src_ip", "dst_ip", "dst_port", "action"},
    PORT_SCAN: {"timestamp", "src_ip", "dst_ip", "dst_port"},
    HOST_SCAN: {"timestamp", "src_ip", "dst_ip", "dst_port"},
    LARGE: {"timestamp", "src_ip", "dst_ip", "dst_port", "bytes_sent"},
    OFF_HOURS: {"timestamp", "src_ip", "dst_ip", "dst_port", "action", "bytes_sent"},
}

# Evidence is one typed struct over all detectors; JSON text is made at the sink and leaves NULL fields out.
EVIDENCE = {
    "asset_baseline_value": "double",
    "blocked_connections": "bigint",
    "blocked_events": "bigint",
    "bytes_sent": "bigint",
    "destinations_sample": "array<string>",
    "effective_threshold": "bigint",
    "interpretation": "string",
    "large_transfer_events": "bigint",
    "observed_value": "bigint",
    "off_hours_window": "string",
    "ports_sample": "array<int>",
    "rare_ports": "array<int>",
    "target_ports": "array<int>",
    "threshold": "bigint",
    "threshold_source": "string",
    "unique_destination_ports": "bigint",
    "unique_destinations": "bigint",
}

ALERT_COLUMNS = (
    "alert_id", "timestamp", "src_ip", "dst_ip", "alert_type", "severity", "event_count", "window_minutes", "evidence",
    "score_contribution", "first_seen", "last_seen", "affected_destinations", "affected_ports",
)

Settle = Callable[[DataFrame], DataFrame]


def _as_is(df: DataFrame) -> DataFrame:
    return df


def _evidence(**given: str) -> str:
    """SQL text of the evidence struct; fields that are not given are NULL."""
    fields = ", ".join(f"'{name}', cast({given.get(name, 'NULL')} AS {kind})" for name, kind in EVIDENCE.items())
    return f"named_struct({fields}) AS evidence"


def _threshold_evidence(observed: str) -> dict[str, str]:
    return {
        "threshold_source": "threshold_source",
        "effective_threshold": "threshold",
        "observed_value": observed,
        "asset_baseline_value": "bround(asset_baseline_value, 2)",
    }


SEVERAL = "CASE WHEN size(destinations) > 1 THEN 'multiple' ELSE try_element_at(destinations, 1) END"


def _alerts(df: DataFrame, kind: str, window_minutes: int, evidence: str, config: Config, dst_ip: str = SEVERAL) -> DataFrame:
    """Common alert columns from src_ip, timestamp, event_count, first_seen, last_seen, destinations and ports."""
    score = config.alert_scores()[kind]
    return df.selectExpr(
        f"{list(ALERT_SECTIONS).index(kind)} AS detector",
        "timestamp",
        "src_ip",
        f"{dst_ip} AS dst_ip",
        f"'{kind}' AS alert_type",
        "cast(event_count AS bigint) AS event_count",
        f"{window_minutes} AS window_minutes",
        evidence,
        f"{score} AS score_contribution",
        "first_seen",
        "last_seen",
        "destinations",
        "ports",
    ).withColumn("severity", severity_of(F.col("score_contribution"), config))


# per source, from rows combined per (destination, port)
SETS = (
    "array_sort(collect_set(dst_ip)) AS destinations",
    "array_sort(collect_set(dst_port)) AS ports",
)


def _window_alert_rows(window_rows: DataFrame, value: str | None = None) -> DataFrame:
    """One row per source from the rows of its trigger window."""
    pairs = combined_rows(window_rows, ["dst_ip", "dst_port"], value)
    per_source = ["src_ip", "trigger_us", "threshold", "threshold_source", "asset_baseline_value"]
    found = pairs.groupBy(*per_source).agg(
        *map(F.expr, ("sum(n) AS event_count", "min(first_us) AS first_us", "max(last_us) AS last_us", *SETS))
    )
    naive = "cast(timestamp_micros({0}) AS timestamp_ntz) AS {1}"
    return found.selectExpr(
        *per_source, "event_count", "destinations", "ports", naive.format("trigger_us", "timestamp"),
        naive.format("first_us", "first_seen"), naive.format("last_us", "last_seen"),
    )


def _timed(logs: DataFrame, window_us: int) -> DataFrame:
    known = logs.filter("src_ip IS NOT NULL AND timestamp IS NOT NULL")
    return with_time(known.select("timestamp", "src_ip", "dst_ip", "dst_port", "row_id"), window_us).drop("timestamp")


def _burst_rows(config: Config) -> str:
    return f"action = 'BLOCK' AND dst_port IN ({', '.join(map(str, config.brute_force.destination_ports))})"


def detect_blocked_burst(
    logs: DataFrame, config: Config, baselines: DataFrame | None = None, settle: Settle = _as_is
) -> DataFrame:
    """First time per source with enough blocked connections to the sensitive ports inside the window."""
    cfg = config.brute_force
    window_us = cfg.window_minutes * MINUTE_US
    rows = _timed(logs.filter(_burst_rows(config)), window_us)
    rule = ThresholdRule("blocked_rate", cfg.blocked_attempts, config, baselines)
    hits = settle(first_count_window(rows, window_us, rule))
    found = _window_alert_rows(rows_of_windows(rows, hits, window_us, closed_left=False))
    evidence = _evidence(
        blocked_connections="event_count",
        target_ports="ports",
        interpretation="'Possible brute-force or automated connection attempts'",
        **_threshold_evidence("event_count"),
    )
    return _alerts(found, BURST, cfg.window_minutes, evidence, config)


def _scan_rows(logs: DataFrame, value: str, minutes: int, rule: ThresholdRule, settle: Settle) -> DataFrame:
    window_us = minutes * MINUTE_US
    rows = _timed(logs, window_us)
    hits = settle(first_distinct_window(rows, value, window_us, rule))
    window_rows = rows_of_windows(rows, hits, window_us, closed_left=True)
    return _window_alert_rows(window_rows, value)


def detect_port_scan(
    logs: DataFrame, config: Config, baselines: DataFrame | None = None, settle: Settle = _as_is
) -> DataFrame:
    """First time per source with enough distinct destination ports inside the window."""
    rule = ThresholdRule("unique_ports", config.port_scan.unique_ports, config, baselines)
    return _port_scan_alerts(_scan_rows(logs, "dst_port", config.port_scan.window_minutes, rule, settle), config)


def _port_scan_alerts(found: DataFrame, config: Config) -> DataFrame:
    evidence = _evidence(
        unique_destination_ports="size(ports)",
        ports_sample=f"slice(ports, 1, {SAMPLE})",
        **_threshold_evidence("size(ports)"),
    )
    return _alerts(found, PORT_SCAN, config.port_scan.window_minutes, evidence, config)


def detect_host_scan(
    logs: DataFrame, config: Config, baselines: DataFrame | None = None, settle: Settle = _as_is
) -> DataFrame:
    """First time per source with enough distinct destination addresses inside the window."""
    rule = ThresholdRule("unique_dsts", config.host_scan.unique_destinations, config, baselines)
    return _host_scan_alerts(_scan_rows(logs, "dst_ip", config.host_scan.window_minutes, rule, settle), config)


def _host_scan_alerts(found: DataFrame, config: Config) -> DataFrame:
    evidence = _evidence(
        unique_destinations="size(destinations)",
        destinations_sample=f"slice(destinations, 1, {SAMPLE})",
        **_threshold_evidence("size(destinations)"),
    )
    return _alerts(found, HOST_SCAN, config.host_scan.window_minutes, evidence, config, "'multiple'")


def detect_scans(logs: DataFrame, config: Config, baselines: DataFrame | None = None, settle: Settle = _as_is) -> DataFrame:
    """Port and host scans over windows of one length, from two scans of the log.

    One rollup per (source, slot, destination, port) with first and last time serves both searches; the rows of all trigger
    windows are fetched at once and kept.
    """
    window_us = config.port_scan.window_minutes * MINUTE_US
    rows = _timed(logs, window_us)
    rollup = rows.groupBy("src_ip", "slot", "dst_ip", "dst_port").agg(F.expr("min(us) AS first_us"), F.expr("max(us) AS last_us"))
    rollup = checkpointed(rollup)
    searches = {
        PORT_SCAN: ("dst_port", ThresholdRule("unique_ports", config.port_scan.unique_ports, config, baselines)),
        HOST_SCAN: ("dst_ip", ThresholdRule("unique_dsts", config.host_scan.unique_destinations, config, baselines)),
    }
    hits = [
        first_distinct_window(rollup, value, window_us, rule).withColumn("kind", F.lit(kind)) for kind, (value, rule) in searches.items()
    ]
    window_rows = checkpointed(rows_of_windows(rows, settle(hits[0].unionByName(hits[1])), window_us, closed_left=True))
    found = {
        kind: _window_alert_rows(window_rows.filter(F.col("kind") == kind).drop("kind"), value) for kind, (value, _) in searches.items()
    }
    return _port_scan_alerts(found[PORT_SCAN], config).unionByName(_host_scan_alerts(found[HOST_SCAN], config))


def suspicious_rows(logs: DataFrame, config: Config, kinds: Iterable[str], baselines: DataFrame | None) -> tuple[DataFrame, float | None]:
    """What the burst, transfer and off-hours detectors look at, kept from one scan of the log, and the byte threshold.

    What the quantile needs of the transfers below the minimum, their number and the largest, is observed on the way; a
    task that runs again counts once, since the rows are written without an exchange.
    """
    kinds, parts, columns = set(kinds), [], ["timestamp", "src_ip", "dst_ip", "dst_port", "row_id"]
    minimum = config.large_transfer.minimum_bytes
    columns += [name for name in ("action", "bytes_sent") if name in logs.columns]
    if BURST in kinds:
        parts.append(_burst_rows(config))
    if LARGE in kinds:
        parts.append(f"bytes_sent >= {_lowest_transfer(config, baselines)}")
    picked = logs.select(*columns)
    if OFF_HOURS in kinds:
        picked = picked.withColumn("off", hour_in(F.col("timestamp"), config.off_hours.start_hour, config.off_hours.end_hour))
        rare = f"dst_port IN ({', '.join(map(str, RARE_PORTS))})"
        parts.append(f"off AND (action = 'BLOCK' OR {rare} OR bytes_sent >= {minimum})")
    counts = Observation()
    if LARGE in kinds:
        below = f"CASE WHEN bytes_sent < {minimum} THEN bytes_sent END"
        picked = picked.observe(counts, F.expr(f"count({below}) AS n"), F.expr(f"max({below}) AS largest"))
    kept = written(picked.filter(" OR ".join(f"({part})" for part in parts)).select(*columns))
    if LARGE not in kinds:
        return kept, None
    seen = counts.get
    return kept, large_threshold(kept, config, (seen["n"], seen["largest"])).first()["threshold"]


def large_threshold(logs: DataFrame, config: Config, below: tuple[int, int | None] | None = None) -> DataFrame:
    """One row: the larger of the byte minimum and the exact quantile of bytes_sent.

    Values under the minimum matter only through their number and their largest one, so they travel as one group; where
    both are known as ``below``, ``logs`` need not hold those rows.
    """
    cfg = config.large_transfer
    if below is not None:
        logs = logs.filter(f"bytes_sent >= {cfg.minimum_bytes}")
    hist = (
        logs.filter("bytes_sent IS NOT NULL")
        .selectExpr("bytes_sent", f"CASE WHEN bytes_sent < {cfg.minimum_bytes} THEN -1 ELSE bytes_sent END AS size_group")
        .groupBy("size_group")
        .agg(F.expr("max(bytes_sent) AS size"), F.expr("count(1) AS n"))
        .selectExpr("'all' AS scope", "cast(size AS double) AS value", "n")
    )
    if below is not None and below[0]:
        low = logs.sparkSession.createDataFrame([("all", float(below[1]), below[0])], "scope string, value double, n bigint")
        hist = hist.unionByName(low)
    at = quantiles(hist, ["scope"], [cfg.percentile])
    return at.agg(F.expr(f"greatest(max(quantile), {float(cfg.minimum_bytes)!r}D) AS threshold"))


def _lowest_transfer(config: Config, baselines: DataFrame | None) -> int:
    """A constant lower bound of every possible threshold, which reaches the scan."""
    lowest = config.large_transfer.minimum_bytes
    return lowest if baselines is None else min(lowest, config.baselining.min_threshold_floor)


def _limit(logs: DataFrame, config: Config, threshold: float | None) -> Column:
    """The byte threshold as a known number, or as a one-row subquery."""
    return large_threshold(logs, config).scalar() if threshold is None else F.lit(float(threshold))


def detect_large_transfer(
    logs: DataFrame, config: Config, baselines: DataFrame | None = None, threshold: float | None = None
) -> DataFrame:
    """One alert per transfer at or above the threshold; transfers equal on time, source and target merge."""
    cfg = config.large_transfer
    rule = ThresholdRule("bytes_sent", _limit(logs, config, threshold), config, baselines, whole=False)
    rows = logs.filter(f"bytes_sent >= {_lowest_transfer(config, baselines)}").select("timestamp", "src_ip", "dst_ip", "dst_port", "bytes_sent", "row_id")
    large = rule.attach(rows).filter("bytes_sent >= threshold")
    details = "struct(dst_port, bytes_sent, threshold, threshold_source, asset_baseline_value)"
    kept = large.groupBy("timestamp", "src_ip", "dst_ip").agg(F.expr(f"min_by({details}, row_id) AS row"))
    found = kept.selectExpr(
        "timestamp", "src_ip", "dst_ip", "row.*", "1 AS event_count", "timestamp AS first_seen", "timestamp AS last_seen",
        "array(dst_ip) AS destinations", "array(row.dst_port) AS ports",
    )
    evidence = _evidence(
        bytes_sent="bytes_sent",
        threshold="threshold",
        interpretation="'Unusually large outbound data transfer requiring investigation'",
        **_threshold_evidence("bytes_sent"),
    )
    return _alerts(found, LARGE, 0, evidence, config, "dst_ip")


def detect_off_hours(logs: DataFrame, config: Config, threshold: float | None = None) -> DataFrame:
    """One alert per source that was blocked, moved much data or used a rare port during off hours."""
    cfg = config.off_hours
    rare = f"IN ({', '.join(map(str, RARE_PORTS))})"
    inside = logs.filter(hour_in(F.col("timestamp"), cfg.start_hour, cfg.end_hour))
    marked = inside.withColumn("is_large", F.col("bytes_sent") >= F.floor(_limit(logs, config, threshold)))
    pairs = (
        marked.filter(f"action = 'BLOCK' OR is_large OR dst_port {rare}")
        .groupBy("src_ip", "dst_ip", "dst_port")
        .agg(
            F.expr("count(1) AS n"), F.expr("count_if(action = 'BLOCK') AS blocked"), F.expr("count_if(is_large) AS large"),
            F.expr("min(timestamp) AS first"), F.expr("max(timestamp) AS last"),
        )
    )
    totals = (
        "sum(n) AS event_count", "sum(blocked) AS blocked", "sum(large) AS large", "min(first) AS timestamp",
        "min(first) AS first_seen", "max(last) AS last_seen", *SETS,
    )
    evidence = _evidence(
        off_hours_window=f"'{cfg.start_hour:02d}:00-{cfg.end_hour:02d}:00'",
        blocked_events="blocked",
        rare_ports=f"filter(ports, p -> p {rare})",
        large_transfer_events="large",
    )
    return _alerts(pairs.groupBy("src_ip").agg(*map(F.expr, totals)), OFF_HOURS, OFF_HOURS_WINDOW, evidence, config)


@dataclass(frozen=True)
class AlertRun:
    """Numbered alerts, the stored alerts they number (all that correlation needs), and the detectors left out."""

    alerts: DataFrame
    skipped: tuple[str, ...]
    stored: DataFrame


def skipped_detectors(available: Iterable[str]) -> tuple[str, ...]:
    present = set(available)
    return tuple(kind for kind, needed in REQUIREMENTS.items() if not needed <= present)


def run_all_detectors(
    logs: DataFrame,
    config: Config,
    available: Iterable[str] | None = None,
    baselines: DataFrame | None = None,
    settle: Settle = settled,
) -> AlertRun:
    """Every detector whose columns the source supplied, united and numbered by time.

    The log is scanned three times: for the rows that burst, transfer and off-hours detectors share, for the rollup of both
    scan detectors (if their windows are equally long), and for the rows of their trigger windows.
    The union is materialised once, because numbering reads it twice. ``baselines`` may come from a separate
    history; with baselining enabled and none given, they are computed from ``logs``.
    """
    skipped = skipped_detectors(logs.columns if available is None else available)
    if not config.baselining.enabled:
        baselines = None
    elif baselines is None:
        baselines = settle(compute_baseline(logs, config))
    wanted = [kind for kind in ALERT_SECTIONS if kind not in skipped]
    if not wanted:
        none = _no_alerts(logs, config)
        return AlertRun(none, skipped, none)
    scans = [kind for kind in (PORT_SCAN, HOST_SCAN) if kind in wanted]
    others = [kind for kind in wanted if kind not in scans]

    def scanned() -> list[DataFrame]:
        if len(scans) == 2 and config.port_scan.window_minutes == config.host_scan.window_minutes:
            return [detect_scans(logs, config, baselines, settle)]
        of = {PORT_SCAN: detect_port_scan, HOST_SCAN: detect_host_scan}
        return [of[kind](logs, config, baselines, settle) for kind in scans]

    def picked() -> list[DataFrame]:
        if not others:
            return []
        rows, limit = suspicious_rows(logs, config, others, baselines)
        runs = {
            BURST: lambda: detect_blocked_burst(rows, config, baselines, settle),
            LARGE: lambda: detect_large_transfer(rows, config, baselines, limit),
            OFF_HOURS: lambda: detect_off_hours(rows, config, limit),
        }
        return concurrently(logs.sparkSession, [runs[kind] for kind in others])

    # both parts are independent of each other: their jobs share the cluster instead of queueing
    parts = concurrently(logs.sparkSession, [scanned, picked])
    stored = checkpointed(reduce(DataFrame.unionByName, [part for found in parts for part in found]))
    return AlertRun(number_alerts(stored), skipped, stored)


def number_alerts(alerts: DataFrame) -> DataFrame:
    """Adds ``alert_id`` by (time, detector, source, target)."""
    placed = numbered(alerts, ("timestamp", "detector", "src_ip", "dst_ip"), "place")
    return placed.selectExpr("format_string('ALT-%06d', place) AS alert_id", *alerts.columns)


def _no_alerts(logs: DataFrame, config: Config) -> DataFrame:
    """The alert schema without rows."""
    empty = logs.sparkSession.createDataFrame(
        [],
        "timestamp timestamp_ntz, src_ip string, event_count bigint, first_seen timestamp_ntz, last_seen timestamp_ntz,"
        " destinations array<string>, ports array<int>",
    )
    return _alerts(empty, BURST, 0, _evidence(), config).selectExpr("'' AS alert_id", "*")


def alerts_table(alerts: DataFrame) -> DataFrame:
    """The 14 flat columns of an exported alert: evidence as JSON, sets as joined text."""
    ports = F.array_join(F.transform("ports", lambda port: port.cast("string")), ", ")
    return alerts.withColumns(
        {
            "evidence": F.to_json("evidence"),
            "affected_destinations": F.array_join("destinations", ", "),
            "affected_ports": ports,
        }
    ).select(*ALERT_COLUMNS)
