"""Filters, alert views and incident drill-down."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fwlens.functions.columns import split_items
from fwlens.operators.windows import id_order

EVIDENCE_READ = "threshold_source string, effective_threshold double, observed_value double, asset_baseline_value double"
EVENT_COLUMNS = ("timestamp", "src_ip", "dst_ip", "dst_port", "protocol", "action", "bytes_sent", "bytes_received")
INCIDENT_VIEW = ("incident_id", "src_ip", "start_time", "end_time", "risk_score", "severity", "alert_types", "alert_count")


@dataclass(frozen=True)
class FilterSpec:
    """What an analyst selected; an empty choice selects everything."""

    start: date | None = None
    end: date | None = None
    sources: tuple[str, ...] = ()
    severities: tuple[str, ...] = ()
    alert_types: tuple[str, ...] = ()


def _from(day: date) -> Column:
    return F.lit(datetime(day.year, day.month, day.day)).cast("timestamp_ntz")


def _after(day: date) -> Column:
    return _from(day + timedelta(days=1))


def filter_logs(logs: DataFrame, spec: FilterSpec) -> DataFrame:
    """Half-open time range, so that it reaches the scan."""
    if spec.start:
        logs = logs.filter(F.col("timestamp") >= _from(spec.start))
    if spec.end:
        logs = logs.filter(F.col("timestamp") < _after(spec.end))
    return logs.filter(F.col("src_ip").isin(*spec.sources)) if spec.sources else logs


def filter_alerts(alerts: DataFrame, spec: FilterSpec) -> DataFrame:
    alerts = filter_logs(alerts, spec)
    if spec.severities:
        alerts = alerts.filter(F.col("severity").isin(*spec.severities))
    return alerts.filter(F.col("alert_type").isin(*spec.alert_types)) if spec.alert_types else alerts


def filter_incidents(incidents: DataFrame, spec: FilterSpec) -> DataFrame:
    """Incidents that overlap the dates and hold at least one of the alert types."""
    if spec.end:
        incidents = incidents.filter(F.col("start_time") < _after(spec.end))
    if spec.start:
        incidents = incidents.filter(F.col("end_time") >= _from(spec.start))
    if spec.sources:
        incidents = incidents.filter(F.col("src_ip").isin(*spec.sources))
    if spec.severities:
        incidents = incidents.filter(F.col("severity").isin(*spec.severities))
    if spec.alert_types:
        held = [F.coalesce(F.col("alert_types"), F.lit("")).contains(kind) for kind in spec.alert_types]
        incidents = incidents.filter(reduce(lambda left, right: left | right, held))
    return incidents


def filter_views(
    logs: DataFrame, alerts: DataFrame, incidents: DataFrame, spec: FilterSpec
) -> tuple[DataFrame, DataFrame, DataFrame]:
    return filter_logs(logs, spec), filter_alerts(alerts, spec), filter_incidents(incidents, spec)


def search(table: DataFrame, pattern: str) -> DataFrame:
    """Rows in which any column's text matches the pattern, ignoring case."""
    if not pattern:
        return table
    hits = [F.coalesce(F.col(name).cast("string").rlike(f"(?i){pattern}"), F.lit(False)) for name in table.columns]
    return table.filter(reduce(lambda left, right: left | right, hits))


def _threshold_fields(table: DataFrame) -> DataFrame:
    """Evidence as a struct column ``ev``, from JSON text or as it is."""
    is_text = dict(table.dtypes)["evidence"] == "string"
    return table.withColumn("ev", F.from_json("evidence", EVIDENCE_READ) if is_text else F.col("evidence"))


def evidence_fields(table: DataFrame) -> DataFrame:
    """Adds threshold_mode, effective_threshold, observed_value; unreadable evidence counts as global."""
    mode = F.when(F.col("ev.threshold_source") == "per_asset_baseline", "per-asset").otherwise("global")
    return _threshold_fields(table).withColumns(
        {
            "threshold_mode": mode,
            "effective_threshold": F.col("ev.effective_threshold").cast("double"),
            "observed_value": F.col("ev.observed_value").cast("double"),
        }
    ).drop("ev")


def threshold_modes(table: DataFrame) -> DataFrame:
    return evidence_fields(table).groupBy("threshold_mode").agg(F.count(F.lit(1)).alias("alerts"))


def alert_view(table: DataFrame) -> DataFrame:
    return evidence_fields(table).select(
        "timestamp", "src_ip", "alert_type", "severity", "threshold_mode", "effective_threshold", "observed_value",
        "event_count", "score_contribution",
    )


def incident_view(incidents: DataFrame) -> DataFrame:
    return incidents.select(*INCIDENT_VIEW).orderBy(F.desc("risk_score"), *id_order("incident_id"))


def incident_by_id(incidents: DataFrame, incident_id: str) -> DataFrame:
    return incidents.filter(F.col("incident_id") == incident_id)


def incident_labels(incidents: DataFrame) -> DataFrame:
    label = F.concat_ws(
        " | ", "incident_id", "severity", F.concat(F.lit("risk "), F.col("risk_score").cast("string")), "src_ip"
    )
    return incidents.orderBy(F.desc("risk_score"), *id_order("incident_id")).select(label.alias("label"))


def recommendation_items(incidents: DataFrame) -> DataFrame:
    """One row per recommendation of an incident, in order."""
    items = split_items(F.col("recommendations"), "|")
    return incidents.select("incident_id", F.posexplode(items).alias("place", "recommendation"))


def _hours(incidents: DataFrame) -> DataFrame:
    """Incident intervals cut into hours: an equi-join key that spreads a busy source over time."""
    low, high = (F.date_trunc("hour", c).cast("timestamp_ntz") for c in ("start_time", "end_time"))
    return incidents.select(
        "incident_id", "src_ip", "start_time", "end_time",
        F.explode(F.sequence(low, high, F.expr("INTERVAL 1 HOUR"))).alias("hour"),
    )


def _related(rows: DataFrame, incidents: DataFrame) -> DataFrame:
    """Rows of the incident's source inside its interval, both ends included."""
    hour = F.date_trunc("hour", F.col("timestamp")).cast("timestamp_ntz")
    return (
        rows.withColumn("hour", hour)
        .join(_hours(incidents), ["src_ip", "hour"])
        .filter(F.col("timestamp").between(F.col("start_time"), F.col("end_time")))
        .drop("hour", "start_time", "end_time")
    )


def incident_alerts(alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    return _related(alerts, incidents)


def incident_events(logs: DataFrame, incidents: DataFrame) -> DataFrame:
    related = _related(logs.select(*EVENT_COLUMNS, "row_id"), incidents)
    return related.select("incident_id", *EVENT_COLUMNS, "row_id")


def incident_extremes(logs: DataFrame, incidents: DataFrame) -> DataFrame:
    """incident_id, first, last: the first and last related event of every incident.

    The log is rolled up to the first and last event of each (source, hour) once. Hours inside an incident are answered
    by that table; single rows are joined only for the two hours at an incident's ends.
    """
    known = logs.select(*EVENT_COLUMNS, "row_id").withColumn("hour", F.date_trunc("hour", F.col("timestamp")).cast("timestamp_ntz"))
    place, details = F.struct("timestamp", "row_id"), F.struct("timestamp", "action", "protocol", "dst_ip", "dst_port", "row_id")
    hourly = known.groupBy("src_ip", "hour").agg(F.min_by(details, place).alias("first"), F.max_by(details, place).alias("last"))
    cut = _hours(incidents).withColumn(
        "at_end", F.col("hour").isin(F.date_trunc("hour", "start_time").cast("timestamp_ntz"), F.date_trunc("hour", "end_time").cast("timestamp_ntz"))
    )
    inside = cut.where("NOT at_end").join(hourly, ["src_ip", "hour"]).select("incident_id", "first", "last")
    edges = (
        known.join(cut.where("at_end"), ["src_ip", "hour"])
        .where(F.col("timestamp").between(F.col("start_time"), F.col("end_time")))
        .groupBy("incident_id").agg(F.min_by(details, place).alias("first"), F.max_by(details, place).alias("last"))
    )
    earliest, latest = F.struct("first.timestamp", "first.row_id"), F.struct("last.timestamp", "last.row_id")
    return inside.unionByName(edges).groupBy("incident_id").agg(
        F.min_by("first", earliest).alias("first"), F.max_by("last", latest).alias("last")
    )


def incident_timeline(logs: DataFrame, alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    """First related event, related alerts and last related event of every incident, by time."""
    ends = incident_extremes(logs, incidents)
    entries = F.array(
        F.struct(F.lit(0).alias("step"), F.lit("First related event").alias("activity"), F.col("first").alias("e")),
        F.struct(F.lit(2).alias("step"), F.lit("Last related event").alias("activity"), F.col("last").alias("e")),
    )
    event = lambda name: F.coalesce(F.col(f"e.{name}").cast("string"), F.lit(""))
    event_rows = ends.select("incident_id", F.inline(entries)).select(
        "incident_id",
        F.col("e.timestamp").alias("time"),
        "activity",
        F.concat(event("action"), F.lit(" "), event("protocol"), F.lit(" to "), event("dst_ip"), F.lit(":"), event("dst_port"))
        .alias("details"),
        "step",
    )
    alert_rows = incident_alerts(alerts, incidents).select(
        "incident_id",
        F.col("timestamp").alias("time"),
        F.concat(F.col("alert_type"), F.lit(" threshold reached")).alias("activity"),
        F.format_string("%d event(s), score +%d", F.col("event_count"), F.col("score_contribution")).alias("details"),
        F.lit(1).alias("step"),
    )
    return (
        event_rows.unionByName(alert_rows)
        .orderBy(*id_order("incident_id"), "time", "step", "activity")
        .select("incident_id", "time", "activity", "details")
    )
