"""The tables of a written report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fwlens.functions.columns import split_items, timestamp_text
from fwlens.operators.investigate import INCIDENT_VIEW
from fwlens.operators.windows import id_order

SUMMARY_LABELS = {
    "original_row_count": "Original rows",
    "final_row_count": "Final rows",
    "duplicate_rows_removed": "Duplicates removed",
    "invalid_timestamps": "Invalid timestamps",
    "invalid_ip_addresses": "Invalid IP addresses",
    "invalid_ports": "Invalid ports",
}
REPORT_SOURCES = (
    "src_ip", "total_events", "allowed_events", "blocked_events", "blocked_ratio", "bytes_sent_total",
    "bytes_received_total", "unique_dst_ips", "unique_dst_ports", "alert_count",
)
REPORT_PORTS = (
    "dst_port", "service_name", "total_events", "unique_source_ips", "allowed_events", "blocked_events", "blocked_ratio",
    "bytes_sent_total", "bytes_received_total",
)
REPORT_DESTINATIONS = (
    "dst_ip", "total_events", "unique_source_ips", "allowed_events", "blocked_events", "blocked_ratio",
    "bytes_sent_total", "bytes_received_total",
)


def cleaning_table(summary: DataFrame) -> DataFrame:
    """Key/value rows of the cleaning summary."""
    rows = F.array(
        *[
            F.struct(F.lit(place).alias("place"), F.lit(label).alias("item"), F.col(name).alias("value"))
            for place, (name, label) in enumerate(SUMMARY_LABELS.items(), start=1)
        ]
    )
    return summary.select(F.inline(rows)).orderBy("place")


def top_incidents(incidents: DataFrame, k: int = 10) -> DataFrame:
    return incidents.orderBy(F.desc("risk_score"), *id_order("incident_id")).limit(k).select(*INCIDENT_VIEW)


def first_alerts(alerts: DataFrame, k: int = 10) -> DataFrame:
    """The earliest alerts."""
    return alerts.orderBy("timestamp", *id_order("alert_id")).limit(k).select(
        "timestamp", "src_ip", "alert_type", "severity", "event_count", "score_contribution"
    )


def report_sources(top: DataFrame) -> DataFrame:
    return top.select(*REPORT_SOURCES)


def report_ports(top: DataFrame) -> DataFrame:
    return top.select(*REPORT_PORTS)


def report_destinations(top: DataFrame) -> DataFrame:
    return top.select(*REPORT_DESTINATIONS)


def report_summary_lines(logs_events: Column, alerts: Column, incidents: Column, highest: Column) -> Column:
    """Headline lines as an array, from the counters of the KPI row."""
    count = lambda label, c: F.concat(F.lit(f"- {label}: "), F.format_number(c, 0))
    return F.array_compact(
        F.array(
            count("Log events", logs_events),
            count("Alerts", alerts),
            count("Incidents", incidents),
            F.when(incidents > 0, F.concat(F.lit("- Highest risk score: "), highest.cast("string"))),
        )
    )


def incident_cards(incidents: DataFrame, k: int = 5) -> DataFrame:
    """(incident_rank, line_no, line): the riskiest incidents as unwrapped lines of text."""
    line = lambda label, c: F.concat(F.lit(label), F.coalesce(c, F.lit("")))
    header = F.concat_ws(
        " - ", "incident_id", "severity", F.concat(F.lit("Risk "), F.col("risk_score").cast("string"), F.lit("/100"))
    )
    window = F.concat(F.lit("Window: "), timestamp_text(F.col("start_time")), F.lit(" to "), timestamp_text(F.col("end_time")))
    fixed = F.array(
        header,
        line("Source IP: ", F.col("src_ip")),
        window,
        line("Alert types: ", F.col("alert_types")),
        line("Affected destinations: ", F.col("affected_destinations")),
        line("Affected ports: ", F.col("affected_ports")),
        F.lit("Explanation:"),
        F.col("explanation"),
        F.lit("Risk score breakdown:"),
        F.array_join(split_items(F.col("score_breakdown"), "|"), "; "),
        F.lit("Recommendations:"),
    )
    advice = F.transform(split_items(F.col("recommendations"), "|"), lambda item: F.concat(F.lit("- "), item))
    rank = F.row_number().over(Window.orderBy(F.desc("risk_score"), *id_order("incident_id")))
    # the limit leaves at most k rows for the ranking
    top = incidents.orderBy(F.desc("risk_score"), *id_order("incident_id")).limit(k).withColumn("incident_rank", rank)
    lines = top.select("incident_rank", F.posexplode(F.concat(fixed, advice)).alias("line_no", "line"))
    return lines.orderBy("incident_rank", "line_no")
