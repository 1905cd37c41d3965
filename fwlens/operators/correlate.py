"""Correlation of alerts into incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fwlens.config import Config
from fwlens.functions.columns import joined, micros, slot
from fwlens.functions.scoring import incident_explanation, incident_score, recommendations, score_breakdown, severity_of
from fwlens.operators.windows import MINUTE_US, numbered
from fwlens.session import checkpointed, concurrently

INCIDENT_COLUMNS = (
    "incident_id", "src_ip", "start_time", "end_time", "alert_count", "alert_types", "affected_destinations",
    "affected_ports", "event_count", "risk_score", "severity", "score_breakdown", "explanation", "recommendations",
)


def _chained(links: DataFrame, starts: DataFrame) -> DataFrame:
    """Every ``place`` that the links ``(a, b)`` lead to from ``starts``, both given by place.

    Pointer doubling: round i knows where 2^i links lead from each place, so a chain of n places takes log2(n) rounds, each a
    join of stored tables by place. No chain is ever a group.
    """
    spark = starts.sparkSession
    first, step = starts, links
    reached, links = concurrently(spark, [lambda: checkpointed(first), lambda: checkpointed(step)])
    while True:
        doubled = links.select("a", F.col("b").alias("mid")).join(links.select(F.col("a").alias("mid"), "b"), "mid").select("a", "b")
        further = reached.join(links, reached["place"] == links["a"]).select(F.col("b").alias("place"))
        further, links = concurrently(spark, [lambda: checkpointed(further), lambda: checkpointed(doubled)])  # noqa: B023
        if further.isEmpty():
            return reached
        reached = reached.unionByName(further)


def alert_anchors(times: DataFrame, window_us: int) -> DataFrame:
    """(src_ip, anchor) of the greedy grouping over (src_ip, us).

    The first time of a source opens a group; a time more than a window after the open anchor opens the next. Times are
    numbered by (source, time). Sorting each time beside its own end of window then tells two things by the places of both
    alone, without a group per source: how many times lie before each end, which names the time that opens the next
    group should this one open a group, and whether the window of the time before has ended, which makes a time an
    anchor whatever came before. From those the links are followed by pointer doubling.
    """
    placed = numbered(times.select("src_ip", "us").filter("us IS NOT NULL").distinct(), ("src_ip", "us"), "place")
    marks = placed.selectExpr("src_ip", "place", f"inline(array(struct(us AS at, 0 AS is_end), struct(us + {window_us}L AS at, 1 AS is_end)))")
    # a time that falls on an end still belongs to that group, so it is sorted before it
    lined = numbered(marks, ("src_ip", "at", "is_end"), "line").select("place", "line", "is_end")
    times_of = lined.filter("is_end = 0").selectExpr("place", "line = 2 * place - 1 AS starts")
    starts = times_of.filter("starts").select("place")
    onward = lined.filter("is_end = 1").selectExpr("place AS a", "line - place + 1 AS b")
    links = onward.join(times_of.filter("NOT starts").select(F.col("place").alias("b")), "b").select("a", "b")
    return _chained(links, starts).join(placed, "place").select("src_ip", F.col("us").alias("anchor"))


def with_anchor(alerts: DataFrame, window_us: int) -> DataFrame:
    """Adds to each alert the anchor of its group: the one in its own slot if not later, else the one before."""
    timed = alerts.withColumn("us", micros(F.col("timestamp"))).withColumn("slot", slot(F.col("us"), window_us))
    anchors = alert_anchors(timed, window_us).withColumn("home", slot(F.col("anchor"), window_us))
    reach = anchors.withColumn("slot", F.explode(F.array(F.col("home"), F.col("home") + 1)))
    by_slot = reach.groupBy("src_ip", "slot").agg(
        F.max(F.when(F.col("home") == F.col("slot"), F.col("anchor"))).alias("own"),
        F.max(F.when(F.col("home") < F.col("slot"), F.col("anchor"))).alias("previous"),
    )
    chosen = F.when(F.col("us") >= F.col("own"), F.col("own")).otherwise(F.col("previous"))
    return timed.join(by_slot, ["src_ip", "slot"]).withColumn("anchor", chosen).drop("slot", "us", "own", "previous")


# One row per alert, destination and port of an incident, so that equal values meet before they reach its group.
_PARTS = """inline(concat(
    array(named_struct('alerts', 1L, 'alert_type', alert_type, 'events', cast(event_count AS bigint), 'first_seen', first_seen,
                       'last_seen', last_seen, 'dst', cast(NULL AS string), 'port', cast(NULL AS int))),
    transform(destinations, d -> named_struct('alerts', 0L, 'alert_type', cast(NULL AS string), 'events', 0L,
        'first_seen', cast(NULL AS timestamp_ntz), 'last_seen', cast(NULL AS timestamp_ntz), 'dst', d, 'port', cast(NULL AS int))),
    transform(ports, p -> named_struct('alerts', 0L, 'alert_type', cast(NULL AS string), 'events', 0L,
        'first_seen', cast(NULL AS timestamp_ntz), 'last_seen', cast(NULL AS timestamp_ntz), 'dst', cast(NULL AS string), 'port', p))))"""


def correlate_alerts(alerts: DataFrame, config: Config) -> DataFrame:
    """Incidents: alerts of one source within a window of the group's first alert."""
    window_us = config.correlation.window_minutes * MINUTE_US
    parts = with_anchor(alerts, window_us).selectExpr("src_ip", "anchor", _PARTS)
    grouped = parts.groupBy("src_ip", "anchor").agg(
        F.min("first_seen").alias("start_time"),
        F.max("last_seen").alias("end_time"),
        F.sum("alerts").alias("alert_count"),
        F.array_sort(F.collect_set("alert_type")).alias("types"),
        F.array_sort(F.collect_set("dst")).alias("destinations"),
        F.array_sort(F.collect_set("port")).alias("ports"),
        F.sum("events").alias("event_count"),
    )
    placed = numbered(grouped, ("src_ip", "anchor"), "place")
    types = F.col("types")
    scored = placed.withColumn("risk_score", incident_score(types, config)).withColumn("alert_types", joined(types))
    return scored.select(
        F.format_string("INC-%06d", F.col("place")).alias("incident_id"),
        "src_ip",
        "start_time",
        "end_time",
        "alert_count",
        "alert_types",
        joined(F.col("destinations")).alias("affected_destinations"),
        joined(F.col("ports")).alias("affected_ports"),
        "event_count",
        "risk_score",
        severity_of(F.col("risk_score"), config).alias("severity"),
        score_breakdown(types, config).alias("score_breakdown"),
        incident_explanation(
            F.col("src_ip"), F.col("alert_count"), F.col("event_count"), F.col("alert_types"), F.size("destinations"),
            F.size("ports"), F.col("risk_score"),
        ).alias("explanation"),
        recommendations(types).alias("recommendations"),
        "types",
    )


def incidents_table(incidents: DataFrame) -> DataFrame:
    """The 14 flat columns of an exported incident."""
    return incidents.select(*INCIDENT_COLUMNS)
