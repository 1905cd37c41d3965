"""Traffic rankings, counters and time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fwlens.functions.columns import col_or, flag, ratio, service_name
from fwlens.functions.scoring import SEVERITIES
from fwlens.session import checkpointed

RANKING_KEYS = ("src_ip", "dst_ip", "dst_port")


def flows(logs: DataFrame) -> DataFrame:
    """Traffic per (src_ip, dst_ip, dst_port): the common first step of all rankings.

    Map-side combining shrinks the log once, and a busy source or port is spread over its counterparts.
    """
    action = F.upper(col_or(logs, "action", "", "string"))
    return (
        logs.select(
            *[col_or(logs, name, None, "int" if name == "dst_port" else "string").alias(name) for name in RANKING_KEYS],
            flag(action == "ALLOW").alias("allowed"),
            flag(action == "BLOCK").alias("blocked"),
            F.coalesce(col_or(logs, "bytes_sent", 0, "bigint"), F.lit(0)).alias("sent"),
            F.coalesce(col_or(logs, "bytes_received", 0, "bigint"), F.lit(0)).alias("received"),
        )
        .groupBy(*RANKING_KEYS)
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.sum("allowed").alias("allowed"),
            F.sum("blocked").alias("blocked"),
            F.sum("sent").alias("sent"),
            F.sum("received").alias("received"),
        )
    )


def _ranking(flow_rows: DataFrame, key: str, distinct: dict[str, str], top_n: int) -> DataFrame:
    """Busiest keys, ties by key; rows without a key are no candidate."""
    totals = flow_rows.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.sum("events").alias("total_events"),
        F.sum("allowed").alias("allowed_events"),
        F.sum("blocked").alias("blocked_events"),
        *[F.countDistinct(column).alias(name) for name, column in distinct.items()],
        F.sum("sent").alias("bytes_sent_total"),
        F.sum("received").alias("bytes_received_total"),
    )
    return (
        totals.withColumn("blocked_ratio", ratio(F.col("blocked_events"), F.col("total_events")))
        .orderBy(F.desc("total_events"), key)
        .limit(max(1, int(top_n)))
    )


def top_source_ips(
    logs: DataFrame, alerts: DataFrame | None = None, incidents: DataFrame | None = None, top_n: int = 10,
    flow_rows: DataFrame | None = None,
) -> DataFrame:
    distinct = {"unique_dst_ips": "dst_ip", "unique_dst_ports": "dst_port"}
    # at most top_n rows, kept so that what is joined to them does not rank again
    top = checkpointed(_ranking(flows(logs) if flow_rows is None else flow_rows, "src_ip", distinct, top_n))
    wanted = F.broadcast(top.select("src_ip"))
    for name, frame, measure in (
        ("alert_count", alerts, lambda: F.count(F.lit(1))),
        ("highest_incident_risk_score", incidents, lambda: F.max("risk_score")),
    ):
        if frame is None:
            top = top.withColumn(name, F.lit(0).cast("bigint"))
            continue
        # only the ranked sources are counted, hence again at most top_n rows
        per_source = frame.join(wanted, "src_ip", "left_semi").groupBy("src_ip").agg(measure().cast("bigint").alias(name))
        top = top.join(F.broadcast(per_source), "src_ip", "left").fillna(0, [name])
    return top.select(
        "src_ip", "total_events", "allowed_events", "blocked_events", "blocked_ratio", "unique_dst_ips", "unique_dst_ports",
        "bytes_sent_total", "bytes_received_total", "alert_count", "highest_incident_risk_score",
    ).orderBy(F.desc("total_events"), "src_ip")


def top_destination_ports(logs: DataFrame, top_n: int = 10, flow_rows: DataFrame | None = None) -> DataFrame:
    distinct = {"unique_source_ips": "src_ip", "unique_destination_ips": "dst_ip"}
    top = _ranking(flows(logs) if flow_rows is None else flow_rows, "dst_port", distinct, top_n)
    return top.select(
        "dst_port", service_name(F.col("dst_port")).alias("service_name"), "total_events", "unique_source_ips",
        "unique_destination_ips", "allowed_events", "blocked_events", "blocked_ratio", "bytes_sent_total",
        "bytes_received_total",
    )


def top_destination_ips(logs: DataFrame, top_n: int = 10, flow_rows: DataFrame | None = None) -> DataFrame:
    top = _ranking(flows(logs) if flow_rows is None else flow_rows, "dst_ip", {"unique_source_ips": "src_ip"}, top_n)
    return top.select(
        "dst_ip", "total_events", "unique_source_ips", "allowed_events", "blocked_events", "blocked_ratio",
        "bytes_sent_total", "bytes_received_total",
    )


def port_labels(ports: DataFrame) -> DataFrame:
    label = F.concat_ws(" - ", F.col("dst_port").cast("string"), "service_name")
    return ports.select(label.alias("port_label"), "total_events")


def action_totals(logs: DataFrame) -> DataFrame:
    """One row: events, allowed, blocked."""
    action = F.col("action") if "action" in logs.columns else F.lit("")
    return logs.agg(
        F.count(F.lit(1)).alias("events"),
        F.coalesce(F.sum(flag(action == "ALLOW")), F.lit(0)).alias("allowed"),
        F.coalesce(F.sum(flag(action == "BLOCK")), F.lit(0)).alias("blocked"),
    )


def kpi_summary(logs: DataFrame, alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    """One row of headline counters, each frame reduced to a row before they meet."""
    names = ("events", "allowed", "blocked", "alerts", "incidents", "critical_incidents", "highest_risk")
    rows = (
        action_totals(logs),
        alerts.agg(F.count(F.lit(1)).alias("alerts")),
        incidents.agg(
            F.count(F.lit(1)).alias("incidents"),
            F.count_if(F.col("severity") == "Critical").alias("critical_incidents"),
            F.coalesce(F.max("risk_score"), F.lit(0)).alias("highest_risk"),
        ),
    )
    padded = [
        row.select(*[(F.col(n) if n in row.columns else F.lit(0)).cast("bigint").alias(n) for n in names]) for row in rows
    ]
    return padded[0].unionByName(padded[1]).unionByName(padded[2]).agg(*[F.sum(n).alias(n) for n in names])


def action_counts(logs: DataFrame) -> DataFrame:
    """Two rows: ALLOW and BLOCK with their number of events."""
    pairs = F.array(*[F.struct(F.lit(word).alias("action"), F.col(name).alias("count")) for word, name in
                      (("ALLOW", "allowed"), ("BLOCK", "blocked"))])
    return action_totals(logs).select(F.inline(pairs))


def severity_histogram(incidents: DataFrame) -> DataFrame:
    """Four rows in severity order, zero where there is no incident."""
    counted = incidents.agg(*[F.count_if(F.col("severity") == name).alias(name) for name in SEVERITIES])
    rows = F.array(
        *[
            F.struct(F.lit(place).alias("rank"), F.lit(name).alias("severity"), F.col(name).alias("count"))
            for place, name in enumerate(SEVERITIES, start=1)
        ]
    )
    return counted.select(F.inline(rows)).orderBy("rank").select("severity", "count")


_UNITS = (("second", "INTERVAL 10 MINUTES"), ("minute", "INTERVAL 2 HOURS"), ("hour", "INTERVAL 2 DAYS"))


def _per_unit(chosen: Column, then) -> Column:
    """``then(unit)`` for the unit that ``chosen`` names."""
    branches = F.when(chosen == "second", then("second")).when(chosen == "minute", then("minute"))
    return branches.when(chosen == "hour", then("hour")).otherwise(then("day"))


def events_over_time(logs: DataFrame) -> DataFrame:
    """Events per second, minute, hour or day, by the span of the data; empty bins count zero.

    The log is reduced to seconds once; span, bins and counts all come from that.
    """
    ts = F.col("timestamp")
    seconds = logs.groupBy(F.date_trunc("second", ts).cast("timestamp_ntz").alias("second")).agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last")
    )
    bounds = seconds.agg(F.min("first").alias("first"), F.max("last").alias("last"))
    span = F.col("last") - F.col("first")
    unit = F.lit("day")
    for name, longest in reversed(_UNITS):
        unit = F.when(span <= F.expr(longest), name).otherwise(unit)
    bounds = bounds.withColumn("unit", unit)
    trunc = lambda c: lambda name: F.date_trunc(name, c).cast("timestamp_ntz")
    low, high = _per_unit(F.col("unit"), trunc(F.col("first"))), _per_unit(F.col("unit"), trunc(F.col("last")))
    step = _per_unit(F.col("unit"), lambda name: F.expr(f"make_dt_interval({dict(day='1,0,0,0', hour='0,1,0,0', minute='0,0,1,0', second='0,0,0,1')[name]})"))
    bins = bounds.filter(F.col("first").isNotNull()).select(
        F.col("unit").alias("bin_unit"), F.explode(F.sequence(low, high, step)).alias("bin_start")
    )
    chosen = bounds.select("unit").scalar()
    counts = (
        seconds.withColumn("unit", chosen)
        .groupBy(_per_unit(F.col("unit"), trunc(F.col("second"))).alias("bin_start"))
        .agg(F.sum("n").alias("events"))
    )
    return (
        bins.join(counts, "bin_start", "left")
        .select("bin_start", "bin_unit", F.coalesce("events", F.lit(0)).alias("events"))
        .orderBy("bin_start")
    )


def observed_counts(logs: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """One row: distinct sources, distinct destination ports and the highest anomaly score."""
    # pairs meet on the map side, so the two distinct counts expand them and not the log
    pairs = logs.select("src_ip", col_or(logs, "dst_port", None, "int").alias("dst_port")).distinct()
    kinds = pairs.agg(F.countDistinct("src_ip").alias("source_ips"), F.countDistinct("dst_port").alias("destination_ports"))
    if scores is None:
        return kinds.withColumn("highest_ai_score", F.lit(0.0))
    best = scores.agg(F.coalesce(F.max("ai_anomaly_score"), F.lit(0.0))).scalar()
    return kinds.withColumn("highest_ai_score", best)


def date_domain(logs: DataFrame) -> DataFrame:
    """One row: first and last date."""
    return logs.agg(F.to_date(F.min("timestamp")).alias("min_date"), F.to_date(F.max("timestamp")).alias("max_date"))


def value_domain(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values of a column in text order."""
    return df.filter(F.col(column).isNotNull()).select(F.col(column).cast("string")).distinct().orderBy(column)
