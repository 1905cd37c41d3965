"""Behavioural features per source and time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fwlens.config import Config
from fwlens.functions.columns import (
    NORMAL_LABELS, bucket_start, col_or, flag, non_negative, outside_working_hours, ratio, strip,
)
from fwlens.functions.net import asset_key

MODEL_FEATURES = (
    "connection_count", "blocked_count", "blocked_ratio", "unique_dst_ips", "unique_dst_ports", "bytes_sent_total",
    "bytes_received_total", "average_bytes_sent", "average_bytes_received", "tcp_ratio", "udp_ratio", "activity_hour",
    "off_hours_indicator",
)
BASELINE_FEATURES = ("connection_count_vs_baseline_ratio", "unique_ports_vs_baseline_ratio")
LABEL_FEATURES = ("normal_label_ratio", "has_reliable_normal_label")


def build_features(logs: DataFrame, config: Config, baselines: DataFrame | None = None) -> DataFrame:
    """One row per (src_ip, window_start); with ``baselines`` two ratios to the asset's own level are added."""
    hours = config.working_hours
    events = logs.filter(F.col("timestamp").isNotNull() & F.col("src_ip").isNotNull()).select(
        "src_ip",
        bucket_start(F.col("timestamp"), config.ai_detection.window_minutes).alias("window_start"),
        col_or(logs, "dst_ip", None, "string").alias("dst_ip"),
        col_or(logs, "dst_port", None, "int").alias("dst_port"),
        flag(F.upper(col_or(logs, "action", "", "string")) == "BLOCK").alias("blocked"),
        flag(F.upper(col_or(logs, "protocol", "", "string")) == "TCP").alias("tcp"),
        flag(F.upper(col_or(logs, "protocol", "", "string")) == "UDP").alias("udp"),
        non_negative(col_or(logs, "bytes_sent", 0, "bigint")).alias("sent"),
        non_negative(col_or(logs, "bytes_received", 0, "bigint")).alias("received"),
        flag(F.lower(strip(col_or(logs, "label", None, "string"))).isin(*NORMAL_LABELS)).alias("normal"),
    )
    # distinct counts expand their input, so they run on one row per target and port, not on the log
    added = ("blocked", "tcp", "udp", "sent", "received", "normal")
    targets = events.groupBy("src_ip", "window_start", "dst_ip", "dst_port").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(name).alias(name) for name in added]
    )
    sums = targets.groupBy("src_ip", "window_start").agg(
        F.sum("n").alias("connection_count"), F.countDistinct("dst_ip").alias("unique_dst_ips"),
        F.countDistinct("dst_port").alias("unique_dst_ports"), *[F.sum(name).alias(name) for name in added],
    )
    mean = lambda name: F.col(name).cast("double") / F.col("connection_count")
    grouped = sums.select(
        "src_ip", "window_start", "connection_count", F.col("blocked").alias("blocked_count"), "unique_dst_ips",
        "unique_dst_ports", F.col("sent").alias("bytes_sent_total"), F.col("received").alias("bytes_received_total"),
        mean("sent").alias("average_bytes_sent"), mean("received").alias("average_bytes_received"),
        mean("tcp").alias("tcp_ratio"), mean("udp").alias("udp_ratio"), mean("normal").alias("normal_label_ratio"),
    )
    start = F.col("window_start")
    result = grouped.withColumns(
        {
            "blocked_ratio": ratio(F.col("blocked_count"), F.col("connection_count")),
            "activity_hour": F.hour(start),
            "off_hours_indicator": flag(outside_working_hours(start, hours.start_hour, hours.end_hour)),
            "has_reliable_normal_label": F.col("normal_label_ratio") == 1.0,
        }
    )
    if baselines is None:
        return result.select("src_ip", "window_start", *MODEL_FEATURES, *LABEL_FEATURES)
    settings = config.baselining
    usual = baselines.select(
        F.col("asset_key").alias("_asset"), F.col("event_count").alias("_events"), F.col("unique_ports_median").alias("_ports")
    )
    key = asset_key(F.col("src_ip"), settings.group_by, settings.subnet_prefix_length)

    def relative(value: str, level: str) -> Column:
        usual_level = F.col(level).cast("double")
        return F.coalesce(F.when(usual_level > 0, F.col(value) / usual_level), F.lit(1.0))

    return (
        result.join(usual, key == F.col("_asset"), "left")
        .withColumn("connection_count_vs_baseline_ratio", relative("connection_count", "_events"))
        .withColumn("unique_ports_vs_baseline_ratio", relative("unique_dst_ports", "_ports"))
        .select("src_ip", "window_start", *MODEL_FEATURES, *BASELINE_FEATURES, *LABEL_FEATURES)
    )
