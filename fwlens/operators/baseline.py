"""Robust per-asset history and the thresholds that follow from it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from fwlens.config import Baselining, Config
from fwlens.functions.columns import bucket_start, col_or, flag, non_negative
from fwlens.functions.net import asset_key
from fwlens.operators.quantiles import histogram, quantiles

# metric of a detector -> baseline column that stands for its usual level
METRICS = {
    "blocked_rate": "blocked_rate_median",
    "unique_ports": "unique_ports_median",
    "unique_dsts": "unique_dsts_median",
    "bytes_sent": "bytes_sent_p95",
}


def compute_baseline(history: DataFrame, config: Config) -> DataFrame:
    """One row per asset: event count, median and MAD of three per-window metrics, p95 of bytes per event.

    Each metric is bucketed by the window of the detector that uses it; buckets without events do not exist. An
    asset's buckets number at most its time span over the window; its byte sizes have no such bound and go through
    the bucketed quantile.
    """
    settings = config.baselining
    data = history.filter("timestamp IS NOT NULL AND src_ip IS NOT NULL").select(
        asset_key(F.col("src_ip"), settings.group_by, settings.subnet_prefix_length).alias("asset_key"),
        "timestamp",
        flag(F.upper(col_or(history, "action", "ALLOW", "string")) == "BLOCK").alias("is_blocked"),
        col_or(history, "dst_port", None, "int").alias("dst_port"),
        col_or(history, "dst_ip", None, "string").alias("dst_ip"),
        non_negative(col_or(history, "bytes_sent", 0, "bigint")).alias("bytes_sent"),
    )
    measures = {
        "blocked_rate": (config.brute_force.window_minutes, "sum(is_blocked)"),
        "unique_ports": (config.port_scan.window_minutes, "count(DISTINCT dst_port)"),
        "unique_dsts": (config.host_scan.window_minutes, "count(DISTINCT dst_ip)"),
    }
    sizes = quantiles(histogram(data, ["asset_key"], "bytes_sent"), ["asset_key"], [0.95])
    result = sizes.selectExpr("asset_key", "total AS event_count", "quantile AS bytes_sent_p95")
    # metrics that share a window length share one pass
    for minutes in sorted({length for length, _ in measures.values()}):
        shared = {name: text for name, (length, text) in measures.items() if length == minutes}
        # distinct counts expand their input, so they run on one row per target and port, not on the log
        targets = data.groupBy(
            "asset_key", bucket_start(F.col("timestamp"), minutes).alias("bucket"), "dst_ip", "dst_port"
        ).agg(F.sum("is_blocked").alias("is_blocked"))
        per_bucket = targets.groupBy("asset_key", "bucket").agg(
            *[F.expr(f"cast({text} AS double) AS {name}") for name, text in shared.items()]
        )
        # the median joins its rows as a window value, so the spread needs no second shuffle
        centred = per_bucket.selectExpr(
            "asset_key", *shared, *[f"median({name}) OVER (PARTITION BY asset_key) AS {name}_centre" for name in shared]
        )
        levels = [
            text
            for name in shared
            for text in (f"median({name}) AS {name}_median", f"median(abs({name} - {name}_centre)) AS {name}_mad")
        ]
        result = result.join(centred.groupBy("asset_key").agg(*map(F.expr, levels)), "asset_key")
    return result


def own_threshold(events: Column, level: Column, settings: Baselining) -> Column:
    """An asset's own threshold: its level times a factor, floor included; NULL where its history is too short or empty."""
    own = F.greatest(F.lit(float(settings.min_threshold_floor)), level * settings.deviation_multiplier)
    return F.when((events >= settings.min_history_events) & (level > 0), own)


def threshold_columns(own: Column, level: Column, fallback: Column, kind: str) -> dict[str, Column]:
    """The threshold in force, where it comes from, and the level it was made of."""
    return {
        "threshold": F.coalesce(own, fallback.cast("double")).cast(kind),
        "threshold_source": F.when(own.isNotNull(), "per_asset_baseline").otherwise("global_config"),
        "asset_baseline_value": F.when(own.isNotNull(), level),
    }


@dataclass(frozen=True)
class ThresholdRule:
    """Threshold of one metric: the asset's own level times a factor, or the global value."""

    metric: str
    global_value: int | float | Column
    config: Config
    baselines: DataFrame | None = None
    whole: bool = True

    @cached_property
    def bound(self) -> int | None:
        """The largest threshold that any source can have, as a plain number.

        With baselines it is read from them by one aggregate over a row per asset, so they should be a stored table.
        """
        if not isinstance(self.global_value, (int, float)):
            return None
        if self.baselines is None:
            return int(self.global_value)
        own = own_threshold(F.col("event_count"), F.col(METRICS[self.metric]), self.config.baselining)
        largest = self.baselines.agg(F.max(own)).first()[0]
        return int(max(self.global_value, largest or 0))

    def attach(self, df: DataFrame) -> DataFrame:
        """Adds threshold, threshold_source and asset_baseline_value to a frame with ``src_ip``.

        The baseline side is joined without a hint: Spark broadcasts it when its measured size allows.
        """
        fallback = self.global_value if isinstance(self.global_value, Column) else F.lit(self.global_value)
        kind = "bigint" if self.whole else "double"
        if self.baselines is None:
            return df.withColumns(
                {
                    "threshold": fallback.cast(kind),
                    "threshold_source": F.lit("global_config"),
                    "asset_baseline_value": F.lit(None).cast("double"),
                }
            )
        settings = self.config.baselining
        level = F.col(METRICS[self.metric])
        side = self.baselines.select(
            F.col("asset_key").alias("_asset"), level.alias("_level"), own_threshold(F.col("event_count"), level, settings).alias("_own")
        )
        key = asset_key(F.col("src_ip"), settings.group_by, settings.subnet_prefix_length)
        joined = df.join(side, key == F.col("_asset"), "left")
        return joined.withColumns(threshold_columns(F.col("_own"), F.col("_level"), fallback, kind)).drop("_asset", "_level", "_own")


def effective_thresholds(baselines: DataFrame, config: Config, global_bytes: float | None = None) -> DataFrame:
    """(asset_key, metric, threshold, threshold_source, asset_baseline_value) for every known asset, by the rule that the
    detectors apply."""
    globals_ = {
        "blocked_rate": config.brute_force.blocked_attempts,
        "unique_ports": config.port_scan.unique_ports,
        "unique_dsts": config.host_scan.unique_destinations,
        "bytes_sent": config.large_transfer.minimum_bytes if global_bytes is None else global_bytes,
    }
    rows = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(METRICS[m]).alias("level"), F.lit(float(g)).alias("global_value"))
            for m, g in globals_.items()
        ]
    )
    own = own_threshold(F.col("event_count"), F.col("level"), config.baselining)
    columns = threshold_columns(own, F.col("level"), F.col("global_value"), "double")
    return baselines.select("asset_key", "event_count", F.inline(rows)).select(
        "asset_key", "metric", *[c.alias(name) for name, c in columns.items()]
    )


def baseline_of(baselines: DataFrame, key: str) -> DataFrame:
    """Point lookup of one asset."""
    return baselines.filter(F.col("asset_key") == key)
