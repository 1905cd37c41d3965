"""A whole analysis: logs in, alerts, incidents, anomalies and rankings out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from fwlens.config import Config
from fwlens.functions.columns import literal_map
from fwlens.operators.clean import CleanedLogs, clean_logs
from fwlens.operators.correlate import correlate_alerts, incidents_table
from fwlens.operators.detect import AlertRun, alerts_table, run_all_detectors
from fwlens.operators.features import build_features
from fwlens.operators.iforest import AnomalyResult, anomalies_only, detect_anomalies, disabled_anomalies, ranked
from fwlens.operators.report_tables import cleaning_table, first_alerts, incident_cards, top_incidents
from fwlens.operators.traffic import flows, top_destination_ips, top_destination_ports, top_source_ips
from fwlens.operators.windows import id_order
from fwlens.session import checkpointed, require_utc
from fwlens.sources import sinks
from fwlens.sources.readers import input_errors, load_logs, rejected_records
from fwlens.sources.schema_map import MappedLogs, map_log_schema, require_dataset


@dataclass(frozen=True)
class Analysis:
    mapping: MappedLogs
    cleaned: CleanedLogs
    run: AlertRun
    incidents: DataFrame

    @property
    def logs(self) -> DataFrame:
        return self.cleaned.logs

    @property
    def alerts(self) -> DataFrame:
        return self.run.alerts


def analyze(raw: DataFrame, config: Config, work_dir: str, baselines: DataFrame | None = None) -> Analysis:
    """Map, clean, detect and correlate.

    The distinct, typed rows are written once under ``work_dir`` (shared storage); every later step scans only the
    columns it needs from there.
    """
    require_utc(raw.sparkSession)
    require_dataset(raw)
    mapping = map_log_schema(raw, config.aliases)
    require_dataset(mapping.df, ("timestamp", "src_ip"))
    with input_errors():
        cleaned = clean_logs(mapping, epoch_unit=config.epoch_unit or None).materialized(f"{work_dir}/flagged_logs")
    require_dataset(cleaned.logs)
    run = run_all_detectors(cleaned.logs, config, mapping.mapped, baselines)
    return Analysis(mapping, cleaned, run, correlate_alerts(run.stored, config))


def score_anomalies(logs: DataFrame, config: Config, features: DataFrame | None = None) -> AnomalyResult:
    """Scores of the log's windows, whose ``features`` may have been built before."""
    if not config.ai_detection.enabled:
        return AnomalyResult(disabled_anomalies(logs.sparkSession), "AI detection is disabled.")
    return detect_anomalies(build_features(logs, config) if features is None else features, config.ai_detection)


def run_summary(
    analysis: Analysis, scores: DataFrame, sources: DataFrame, ports: DataFrame, config: Config
) -> DataFrame:
    """One row: counts, extremes, mapping and skipped detectors."""
    summary = analysis.cleaned.summary
    flagged = "is_ai_anomaly" in scores.columns
    anomalies = scores.agg(F.count_if(F.coalesce(F.col("is_ai_anomaly"), F.lit(False)))).scalar() if flagged else F.lit(0)
    first = lambda df, name: F.coalesce(  # noqa: E731 - one-row subquery that is NULL for an empty ranking
        df.orderBy(F.desc("total_events"), name).limit(1).select(F.col(name).cast("string")).scalar(), F.lit("None")
    )
    none = F.array().cast("array<string>")
    return summary.select(
        F.col("original_row_count").alias("input_rows"),
        F.col("final_row_count").alias("cleaned_rows"),
        analysis.alerts.agg(F.count(F.lit(1))).scalar().alias("alerts_detected"),
        analysis.incidents.agg(F.count(F.lit(1))).scalar().alias("incidents_created"),
        anomalies.alias("ai_anomalies"),
        scores.agg(F.coalesce(F.max("ai_anomaly_score"), F.lit(0.0))).scalar().alias("highest_ai_score"),
        first(sources, "src_ip").alias("most_active_source_ip"),
        first(ports, "dst_port").alias("most_frequent_destination_port"),
        F.lit(config.baselining.enabled).alias("baselining_enabled"),
        "duplicate_rows_removed",
        "invalid_timestamps",
        "invalid_ip_addresses",
        "invalid_ports",
        "invalid_bytes",
        "missing_values",
        literal_map(analysis.mapping.mapped).alias("mapped_columns"),
        (F.array(*map(F.lit, analysis.mapping.unavailable)) if analysis.mapping.unavailable else none)
        .alias("unavailable_columns"),
        (F.array(*map(F.lit, analysis.run.skipped)) if analysis.run.skipped else none).alias("skipped_detectors"),
    )


def run_job(
    spark: SparkSession, input_path: str, output_root: str, config: Config, multi_line: bool = False, check_utf8: bool = False,
    keep_rejected: bool = False,
) -> dict[str, str]:
    """Analyse a log and write every result under ``output_root``; returns the written paths.

    ``multi_line`` reads CSV records that span lines, ``check_utf8`` looks for undecodable text first, and ``keep_rejected``
    writes records that cannot be read to a table of their own instead of failing.
    """
    with input_errors():
        raw = load_logs(spark, input_path, multi_line=multi_line, check_utf8=check_utf8, keep_rejected=keep_rejected)
    analysis = analyze(raw, config, f"{output_root}/work")
    incidents = checkpointed(analysis.incidents)
    features = checkpointed(build_features(analysis.logs, config)) if config.ai_detection.enabled else None
    result = score_anomalies(analysis.logs, config, features)
    flow_rows = checkpointed(flows(analysis.logs))
    sources = top_source_ips(analysis.logs, analysis.alerts, incidents, config.top_n, flow_rows)
    ports = top_destination_ports(analysis.logs, config.top_n, flow_rows)
    destinations = top_destination_ips(analysis.logs, config.top_n, flow_rows)
    found = ranked(anomalies_only(result.scores))
    done = Analysis(analysis.mapping, analysis.cleaned, analysis.run, incidents)
    tables = {
        "ai/anomalies.csv": found,
        "analytics/top_source_ips.csv": sources,
        "analytics/top_destination_ports.csv": ports,
        "analytics/top_destination_ips.csv": destinations,
        "reports/cleaning_summary.csv": cleaning_table(analysis.cleaned.summary),
        "reports/top_incidents.csv": top_incidents(incidents),
        "reports/first_alerts.csv": first_alerts(analysis.alerts),
        "reports/incident_cards.csv": incident_cards(incidents),
        "run_summary.csv": run_summary(done, result.scores, sources, ports, config),
    }
    paths = {
        "cleaned": sinks.export_cleaned(analysis.logs.orderBy("timestamp", "row_id"), output_root),
        "cleaned_columns": sinks.export_cleaned_columns(analysis.logs, output_root),
        "alerts": sinks.export_alerts(alerts_table(analysis.alerts).orderBy(*id_order("alert_id")), output_root),
        "incidents": sinks.export_incidents(incidents_table(incidents).orderBy("start_time", *id_order("incident_id")), output_root),
    }
    for name, table in tables.items():
        paths[name.rsplit("/", 1)[-1].removesuffix(".csv")] = sinks.export_csv(table, f"{output_root}/{name}")
    if features is not None:
        paths["features"] = sinks.export_csv(features.orderBy("window_start", "src_ip"), f"{output_root}/ai/features.csv")
    if keep_rejected:
        rejected = rejected_records(spark, input_path, multi_line=multi_line)
        paths["rejected"] = sinks.export_parquet(rejected, f"{output_root}/rejected.parquet")
    return paths
