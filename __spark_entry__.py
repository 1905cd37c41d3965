"""

The given tables hold no firewall log, so ``fw_logs`` projects every row of ``events`` to the canonical log schema
and ``fw_raw`` renders the same rows as a dirty text export with vendor headers. Events are sparse, hence the
detectors run with windows of half a day.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import date
from importlib import import_module
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracles
from fwlens.config import AnomalyModel, Baselining, BlockedBurst, Config, Correlation, HostScan, PortScan
from fwlens.functions import net
from fwlens.functions.columns import normal_action, service_name
from fwlens.functions.scoring import severity_of, severity_rank
from fwlens.operators import baseline, clean, correlate, detect, explain, features, iforest, investigate, quantiles
from fwlens.operators import report_tables, traffic
from fwlens.plans.analysis import Analysis, run_summary, score_anomalies
from fwlens.session import checkpointed, ensure_checkpoint_dir, settled
from fwlens.sources import sinks
from fwlens.sources.readers import load_logs
from fwlens.sources.schema_map import map_log_schema

def _optional(name: str):
    """A module of the training-data part, or nothing where that part is not installed."""
    try:
        return import_module(name)
    except ModuleNotFoundError as error:
        if error.name not in {"fwlens.llm", "corpus_pipeline"}:
            raise
        return None


LLM = _optional("fwlens.llm.queries")
PIPELINE = _optional("corpus_pipeline")

CONFIG = Config(
    brute_force=BlockedBurst(blocked_attempts=6, window_minutes=720),
    port_scan=PortScan(unique_ports=12, window_minutes=720),
    host_scan=HostScan(unique_destinations=16, window_minutes=720),
    correlation=Correlation(window_minutes=1440, multiple_alert_bonus=15),
    ai_detection=AnomalyModel(window_minutes=720),
    baselining=Baselining(enabled=False, min_history_events=20, deviation_multiplier=2.0),
)
ADAPTIVE = CONFIG.with_baselining(True)
SUBNETS = replace(ADAPTIVE, baselining=replace(ADAPTIVE.baselining, group_by="subnet24"))
SPEC = investigate.FilterSpec(
    start=date(2024, 1, 5), end=date(2024, 1, 20), sources=("10.0.0.0", "10.0.1.5", "10.0.2.10", "10.0.3.3"),
    severities=("Low", "Medium"), alert_types=("Port scan", "Large outbound transfer"),
)


# Written forms of the time in the raw log, by the value of k; SQL has the same in oracles.TIME_FORMS.
TIME_FORMS = {
    14: "yyyy/MM/dd HH:mm:ss", 33: "M/d/yyyy H:mm:ss", 34: "MM/dd/yyyy hh:mm:ss a", 35: "yyyyMMdd'T'HHmmss",
    36: "dd MMM yyyy HH:mm:ss", 37: "MMMM d, yyyy HH:mm", 38: "yyyy.MM.dd HH:mm:ss", 39: "EEE, dd MMM yyyy HH:mm:ss 'GMT'",
    40: "yyyy-MM-dd'T'HH:mm:ss'+02:00'", 41: "yyyy/M/d H:mm:ss.SSSSSS", 43: "dd-MMM-yyyy HH:mm:ss",
}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    k = F.get_json_object("props", "$.k").cast("int")
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", k)


def _columns() -> dict:
    kind, k = F.col("event_type"), F.col("k")
    sensitive = F.when(k % 3 == 0, 22).when(k % 3 == 1, 23).otherwise(3389)
    return {
        "src_ip": F.concat(F.lit("10.0."), (F.col("user_id") % 4).cast("string"), F.lit("."), (F.col("user_id") % 20).cast("string")),
        "dst_ip": F.concat(F.lit("203.0.113."), (k % 50).cast("string")),
        "src_port": (1024 + F.col("event_id") % 60000).cast("int"),
        "dst_port": F.when(kind == "error", sensitive).when(kind == "purchase", 445).when(kind == "signup", 53)
        .when(kind == "view", 443).otherwise(8000 + k),
        "protocol": F.when(kind == "signup", "udp").otherwise("tcp"),
        "action": F.when(kind == "error", "denied").when(kind == "purchase", "Drop").when(kind == "signup", "accept")
        .when(kind == "view", "ALLOW").otherwise("pass"),
        "bytes_sent": F.round(F.col("value") * 100).cast("bigint") * 1000,
        "bytes_received": (k * 100).cast("bigint"),
        "label": F.when(kind.isin("view", "signup"), "normal").when(kind == "click", "benign").otherwise("suspect"),
    }


def fw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean canonical log."""
    c = _columns()
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("row_id"),
        F.col("ts").alias("timestamp"),
        *[c[name].alias(name) for name in ("src_ip", "dst_ip", "src_port", "dst_port")],
        F.upper(c["protocol"]).alias("protocol"),
        normal_action(c["action"]).alias("action"),
        *[c[name].alias(name) for name in ("bytes_sent", "bytes_received", "label")],
    )


def fw_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text export with vendor headers, invalid cells, missing cells and repeated rows."""
    c = _columns()
    k = F.col("k")
    text = {name: column.cast("string") for name, column in c.items()}
    written = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    for value, form in TIME_FORMS.items():
        written = F.when(k == value, F.date_format("ts", form)).otherwise(written)
    rows = _events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("Event ID"),
        F.when(k == 13, "no time").otherwise(written).alias("Generated Time"),
        F.when(k == 17, "999.1.1.1").when(k == 18, F.concat(F.lit(" "), text["src_ip"], F.lit("\t"))).otherwise(text["src_ip"])
        .alias("Source address"),
        F.when(k == 27, "2001:db8::7").otherwise(text["dst_ip"]).alias("Destination address"),
        text["src_port"].alias("Source Port"),
        F.when(k == 19, "70000").when(k == 20, "22.7").when(k == 21, "ssh").otherwise(text["dst_port"]).alias("Destination Port"),
        F.when(k != 29, text["protocol"]).alias("Protocol"),
        text["action"].alias("Action"),
        F.when(k == 23, "-5").otherwise(text["bytes_sent"]).alias("Bytes Sent"),
        F.when(k == 17, "n/k").otherwise(text["bytes_received"]).alias("Bytes Received"),
        F.when(k != 31, text["label"]).alias("label"),
        F.explode(F.array_repeat(F.lit(1), F.when(k.isin(13, 42), 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")


def _cleaned(spark, sf) -> clean.CleanedLogs:
    return clean.clean_logs(map_log_schema(fw_raw(spark, sf)), row_id="Event ID")


def _shown(alerts: DataFrame) -> DataFrame:
    """Alerts as comparable flat columns."""
    e = F.col("evidence")
    table = alerts.select(
        *[c for c in ("alert_id",) if c in alerts.columns],
        "timestamp", "src_ip", "dst_ip", "alert_type", "severity",
        F.col("event_count").cast("bigint").alias("event_count"),
        F.col("window_minutes").cast("bigint").alias("window_minutes"),
        F.col("score_contribution").cast("bigint").alias("score_contribution"),
        "first_seen", "last_seen",
        F.array_join("destinations", ", ").alias("affected_destinations"),
        F.array_join(F.col("ports").cast("array<string>"), ", ").alias("affected_ports"),
        e["threshold_source"].alias("threshold_source"),
        e["effective_threshold"].alias("effective_threshold"),
        e["observed_value"].alias("observed_value"),
        F.round(e["asset_baseline_value"], 2).alias("asset_baseline_value"),
    )
    return table


def _alerts(spark, sf, config=CONFIG) -> DataFrame:
    return detect.run_all_detectors(fw_logs(spark, sf), config).alerts


def _found(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Alerts and their incidents."""
    run = detect.run_all_detectors(fw_logs(spark, sf), CONFIG)
    return run.alerts, correlate.correlate_alerts(run.stored, CONFIG)


def _incidents(spark, sf) -> DataFrame:
    return _found(spark, sf)[1]


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _off_hours(spark, sf):
    alerts = detect.detect_off_hours(fw_logs(spark, sf), CONFIG)
    e = F.col("evidence")
    return _shown(alerts).drop("threshold_source", "effective_threshold", "observed_value", "asset_baseline_value").join(
        alerts.select(
            "src_ip", e["off_hours_window"].alias("off_hours_window"), e["blocked_events"].alias("blocked_events"),
            F.array_join(e["rare_ports"].cast("array<string>"), ", ").alias("rare_ports"),
            e["large_transfer_events"].alias("large_transfer_events"),
        ),
        "src_ip",
    )


def _schema_mapping(spark, sf):
    mapping = map_log_schema(fw_raw(spark, sf))
    return mapping.df.groupBy("protocol", "action").agg(
        F.count("timestamp").alias("timestamps"), F.count("src_ip").alias("sources"), F.countDistinct("dst_ip").alias("targets"),
        F.count("label").alias("labels"),
    )


def _asset_key(spark, sf):
    return fw_logs(spark, sf).groupBy(net.asset_key(F.col("src_ip"), "subnet24", 22).alias("network")).agg(
        F.count(F.lit(1)).alias("events")
    )


def _folder(spark, name: str) -> str:
    """A folder of its own on the storage that executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _run_summary(spark, sf):
    """The whole run over the raw log; the cleaning counters come from the write of the cleaned rows."""
    mapping = map_log_schema(fw_raw(spark, sf))
    cleaned = clean.clean_logs(mapping, row_id="Event ID").materialized(_folder(spark, "flagged"))
    run = detect.run_all_detectors(cleaned.logs, CONFIG, mapping.mapped)
    analysis = Analysis(mapping, cleaned, run, checkpointed(correlate.correlate_alerts(run.stored, CONFIG)))
    scores = checkpointed(score_anomalies(cleaned.logs, CONFIG).scores)
    flows = checkpointed(traffic.flows(cleaned.logs))
    sources = traffic.top_source_ips(cleaned.logs, analysis.alerts, analysis.incidents, 10, flows)
    row = run_summary(analysis, scores, sources, traffic.top_destination_ports(cleaned.logs, 10, flows), CONFIG)
    mapped = F.array_join(F.transform(F.map_entries("mapped_columns"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    return row.withColumns({
        "mapped_columns": mapped, "unavailable_columns": F.array_join("unavailable_columns", ", "),
        "skipped_detectors": F.array_join("skipped_detectors", ", "),
    })


CLEAN_COLUMNS = (
    "row_id", "timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "action", "bytes_sent", "bytes_received", "label"
)


def _read_back(kind: str):
    """The raw log written as a file of one kind, loaded like any input, mapped and cleaned."""

    def run(spark, sf):
        path = f"{_folder(spark, 'raw')}/log.{kind}"
        raw = fw_raw(spark, sf)
        raw.write.json(path) if kind == "jsonl" else sinks.export_csv(raw, path)
        mapping = map_log_schema(load_logs(spark, path))
        return clean.clean_logs(mapping, row_id="Event ID").logs.select(*CLEAN_COLUMNS)

    return run


def _partial(spark, sf) -> clean.CleanedLogs:
    """A log that holds times, sources, destinations and ports only."""
    columns = ["Event ID", "Generated Time", "Source address", "Destination address", "Destination Port"]
    return clean.clean_logs(map_log_schema(fw_raw(spark, sf).select(*columns)), row_id="Event ID")


def _partial_mapping(spark, sf):
    cleaned = _partial(spark, sf)
    skipped = detect.skipped_detectors(cleaned.mapped)
    return cleaned.logs.agg(
        F.count(F.lit(1)).alias("events"), F.lit(", ".join(cleaned.mapped)).alias("mapped"), F.lit(", ".join(cleaned.unavailable)).alias("unavailable"),
        F.lit(", ".join(skipped)).alias("skipped"),
    )


def _partial_alerts(spark, sf):
    cleaned = _partial(spark, sf)
    return _shown(detect.run_all_detectors(cleaned.logs, CONFIG, cleaned.mapped).alerts).drop("alert_id")


def _cleaned_columns(spark, sf):
    root = _folder(spark, "clean")
    stored = spark.read.parquet(sinks.export_cleaned_columns(_cleaned(spark, sf).logs, root))
    return stored.select(*CLEAN_COLUMNS)


def _incident_lookup(spark, sf):
    stored = spark.read.parquet(sinks.export_by_key(_incident_rows(_incidents(spark, sf)), _folder(spark, "incidents"), "incident_id"))
    return investigate.incident_by_id(stored, "INC-000007").select("incident_id", "src_ip", "start_time", "end_time", "risk_score", "explanation")


def _baseline_lookup(spark, sf):
    baselines = baseline.compute_baseline(fw_logs(spark, sf), ADAPTIVE)
    stored = spark.read.parquet(sinks.export_by_key(baselines, _folder(spark, "baselines"), "asset_key"))
    return _rounded(baseline.baseline_of(stored, "10.0.1.5"))


def _features(spark, sf):
    return features.build_features(fw_logs(spark, sf), CONFIG)


def _anomalies(spark, sf):
    return iforest.detect_anomalies(_features(spark, sf), CONFIG.ai_detection).scores


def _filtered(spark, sf):
    views = investigate.filter_views(fw_logs(spark, sf), *_found(spark, sf), SPEC)
    parts = [
        view.groupBy("src_ip").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("view"), "src_ip", "n")
        for name, view in zip(("logs", "alerts", "incidents"), views)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _with_alerts(build):
    def run(spark, sf):
        return build(fw_logs(spark, sf), *_found(spark, sf))

    return run


def _incident_rows(incidents: DataFrame) -> DataFrame:
    table = correlate.incidents_table(incidents)
    return table.withColumns({name: F.col(name).cast("bigint") for name in ("alert_count", "event_count", "risk_score")})


def _severities(spark, sf):
    rows = _alerts(spark, sf).groupBy("alert_type").agg(F.max("score_contribution").alias("score"))
    severity = severity_of(F.col("score"), CONFIG)
    return rows.select(
        "alert_type", F.col("score").cast("bigint").alias("score"), severity.alias("severity"),
        severity_rank(severity).cast("bigint").alias("severity_rank"),
    )


def _services(spark, sf):
    return fw_logs(spark, sf).groupBy(service_name(F.col("dst_port")).alias("service")).agg(F.count(F.lit(1)).alias("events"))


def _quantile_rows(spark, sf):
    logs = fw_logs(spark, sf)
    long = quantiles.quantiles(quantiles.histogram(logs, ["src_ip"], "bytes_sent"), ["src_ip"], [0.25, 0.5, 0.75, 0.99])
    return long.select("src_ip", "p", F.round("quantile", 3).alias("quantile"), "total")


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: incidents of the smallest data set, or of the folder in ENTRY_SF_DIR."""
    return _incident_rows(_incidents(spark, os.environ.get("ENTRY_SF_DIR", "/root/testdata/sf0.001")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    more = dict(LLM.QUERIES) if LLM else {}
    if PIPELINE:
        more["pipeline"] = PIPELINE.run
    return more | {
        "schema_mapping": _schema_mapping,
        "clean_logs": lambda s, d: _cleaned(s, d).logs.select(*CLEAN_COLUMNS),
        "csv_log": _read_back("csv"),
        "json_lines_log": _read_back("jsonl"),
        "cleaning_summary": lambda s, d: _cleaned(s, d).summary,
        "action_normalisation": lambda s, d: fw_logs(s, d).groupBy("action", "protocol").agg(
            F.count(F.lit(1)).alias("events")
        ),
        "service_names": _services,
        "top_source_ips": _with_alerts(lambda logs, a, i: _rounded(traffic.top_source_ips(logs, a, i, 10))),
        "top_destination_ports": lambda s, d: _rounded(traffic.top_destination_ports(fw_logs(s, d), 10)),
        "top_destination_ips": lambda s, d: _rounded(traffic.top_destination_ips(fw_logs(s, d), 10)),
        "asset_key": _asset_key,
        "source_quantiles": _quantile_rows,
        "asset_baseline": lambda s, d: _rounded(baseline.compute_baseline(fw_logs(s, d), ADAPTIVE)),
        "subnet_baseline": lambda s, d: _rounded(baseline.compute_baseline(fw_logs(s, d), SUBNETS)),
        "effective_thresholds": lambda s, d: _rounded(
            baseline.effective_thresholds(baseline.compute_baseline(fw_logs(s, d), ADAPTIVE), ADAPTIVE)
        ),
        "blocked_burst": lambda s, d: _shown(detect.detect_blocked_burst(fw_logs(s, d), CONFIG)),
        "port_scan": lambda s, d: _shown(detect.detect_port_scan(fw_logs(s, d), CONFIG)),
        "host_scan": lambda s, d: _shown(detect.detect_host_scan(fw_logs(s, d), CONFIG)),
        "large_transfer": lambda s, d: _shown(detect.detect_large_transfer(fw_logs(s, d), CONFIG)),
        "off_hours": _off_hours,
        "baseline_port_scan": lambda s, d: _shown(
            detect.detect_port_scan(fw_logs(s, d), ADAPTIVE, settled(baseline.compute_baseline(fw_logs(s, d), ADAPTIVE)))
        ),
        "subnet_large_transfer": lambda s, d: _shown(
            detect.detect_large_transfer(fw_logs(s, d), SUBNETS, baseline.compute_baseline(fw_logs(s, d), SUBNETS))
        ),
        "all_alerts": lambda s, d: _shown(_alerts(s, d)),
        "alert_severities": _severities,
        "incidents": lambda s, d: _incident_rows(_incidents(s, d)),
        "incident_scores": lambda s, d: _incident_rows(_incidents(s, d)).select(
            "incident_id", "risk_score", "severity", "score_breakdown"
        ),
        "behaviour_features": lambda s, d: _rounded(_features(s, d)),
        "baseline_features": lambda s, d: _rounded(
            features.build_features(fw_logs(s, d), ADAPTIVE, baseline.compute_baseline(fw_logs(s, d), ADAPTIVE))
        ),
        "feature_medians": lambda s, d: _rounded(explain.feature_medians(_features(s, d))),
        "anomaly_explanations": lambda s, d: explain.explain_anomalies(_features(s, d)).select(
            "src_ip", "window_start", "ai_explanation"
        ),
        "robust_scaling": lambda s, d: _rounded(
            iforest.robust_scale(_features(s, d)).select("src_ip", "window_start", *features.MODEL_FEATURES), 5
        ),
        "isolation_forest": lambda s, d: _rounded(iforest.ranked(_anomalies(s, d))),
        "anomaly_view": lambda s, d: _rounded(iforest.anomaly_view(_anomalies(s, d))),
        "anomaly_chart": lambda s, d: iforest.anomaly_chart(_anomalies(s, d)),
        "anomalies_at_threshold": lambda s, d: iforest.anomalies_only(iforest.flag_anomalies(_anomalies(s, d), 85)).select(
            "src_ip", "window_start", "ai_anomaly_score"
        ),
        "run_summary": _run_summary,
        "partial_mapping": _partial_mapping,
        "partial_alerts": _partial_alerts,
        "partial_features": lambda s, d: _rounded(features.build_features(_partial(s, d).logs, CONFIG)),
        "cleaned_columns": _cleaned_columns,
        "incident_labels": lambda s, d: investigate.incident_labels(_incidents(s, d)),
        "port_labels": lambda s, d: traffic.port_labels(traffic.top_destination_ports(fw_logs(s, d), 10)),
        "incident_view": lambda s, d: investigate.incident_view(_incident_rows(_incidents(s, d))),
        "incident_lookup": _incident_lookup,
        "baseline_lookup": _baseline_lookup,
        "destination_networks": lambda s, d: _cleaned(s, d).logs.groupBy(net.asset_key(F.col("dst_ip"), "subnet24", 24).alias("network")).agg(
            F.count(F.lit(1)).alias("events")
        ),
        "kpi_summary": _with_alerts(traffic.kpi_summary),
        "severity_histogram": lambda s, d: traffic.severity_histogram(_incidents(s, d)),
        "action_counts": lambda s, d: traffic.action_counts(fw_logs(s, d)),
        "events_over_time": lambda s, d: traffic.events_over_time(fw_logs(s, d)),
        "observed_counts": lambda s, d: traffic.observed_counts(fw_logs(s, d)),
        "date_domain": lambda s, d: traffic.date_domain(fw_logs(s, d)),
        "source_domain": lambda s, d: traffic.value_domain(fw_logs(s, d), "src_ip"),
        "filtered_views": _filtered,
        "alert_search": lambda s, d: investigate.search(detect.alerts_table(_alerts(s, d)), "SCAN").select(
            "alert_id", "alert_type", "src_ip"
        ),
        "evidence_fields": lambda s, d: investigate.alert_view(detect.alerts_table(_alerts(s, d))),
        "threshold_modes": lambda s, d: investigate.threshold_modes(detect.alerts_table(_alerts(s, d, ADAPTIVE))),
        "incident_alerts": _with_alerts(
            lambda logs, a, i: investigate.incident_alerts(a, i).select("incident_id", "alert_id", "timestamp", "alert_type")
        ),
        "incident_events": _with_alerts(lambda logs, a, i: investigate.incident_events(logs, i)),
        "incident_timeline": _with_alerts(investigate.incident_timeline),
        "recommendation_items": lambda s, d: investigate.recommendation_items(_incidents(s, d)),
        "report_cleaning_table": lambda s, d: report_tables.cleaning_table(_cleaned(s, d).summary).select("item", "value"),
        "report_top_incidents": lambda s, d: report_tables.top_incidents(_incident_rows(_incidents(s, d))),
        "report_first_alerts": lambda s, d: report_tables.first_alerts(_alerts(s, d)),
        "report_sources": _with_alerts(lambda logs, a, i: report_tables.report_sources(_rounded(traffic.top_source_ips(logs, a, i)))),
        "report_ports": lambda s, d: report_tables.report_ports(_rounded(traffic.top_destination_ports(fw_logs(s, d)))),
        "report_destinations": lambda s, d: report_tables.report_destinations(
            _rounded(traffic.top_destination_ips(fw_logs(s, d)))
        ),
        "incident_cards": lambda s, d: report_tables.incident_cards(_incidents(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    more = dict(LLM.ORACLES) if LLM else {}
    if PIPELINE and PIPELINE.ORACLE_SQL:
        more["pipeline"] = PIPELINE.ORACLE_SQL
    return more | oracles.statements()
