from dataclasses import replace
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fwlens.config import AnomalyModel, Config, WorkingHours
from fwlens.operators import iforest
from fwlens.operators.baseline import compute_baseline
from fwlens.operators.explain import FALLBACK_TEXT, explain_anomalies, feature_medians
from fwlens.operators.features import BASELINE_FEATURES, MODEL_FEATURES, build_features
from tests.conftest import EVENT_SCHEMA, START

MODEL = AnomalyModel(n_estimators=50, contamination=0.05)


def windows(spark, n=20, outlier=True, **extra):
    rows = []
    for i in range(n):
        row = {name: 1.0 for name in MODEL_FEATURES}
        row["off_hours_indicator"] = 0.0
        if outlier and i == n - 1:
            row.update(connection_count=1000.0, unique_dst_ips=500.0, unique_dst_ports=500.0, bytes_sent_total=1e7)
        rows.append((f"10.0.0.{i}", START + timedelta(minutes=5 * i), *row.values(), *extra.values()))
    kinds = ", ".join(f"{name} double" for name in MODEL_FEATURES) + "".join(f", {name} boolean" for name in extra)
    return spark.createDataFrame(rows, f"src_ip string, window_start timestamp_ntz, {kinds}")


def test_features_by_window(events, config):
    rows = [(60, {"dst_port": 1}), (240, {"dst_port": 2, "action": "ALLOW", "protocol": "UDP", "bytes_sent": 50}), (360, {})]
    found = build_features(events(rows), config).orderBy("window_start").collect()
    assert [r.connection_count for r in found] == [2, 1]
    first = found[0]
    assert (first.blocked_count, first.blocked_ratio, first.unique_dst_ports, first.unique_dst_ips) == (1, 0.5, 2, 1)
    assert (first.bytes_sent_total, first.average_bytes_sent, first.tcp_ratio, first.udp_ratio) == (150, 75.0, 0.5, 0.5)
    assert (first.activity_hour, first.off_hours_indicator, first.has_reliable_normal_label) == (9, 0, False)


def test_missing_columns_and_labels(spark, events, config):
    bare = build_features(events([(0, {}), (1, {})]).select("timestamp", "src_ip"), config).first()
    assert (bare.connection_count, bare.blocked_ratio, bare.tcp_ratio, bare.unique_dst_ips) == (2, 0.0, 0.0, 0)
    labelled = events([(0, {}), (1, {}), (400, {})]).withColumn("label", F.when(F.col("row_id") == 2, "attack").otherwise(" Normal "))
    assert [r.has_reliable_normal_label for r in build_features(labelled, config).orderBy("window_start").collect()] == [True, False]
    assert build_features(spark.createDataFrame([], EVENT_SCHEMA), config).isEmpty()


@pytest.mark.parametrize("start,end,flags", [(5, 24, [1, 0, 0]), (22, 6, [0, 1, 0]), (8, 18, [1, 0, 1])])
def test_off_hours_flag(events, config, start, end, flags):
    hours = replace(config, working_hours=WorkingHours(start, end))
    rows = [((h - 9) * 3600, {}) for h in (3, 10, 23)]
    assert [r.off_hours_indicator for r in build_features(events(rows), hours).orderBy("window_start").collect()] == flags


def test_baseline_ratios(events, config):
    logs = events([(i, {"src_ip": "a", "dst_port": i % 4}) for i in range(60)])
    baselines = compute_baseline(logs, config)
    both = build_features(logs.unionByName(events([(0, {"src_ip": "new"})])), config, baselines)
    found = {r.src_ip: r for r in both.collect()}
    assert set(BASELINE_FEATURES) <= set(both.columns)
    assert found["a"].connection_count_vs_baseline_ratio == 1.0 and found["a"].unique_ports_vs_baseline_ratio == 1.0
    assert found["new"].connection_count_vs_baseline_ratio == 1.0


def test_outlier_ranks_first_and_runs_agree(spark):
    features = windows(spark)
    first = iforest.detect_anomalies(features, MODEL)
    second = iforest.detect_anomalies(features.repartition(7), MODEL)
    rows = iforest.ranked(first.scores).collect()
    assert rows[0].src_ip == "10.0.0.19" and rows[0].isolation_forest_prediction == -1 and rows[0].is_ai_anomaly
    assert rows[0].ai_anomaly_score == 100.0 and all(0 <= r.ai_anomaly_score <= 100 for r in rows)
    assert [r.raw_anomaly_score for r in rows] == [r.raw_anomaly_score for r in iforest.ranked(second.scores).collect()]
    assert first.training_strategy == "all_loaded_windows"
    assert "Outgoing data volume is 10000000.0 times" in rows[0].ai_explanation


def test_too_few_windows(spark):
    result = iforest.detect_anomalies(windows(spark, 2), MODEL)
    assert result.warning == iforest.TOO_FEW and result.scores.filter("ai_anomaly_score IS NOT NULL").isEmpty()
    assert iforest.anomalies_only(result.scores).isEmpty()


def test_labelled_windows_train_the_model(spark):
    result = iforest.detect_anomalies(windows(spark, 10, has_reliable_normal_label=True), MODEL)
    assert result.training_strategy == "labelled_normal_windows" and "10 windows" in result.warning


def test_threshold_can_change_without_a_fit(spark):
    scores = iforest.detect_anomalies(windows(spark), MODEL).scores
    assert iforest.anomalies_only(iforest.flag_anomalies(scores, 100.0)).count() == 1
    assert iforest.anomaly_view(scores).count() == 1
    assert iforest.anomaly_view(iforest.flag_anomalies(scores, 101.0)).count() == 20
    assert iforest.anomaly_chart(scores, 3).first().window_label == "10.0.0.19 | 2026-07-01 10:35:00"


def test_disabled(spark):
    assert iforest.disabled_anomalies(spark).columns == ["src_ip", "window_start", "ai_anomaly_score", "is_ai_anomaly", "ai_explanation"]


def test_explanations_follow_the_medians(spark):
    rows = explain_anomalies(windows(spark, 9)).orderBy("src_ip").collect()
    assert rows[0].ai_explanation == FALLBACK_TEXT
    assert rows[8].ai_explanation == (
        "Outgoing data volume is 10000000.0 times higher than the dataset median (1e+07 vs 1). Connection count is 1000.0 times"
        " higher than the dataset median (1000 vs 1). Number of destination ports is 500.0 times higher than the dataset median"
        " (500 vs 1)."
    )
    assert feature_medians(windows(spark, 9)).first()["connection_count"] == 1.0


def test_zero_median_and_off_hours(spark):
    flat = windows(spark, 5, outlier=False).withColumns({"blocked_ratio": F.lit(0.0)})
    odd = flat.withColumn("blocked_ratio", F.when(F.col("src_ip") == "10.0.0.4", 0.75).otherwise(0.0)).withColumn("off_hours_indicator", F.lit(1.0))
    texts = {r.src_ip: r.ai_explanation for r in explain_anomalies(odd).collect()}
    assert texts["10.0.0.4"] == (
        "Activity occurred outside the configured working hours. Blocked-connection ratio is 1.8 times higher than the dataset"
        " median (0.75 vs 0)."
    )


def test_forest_config_default():
    assert Config().ai_detection.n_estimators == 200


def test_samples_and_trees_depend_on_rows_and_seed_alone(spark):
    rows = windows(spark, n=60)
    model = replace(MODEL, sample_size=16)
    first = {r.src_ip: r.raw_anomaly_score for r in iforest.detect_anomalies(rows.repartition(5), model).scores.collect()}
    again = {r.src_ip: r.raw_anomaly_score for r in iforest.detect_anomalies(rows.repartition(2), model).scores.collect()}
    other = {r.src_ip: r.raw_anomaly_score for r in iforest.detect_anomalies(rows, replace(model, random_state=7)).scores.collect()}
    assert first == again and len(first) == 60 and max(first, key=first.get) == max(other, key=other.get) == "10.0.0.59"


def test_draws_are_even():
    """Sums of products of a ticket: each tree takes about its share, and two trees rarely take the same rows."""
    import numpy as np

    rng = np.random.default_rng(5)
    one, two = rng.integers(0, iforest.PRIME, (2, 20_000))
    draws = [(one * a % iforest.PRIME + two * b % iforest.PRIME + c) % iforest.PRIME for a, b, c in iforest.tree_factors(42, 20)]
    taken = [set(np.flatnonzero(d < iforest.PRIME // 50).tolist()) for d in draws]
    assert all(330 < len(t) < 470 for t in taken)
    assert max(len(a & b) for i, a in enumerate(taken) for b in taken[:i]) < 30
