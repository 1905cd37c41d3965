from dataclasses import replace

import numpy as np
import pytest

from fwlens.config import Baselining
from fwlens.operators.baseline import baseline_of, compute_baseline, effective_thresholds
from tests.conftest import EVENT_SCHEMA


@pytest.fixture
def adaptive(config):
    return replace(config, baselining=Baselining(True, "src_ip", 24, 50, 2.0, 5))


def test_medians_spreads_and_quantile(events, adaptive):
    counts = [1, 2, 2, 2, 9]
    rows = [(w * 300 + i, {"dst_port": 100 + i, "bytes_sent": 10 * i}) for w, n in enumerate(counts) for i in range(n)]
    row = compute_baseline(events(rows), adaptive).first()
    sizes = [10 * i for n in counts for i in range(n)]
    assert (row.event_count, row.unique_ports_median, row.unique_ports_mad) == (16, 2.0, 0.0)
    assert row.unique_dsts_median == 1.0 and row.bytes_sent_p95 == pytest.approx(np.quantile(sizes, 0.95))


def test_sparse_assets_keep_the_global_threshold(events, adaptive):
    rows = [(i * 10, {"src_ip": "few"}) for i in range(10)] + [(i * 10, {"src_ip": "many", "dst_port": i % 7}) for i in range(200)]
    baselines = compute_baseline(events(rows), adaptive)
    found = {(r.asset_key, r.metric): r for r in effective_thresholds(baselines, adaptive).collect()}
    assert found["few", "unique_ports"].threshold == 20 and found["few", "unique_ports"].asset_baseline_value is None
    assert found["many", "unique_ports"].threshold_source == "per_asset_baseline"
    assert found["many", "unique_ports"].threshold == 14.0
    assert baseline_of(baselines, "few").count() == 1 and baseline_of(baselines, "none").count() == 0


def test_subnets_share_a_key_and_detectors_use_it(events, adaptive):
    subnet = replace(adaptive, baselining=replace(adaptive.baselining, group_by="subnet24"))
    rows = [(i * 10, {"src_ip": f"10.0.0.{1 + i % 2}"}) for i in range(60)]
    baselines = compute_baseline(events(rows), subnet).collect()
    assert [(b.asset_key, b.event_count) for b in baselines] == [("10.0.0.0/24", 60)]


def test_empty_history_has_the_schema(spark, adaptive):
    empty = compute_baseline(spark.createDataFrame([], EVENT_SCHEMA), adaptive)
    assert empty.isEmpty() and "bytes_sent_p95" in empty.columns
