"""Trailing windows against plain loops, with tied times and several thresholds."""

import io
import random
import re
from contextlib import redirect_stdout
from collections import defaultdict
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from fwlens.config import Config
from fwlens.functions.columns import micros
from fwlens.operators.baseline import ThresholdRule
from fwlens.operators.windows import (
    combined_rows, first_count_window, first_distinct_window, id_order, numbered, rows_of_windows, with_time,
)
from tests.conftest import START

SECOND = 1_000_000


def random_rows(seed, n, sources, values, span):
    rng = random.Random(seed)
    return [
        (rng.randrange(span), f"s{int(sources * rng.random() ** 2)}", rng.randrange(values), i) for i in range(n)
    ]


def frame(spark, rows, window_us):
    data = [(START + timedelta(seconds=t), s, v, i) for t, s, v, i in rows]
    df = spark.createDataFrame(data, "timestamp timestamp_ntz, src_ip string, value int, row_id bigint")
    return with_time(df, window_us)


def by_source(rows):
    groups = defaultdict(list)
    for t, s, v, i in rows:
        groups[s].append((t, i, v))
    return {s: sorted(g) for s, g in groups.items()}


def count_trigger(group, threshold, width):
    for t in sorted({t for t, _, _ in group}):
        if sum(t - width < u <= t for u, _, _ in group) >= threshold:
            return t
    return None


def distinct_trigger(group, threshold, width):
    left = 0
    for right, (t, _, _) in enumerate(group):
        while t - group[left][0] > width:
            left += 1
        if len({v for _, _, v in group[left:right + 1]}) >= threshold:
            return t, right - left + 1, group[right][1]
    return None


@pytest.mark.parametrize("threshold,width,span", [(3, 10, 400), (5, 30, 900), (8, 60, 900), (1, 7, 300)])
def test_count_window(spark, threshold, width, span):
    rows = random_rows(threshold, 1500, 40, 5, span)
    rule = ThresholdRule("blocked_rate", threshold, Config())
    hits = first_count_window(frame(spark, rows, width * SECOND), width * SECOND, rule)
    origin = spark.range(1).select(micros(F.lit(START)).alias("u")).first().u
    found = {r.src_ip: (r.trigger_us - origin) // SECOND for r in hits.collect()}
    expected = {s: count_trigger(g, threshold, width) for s, g in by_source(rows).items()}
    assert found == {s: t for s, t in expected.items() if t is not None}
    assert found


@pytest.mark.parametrize("threshold,width,span,values", [(4, 10, 300, 30), (6, 30, 900, 12), (9, 60, 900, 15), (1, 5, 200, 4)])
def test_distinct_window(spark, threshold, width, span, values):
    rows = random_rows(threshold * 7, 1800, 40, values, span)
    data = frame(spark, rows, width * SECOND)
    rule = ThresholdRule("unique_ports", threshold, Config())
    hits = first_distinct_window(data, "value", width * SECOND, rule)
    inside = rows_of_windows(data, hits, width * SECOND, closed_left=True).drop("timestamp")
    kept = combined_rows(inside, ["value"], "value")
    origin = spark.range(1).select(micros(F.lit(START)).alias("u")).first().u
    found = {
        r.src_ip: ((r.t - origin) // SECOND, r.n, r.d)
        for r in kept.groupBy("src_ip").agg(
            F.max("trigger_us").alias("t"), F.sum("n").alias("n"), F.countDistinct("value").alias("d")
        ).collect()
    }
    expected = {}
    for source, group in by_source(rows).items():
        hit = distinct_trigger(group, threshold, width)
        if hit:
            expected[source] = (hit[0], hit[1], threshold)
    assert found == expected
    assert found


def test_left_edge_is_open_for_counts_and_closed_for_distinct_values(spark):
    rows = [(0, "a", 1, 0), (10, "a", 2, 1)]
    data = frame(spark, rows, 10 * SECOND)
    assert first_count_window(data, 10 * SECOND, ThresholdRule("blocked_rate", 2, Config())).count() == 0
    assert first_distinct_window(data, "value", 10 * SECOND, ThresholdRule("unique_ports", 2, Config())).count() == 1


def test_threshold_per_source(spark):
    rows = [(t, s, t, i) for i, (t, s) in enumerate((t, s) for s in ("a", "b") for t in range(6))]
    data = frame(spark, rows, 60 * SECOND)
    usual = spark.createDataFrame([("a", 100, 2.0), ("b", 100, 9.0)], "asset_key string, event_count bigint, unique_ports_median double")
    rule = ThresholdRule("unique_ports", 3, Config().with_baselining(True), usual)
    hits = first_distinct_window(data, "value", 60 * SECOND, rule).collect()
    assert [(h.src_ip, h.threshold, h.threshold_source, h.asset_baseline_value) for h in hits] == [("a", 6, "per_asset_baseline", 2.0)]


def test_surplus_values_go_before_the_shuffle_with_baselines(spark):
    """The largest threshold of the run bounds what each (source, slot) may send."""
    # one hot slot with far more distinct values than any threshold asks for
    rows = [(t % 50, "hot", t, t) for t in range(4000)] + [(t, "calm", t, 9000 + t) for t in range(6)]
    data = frame(spark, rows, 60 * SECOND)
    usual = spark.createDataFrame([("hot", 100, 4.0), ("calm", 100, 9.0)], "asset_key string, event_count bigint, unique_ports_median double")
    config = Config().with_baselining(True)
    rule = ThresholdRule("unique_ports", 3, config, usual)
    factor = config.baselining.deviation_multiplier
    assert rule.bound == int(9 * factor)
    hits = first_distinct_window(data, "value", 60 * SECOND, rule)
    assert [(h.src_ip, h.threshold) for h in hits.collect()] == [("hot", int(4 * factor))]
    shown = io.StringIO()
    with redirect_stdout(shown):
        hits.explain("simple")
    limits = re.findall(r"WindowGroupLimit .*, (\d+), \w+", shown.getvalue())
    assert limits and set(limits) == {str(rule.bound)}, limits


def test_numbering(spark):
    df = spark.range(500).select((F.col("id") % 7).alias("a"), (F.col("id") % 5).alias("b"), "id")
    rows = numbered(df, ("a", "b", "id"), "place").orderBy("a", "b", "id").collect()
    assert [r.place for r in rows] == list(range(1, 501))


def test_numbers_of_sources_that_begin_alike(spark):
    sources = [f"2001:db8::{i:x}" for i in range(3000)]
    df = spark.createDataFrame([(s, i % 3) for i, s in enumerate(sources * 2)], "src_ip string, anchor int")
    placed = numbered(df, ("src_ip", "anchor"), "place")
    rows = sorted((r.src_ip, r.anchor, r.place) for r in placed.collect())
    assert [place for *_, place in rows] == list(range(1, 6001))


def test_ids_sort_by_number_past_a_million(spark):
    ids = ["ALT-1000000", "ALT-000002", "ALT-999999", "ALT-1000001", "ALT-010000"]
    found = spark.createDataFrame([(i,) for i in ids], "alert_id string").orderBy(*id_order("alert_id")).collect()
    assert [r.alert_id for r in found] == ["ALT-000002", "ALT-010000", "ALT-999999", "ALT-1000000", "ALT-1000001"]
