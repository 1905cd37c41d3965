from pyspark.sql import functions as F

from fwlens.operators.clean import clean_logs
from fwlens.sources.schema_map import map_log_schema

NAMES = ("timestamp", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "action", "bytes_sent", "bytes_received", "label")
GOOD = dict(zip(NAMES, ("2026-07-01 09:00:00", "10.0.0.1", "192.0.2.1", "50000", "443", "tcp", "ACCEPT", "1000", "2000", "normal")))


def cleaned(spark, *changes):
    rows = [tuple({**GOOD, **change}.values()) for change in changes]
    result = clean_logs(map_log_schema(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in NAMES))))
    return result.logs.collect(), result.summary.first().asDict()


def test_each_invalid_cell_is_counted_and_dropped(spark):
    rows, summary = cleaned(
        spark, {}, {"timestamp": "bad"}, {"src_ip": "999.1.1.1"}, {"dst_port": "70000"}, {"bytes_sent": "-1"},
        {"src_port": "x", "dst_ip": "nowhere"}, {"label": None},
    )
    assert len(rows) == 2
    assert summary == {
        "original_row_count": 7, "final_row_count": 2, "duplicate_rows_removed": 0, "invalid_timestamps": 1,
        "invalid_ip_addresses": 2, "invalid_ports": 2, "missing_values": 1, "invalid_bytes": 1,
    }


def test_duplicates_and_normalisation(spark):
    rows, summary = cleaned(spark, {"action": "deny"}, {"action": "deny"}, {"dst_port": "22.9", "src_ip": " 10.0.0.2\t"})
    assert summary["duplicate_rows_removed"] == 1 and summary["final_row_count"] == 2
    by_source = {r.src_ip: r for r in rows}
    assert by_source["10.0.0.1"].action == "BLOCK" and by_source["10.0.0.1"].protocol == "TCP"
    assert by_source["10.0.0.2"].dst_port == 22
    assert len({r.row_id for r in rows}) == 2


def test_only_supplied_columns_are_checked(spark):
    df = spark.createDataFrame([("2026-07-01 09:00:00", "10.0.0.1", "allow")], ["timestamp", "src_ip", "action"])
    result = clean_logs(map_log_schema(df))
    row = result.logs.first()
    assert row.dst_ip is None and row.dst_port is None and row.bytes_sent == 0 and row.protocol == "UNKNOWN"
    # three absent columns are NULL placeholders
    assert result.summary.first()["missing_values"] == 3


def test_a_renamed_column_counts_its_gaps_twice(spark):
    df = spark.createDataFrame([("2026-07-01", "10.0.0.1", None), ("2026-07-01", "10.0.0.1", "5")], "time string, src string, proto string")
    assert clean_logs(map_log_schema(df)).summary.first()["missing_values"] == 2 + 2 * 3


def test_materialized_rows_keep_summary_and_logs(spark, tmp_path):
    rows = [tuple({**GOOD, **change}.values()) for change in ({}, {"timestamp": "bad"}, {"src_ip": "x"}, {})]
    lazy = clean_logs(map_log_schema(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in NAMES))))
    stored = lazy.materialized(str(tmp_path / "flagged"))
    assert stored.summary.first() == lazy.summary.first()
    assert stored.logs.select("src_ip", "row_id").collect() == lazy.logs.select("src_ip", "row_id").collect()
    assert set(stored.logs.columns) == set(lazy.logs.columns)
    assert stored.logs.filter(F.col("timestamp").isNull()).count() == 0
