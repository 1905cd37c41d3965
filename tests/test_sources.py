import io
import json
from contextlib import redirect_stdout
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fwlens.config import Config, config_from_dict, load_config
from fwlens.operators.baseline import baseline_of
from fwlens.sources import sinks
from fwlens.sources.readers import format_of, input_errors, load_logs, rejected_records
from fwlens.sources.schema_map import dataset_findings, map_log_schema, require_dataset, spellings


def test_csv_is_text_and_null_tokens_are_null(spark, tmp_path):
    file = tmp_path / "log.CSV"
    file.write_text('timestamp,src_ip,note\n2026-07-01 09:00:00,10.0.0.1,"a ""b"""\n2026-07-01 09:00:01,N/A,\n')
    rows = load_logs(spark, str(file)).collect()
    assert [tuple(r) for r in rows] == [("2026-07-01 09:00:00", "10.0.0.1", 'a "b"'), ("2026-07-01 09:00:01", None, None)]


@pytest.mark.parametrize("name,lines", [("log.json", False), ("log.jsonl", True), ("log.ndjson", True)])
def test_json_forms(spark, tmp_path, name, lines):
    records = [{"event_time": "2026-07-01T09:00:00", "source_ip": "10.0.0.1"}, {"event_time": "x", "source_ip": "b"}]
    file = tmp_path / name
    file.write_text("\n".join(map(json.dumps, records)) if lines else json.dumps(records))
    assert load_logs(spark, str(file)).count() == 2


def test_input_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_logs(spark, str(tmp_path / "absent.csv"))
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    with pytest.raises(ValueError, match="is empty"):
        load_logs(spark, str(empty))
    header = tmp_path / "header.csv"
    header.write_text("timestamp,src_ip\n")
    with pytest.raises(ValueError, match="no rows"):
        load_logs(spark, str(header))
    broken = tmp_path / "broken.json"
    broken.write_text('[{"a": 1}, {"a": ')
    with pytest.raises(ValueError, match="not valid"):
        load_logs(spark, str(broken))
    latin = tmp_path / "latin.csv"
    latin.write_bytes("timestamp,src_ip\n2026,caf\xe9\n".encode("latin-1"))
    assert load_logs(spark, str(latin)).count() == 1
    with pytest.raises(ValueError, match="UTF-8"):
        load_logs(spark, str(latin), check_utf8=True)
    with pytest.raises(ValueError, match="Unsupported"):
        format_of("log.txt")


def test_alternate_names_are_mapped(spark):
    df = spark.createDataFrame(
        [("2026-07-01 09:00:00", "10.0.0.1", "192.0.2.1", "1", "22", "tcp", "deny", "5", "6", "kept")],
        ["event_time", "source_address", "destination_address", "source_port", "destination_port", "transport_protocol",
         "verdict", "bytes_out", "bytes_in", "extra"],
    )
    mapping = map_log_schema(df)
    row = mapping.df.first()
    assert (row.src_ip, row.dst_port, row.action, row.bytes_sent, row.extra) == ("10.0.0.1", "22", "deny", "5", "kept")
    assert row.source_address == "10.0.0.1" and mapping.unavailable == ()


def test_vendor_headers_and_name_collisions(spark):
    df = spark.createDataFrame([("2026/07/26 09:25:27", "10.0.0.1", "allow")], ["Generated Time", "Source address", "Action"])
    mapping = map_log_schema(df)
    row = mapping.df.first()
    assert row["Source address"] == "10.0.0.1" and row.action == "allow" and row["src__Action"] == "allow"
    assert row.protocol == "UNKNOWN" and row.bytes_sent == 0 and row.dst_port is None
    assert set(mapping.unavailable) == {"dst_ip", "src_port", "dst_port", "protocol", "bytes_sent", "bytes_received"}


def test_required_fields_and_aliases(spark):
    with pytest.raises(ValueError, match="required log fields: src_ip"):
        map_log_schema(spark.createDataFrame([("x",)], ["event_time"]))
    with pytest.raises(ValueError, match="Dataset is missing"):
        map_log_schema(None)
    table = spellings({"action": [" Policy ", "", "action"]})
    assert [table[name]["action"] for name in ("action", "policy", "verdict")] == [0, 1, 5] and "" not in table
    best = map_log_schema(spark.createDataFrame([("t", "s", "v", "p")], ["time", "src", "verdict", "policy"]), {"action": ["Policy"]})
    assert best.mapped["action"] == "policy"
    mapped = map_log_schema(spark.createDataFrame([("t", "s", "p")], ["time", "src", "policy"]), {"action": ["Policy"]})
    assert mapped.mapped["action"] == "policy"


def test_validation(spark):
    df = spark.createDataFrame([("a", "b")], ["timestamp", "src_ip"])
    assert dataset_findings(df, ["timestamp"]) == []
    assert dataset_findings(None) == ["Dataset is missing."]
    with pytest.raises(ValueError, match="Missing required columns: dst_ip"):
        require_dataset(df, ["dst_ip"])
    with pytest.raises(ValueError, match="Duplicate columns"):
        require_dataset(df.toDF("timestamp", "timestamp"), ["timestamp"])
    with pytest.raises(ValueError, match="empty"):
        require_dataset(df.limit(0))


def test_config_falls_back_to_safe_values(tmp_path):
    file = tmp_path / "config.yaml"
    file.write_text(
        "ai_detection: {window_minutes: 0, n_estimators: bad, contamination: 2, random_state: -1, anomaly_threshold: 900}\n"
        "analytics: {top_n: 0}\nworking_hours: {start_hour: -1, end_hour: 99}\n"
        "baselining: {enabled: true, group_by: planet, min_history_events: 7}\n"
    )
    config = load_config(file)
    model = config.ai_detection
    assert (model.window_minutes, model.n_estimators, model.contamination) == (5, 200, 0.02)
    assert (model.random_state, model.anomaly_threshold, config.top_n) == (42, 60, 10)
    assert (config.working_hours.start_hour, config.working_hours.end_hour) == (5, 24)
    assert config.baselining.enabled and config.baselining.group_by == "src_ip" and config.baselining.min_history_events == 7
    assert config_from_dict({}).brute_force == Config().brute_force
    with pytest.raises(FileNotFoundError):
        load_config(tmp_path / "absent.yaml")


def test_empty_export_keeps_its_header(spark, tmp_path):
    path = sinks.export_csv(spark.createDataFrame([], "a int, b array<string>"), str(tmp_path / "x.csv"))
    assert spark.read.option("header", True).csv(path).columns == ["a", "b"]


def test_parquet_export_keeps_types_and_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"]), (2, [])], "day int, items array<string>")
    path = sinks.export_parquet(df, str(tmp_path / "t.parquet"), ("day",))
    assert load_logs(spark, path).filter("day = 1").first()["items"] == ["a"]


def test_records_with_too_many_cells(spark, tmp_path):
    """A late broken record is the input's error, or is kept apart with its file; short records lack their last cells."""
    for part in range(2):
        lines = ["timestamp,src_ip,note"] + [f"2026-07-01 09:{i // 60 % 60:02d}:{i % 60:02d},10.0.{part}.{i % 200},x" for i in range(3000)]
        lines[2900] = "2026-07-01 09:00:00,10.0.0.1" if part else '2026-07-01 09:00:00,10.0.0.1,"a,b",surplus'
        (tmp_path / f"part{part}.csv").write_text("\n".join(lines) + "\n")
    path = str(tmp_path / "*.csv")
    with pytest.raises(ValueError, match=r"not valid: .*part0\.csv: .*surplus"):
        with input_errors():
            load_logs(spark, path).write.format("noop").mode("overwrite").save()
    kept = load_logs(spark, path, keep_rejected=True)
    assert kept.columns == ["timestamp", "src_ip", "note"] and kept.count() == 5999 and kept.filter("note IS NULL").count() == 1
    rejected = [tuple(r) for r in rejected_records(spark, path).collect()]
    assert [record for _, record in rejected] == ['2026-07-01 09:00:00,10.0.0.1,"a,b",surplus'] and rejected[0][0].endswith("part0.csv")


def test_broken_json_lines(spark, tmp_path):
    file = tmp_path / "log.jsonl"
    rows = [json.dumps({"event_time": "2026-07-01T09:00:00", "source_ip": f"10.0.0.{i}"}) for i in range(50)]
    file.write_text("\n".join([*rows, '{"event_time": ', ""]))
    with pytest.raises(ValueError, match="not valid"):
        with input_errors():
            load_logs(spark, str(file)).write.format("noop").mode("overwrite").save()
    assert load_logs(spark, str(file), keep_rejected=True).count() == 50
    assert [r.record for r in rejected_records(spark, str(file)).collect()] == ['{"event_time": ']


def test_columns_of_the_clean_log_are_in_time_order(spark, tmp_path):
    rows = [(datetime(2026, 7, 1 + i % 3, i % 24), i) for i in range(200)]
    path = sinks.export_cleaned_columns(spark.createDataFrame(rows, "timestamp timestamp_ntz, row_id bigint"), str(tmp_path))
    files = sorted((tmp_path / "cleaned").rglob("*.parquet"))
    assert spark.read.parquet(path).count() == 200 and spark.read.parquet(path).filter("event_date = '2026-07-02'").count() == 67
    for file in (f for f in files if f.is_file()):
        times = [r.timestamp for r in spark.read.parquet(str(file)).collect()]
        assert times == sorted(times)


def test_look_up_by_key_is_pushed(spark, tmp_path):
    path = sinks.export_by_key(spark.range(1000).select(F.format_string("10.0.0.%d", "id").alias("asset_key"), "id"), str(tmp_path / "b.parquet"), "asset_key")
    found = baseline_of(spark.read.parquet(path), "10.0.0.77")
    assert found.first().id == 77
    shown = io.StringIO()
    with redirect_stdout(shown):
        found.explain("formatted")
    assert "EqualTo(asset_key,10.0.0.77)" in shown.getvalue()
