import json
from dataclasses import replace
from datetime import timedelta

import pytest

from fwlens.config import AnomalyModel, Config
from fwlens.plans.job import parse_args
from fwlens.plans.analysis import run_job
from tests.conftest import START


def write_log(path):
    rows = ["Generated Time,Source address,Destination address,Source Port,Destination Port,Protocol,Action,Bytes Sent,Bytes Received,label"]
    for i in range(60):
        rows.append(f"{START + timedelta(seconds=i)},10.0.0.1,192.0.2.{i},5000,22,tcp,deny,100,0,attack")
    for i in range(40):
        rows.append(f"{START + timedelta(minutes=5 * i)},10.0.0.{i % 4 + 2},192.0.2.9,5000,443,tcp,allow,{100 + i},10,normal")
    rows.append(f"{START},10.0.0.9,192.0.2.9,5000,443,tcp,allow,20000000,10,normal")
    rows += [rows[-1], "bad,10.0.0.9,192.0.2.9,5000,443,tcp,allow,1,1,normal"]
    path.write_text("\n".join(rows) + "\n")


def read(spark, path):
    return spark.read.option("header", True).option("escape", '"').csv(path)


def test_job_writes_every_result(spark, tmp_path):
    log = tmp_path / "log.csv"
    write_log(log)
    config = replace(Config(), ai_detection=AnomalyModel(n_estimators=20))
    paths = run_job(spark, str(log), str(tmp_path / "out"), config)
    alerts = read(spark, paths["alerts"]).collect()
    assert [a.alert_type for a in sorted(alerts, key=lambda a: a.alert_id)] == [
        "Large outbound transfer", "Host scan", "Repeated blocked connections",
    ]
    assert json.loads(alerts[0].evidence)
    incidents = read(spark, paths["incidents"])
    assert {r.alert_types for r in incidents.collect()} == {"Large outbound transfer", "Host scan, Repeated blocked connections"}
    summary = read(spark, paths["run_summary"]).first()
    assert (summary.input_rows, summary.cleaned_rows, summary.alerts_detected, summary.incidents_created) == ("103", "101", "3", "2")
    assert (summary.duplicate_rows_removed, summary.invalid_timestamps, summary.most_active_source_ip) == ("1", "1", "10.0.0.1")
    assert summary.most_frequent_destination_port == "22" and summary.skipped_detectors in ("", None, '""')
    assert read(spark, paths["cleaned"]).count() == 101
    for name in ("anomalies", "top_source_ips", "top_destination_ports", "top_destination_ips", "cleaning_summary", "incident_cards"):
        assert read(spark, paths[name]).columns


def test_job_with_few_columns_and_without_model(spark, tmp_path):
    log = tmp_path / "log.json"
    log.write_text(json.dumps([{"event_time": "2026-07-01 09:00:00", "source_ip": "10.0.0.1", "verdict": "deny"}]))
    config = replace(Config(), ai_detection=AnomalyModel(enabled=False)).with_baselining(True)
    paths = run_job(spark, str(log), str(tmp_path / "out"), config)
    assert read(spark, paths["alerts"]).count() == 0 and read(spark, paths["anomalies"]).columns[-1] == "ai_explanation"
    summary = read(spark, paths["run_summary"]).first()
    assert summary.skipped_detectors.count(",") == 4 and summary.baselining_enabled == "true" and summary.ai_anomalies == "0"


def test_arguments():
    args = parse_args(["--input", "x.csv", "--no-baseline"])
    assert (args.input, args.output, args.baselining) == ("x.csv", "outputs", False)


def test_job_over_records_that_span_lines_and_broken_ones(spark, tmp_path):
    log = tmp_path / "log.csv"
    write_log(log)
    log.write_text(log.read_text().replace(",attack\n", ',"two\nlines"\n', 1))
    config = replace(Config(), ai_detection=AnomalyModel(enabled=False))
    paths = run_job(spark, str(log), str(tmp_path / "lines"), config, multi_line=True)
    assert spark.read.parquet(paths["cleaned_columns"]).filter("label = 'two\nlines'").count() == 1
    write_log(log)
    log.write_text(log.read_text() + "2026-07-01,10.0.0.1,a,1,2,tcp,allow,1,1,normal,surplus\n")
    with pytest.raises(ValueError, match="not valid: .*surplus"):
        run_job(spark, str(log), str(tmp_path / "broken"), config)
    paths = run_job(spark, str(log), str(tmp_path / "kept"), config, keep_rejected=True)
    assert [r.record.endswith("surplus") for r in spark.read.parquet(paths["rejected"]).collect()] == [True]
    summary = read(spark, paths["run_summary"]).first()
    assert (summary.input_rows, summary.cleaned_rows) == ("103", "101")
    log.write_bytes(log.read_bytes() + b"2026-07-01,10.0.0.1,a,1,2,tcp,allow,1,1,caf\xe9\n")
    with pytest.raises(ValueError, match="UTF-8"):
        run_job(spark, str(log), str(tmp_path / "latin"), config, check_utf8=True, keep_rejected=True)
    flags = parse_args(["--input", "x", "--multi-line", "--keep-rejected"])
    assert (flags.multi_line, flags.keep_rejected, flags.check_utf8) == (True, True, False)
