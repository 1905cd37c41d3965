"""Order of the exported tables."""

from dataclasses import replace

from fwlens.config import AnomalyModel, Config
from fwlens.plans.analysis import run_job


def test_exports_are_in_order(spark, tmp_path):
    log = tmp_path / "log.csv"
    head = "timestamp,src_ip,dst_ip,src_port,dst_port,protocol,action,bytes_sent,bytes_received\n"
    rows = [f"2026-07-01 {(7 * i) % 24:02d}:00:00,10.0.0.{i % 5 + 1},192.0.2.1,5000,443,tcp,allow,{i},1\n" for i in range(48)]
    log.write_text(head + "".join(rows))
    paths = run_job(spark, str(log), str(tmp_path / "out"), replace(Config(), ai_detection=AnomalyModel(n_estimators=5)))

    def lines(name, *columns):
        found = []
        for part in sorted((tmp_path / "out").glob(f"{name}/part-*")):
            header, *body = part.read_text().splitlines()
            places = [header.split(",").index(c) for c in columns]
            found += [tuple(line.split(",")[i] for i in places) for line in body]
        return found

    times = lines("cleaned/cleaned_logs.csv", "timestamp")
    assert len(times) == 48 and times == sorted(times)
    windows = lines("ai/features.csv", "window_start", "src_ip")
    assert len(windows) == 48 and windows == sorted(windows) and paths["features"].endswith("features.csv")
