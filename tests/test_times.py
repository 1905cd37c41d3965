"""Written forms of time that logs use besides those of the raw fixture."""

import json
from dataclasses import replace
from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F

from fwlens.config import AnomalyModel, config_from_dict
from fwlens.functions import columns
from fwlens.operators.clean import clean_logs
from fwlens.plans.analysis import run_job
from fwlens.sources.schema_map import map_log_schema

FORMS = [
    "Sun Jul 26 09:25:27 2026", "Jul 26 09:25:27 2026", "Sun Jul  5 09:25:27 2026", "Sun Jul 26 09:25:27 UTC 2026", "7/4/26 09:25:27",
    "26/7/26 09:25", "13-07-26", "7/4/75 1:02:03 PM", "7/4/77", "99/07/04 09:25:27", "26-Jul-26 09:25:27", "26 Jul 26", "Jul 26, 26 09:25",
    "09:25:27 26 Jul 2026", "09:25 07/26/2026", "09:25:27.5 2026-07-26", "9:25 PM Jul 26 2026", "Jul/26/2026 09:25:27", "Jul-26-2026",
    "2026-Jul-26 09:25:27", "Foo/26/2026 09:25:27", "7/4/26 25:00:00", "31/31/26", "09:25:27 nothing",
    "2026-07-26 9 PM", "2026-07-26T09", "2026-07-26 09", "2026-07-26 9", "2026-07-26 24", "2026-07-26 13 PM", "Jul 26 2026 9PM", "7/26/2026 9 AM",
    "20260726T09", "2026-07", "2026/07", "2026.07", "2026-13", "07/2026", "7-2026", "July 2026", "Jul-2026", "July, 2026", "2026 Jul", "2026-07-26 at 09:25",
    "26 July 2026 at 9 pm", "at 09:25 2026-07-26", "2026-07-26 09:25 EST", "2026-07-26 09:25:27 PDT", "2026-07-26 9PM EST", "2026-07-26 09:25 Europe",
    "2026-07-26 09:25:27.5 PM", "26 JUL 2026", "2026-07-26T09:25:27.123456789Z", "2026-07-26 9:25:27+0200", "12:30 AM 7/4/2026",
]


def test_further_forms_agree_with_pandas(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(FORMS)], "i int, t string")
    got = [r[0] for r in rows.orderBy("i").select(columns.timestamp_of(columns.strip(rows["t"]))).collect()]
    for text, found in zip(FORMS, got):
        want = pd.to_datetime(pd.Series([text]), errors="coerce", format="mixed", utc=True)[0]
        assert (None if pd.isna(want) else want.tz_localize(None).to_pydatetime()) == found, text


def test_an_hour_is_no_year(spark):
    rows = spark.createDataFrame([("Jul 26 09:12:27",), ("26 Jul 09:12:27",)], "t string")
    assert [r[0] for r in rows.select(columns.timestamp_of(rows["t"])).collect()] == [None, None]


def test_a_log_with_epoch_times(spark, tmp_path):
    log = tmp_path / "log.json"
    log.write_text(json.dumps([{"event_time": 1782896400, "source_ip": "10.0.0.1", "verdict": "deny"}]))
    counted = {}
    for unit in ("s", "", "weeks"):
        config = replace(config_from_dict({"cleaning": {"epoch_unit": unit}}), ai_detection=AnomalyModel(enabled=False))
        if unit == "s":
            paths = run_job(spark, str(log), str(tmp_path / "out"), config)
            row = spark.read.option("header", True).csv(paths["cleaned"]).first()
            assert datetime.fromisoformat(row["timestamp"]) == datetime(2026, 7, 1, 9)
        counted[unit] = config.epoch_unit
    assert counted == {"s": "s", "": "", "weeks": ""}


def test_texts_that_are_cast_agree_with_those_that_are_taken_apart(spark, monkeypatch):
    days = ["2024-02-29", "2023-02-29", "2026-13-01", "2026-00-10", "2026-04-31", "1000-01-01", "9999-12-31", "0999-01-01", "0000-01-01"]
    clocks = [" 00:00:00", "T23:59:59.999999", " 24:00:00", " 12:60:00", " 12:00:60", " 12:00:00.5", " 12:00:00.1234567", " 12:00:00Z", " 12:00:00."]
    texts = [(day + clock,) for day in days for clock in clocks] + [("2026-07-26 09:25:27\n",), ("٢٠٢٦-07-26 09:25:27",), (None,)]
    rows = spark.createDataFrame(texts, "t string")
    got = rows.select("t", columns.timestamp_of(rows["t"]).cast("string")).collect()
    monkeypatch.setattr(columns, "_CAST", "^never$")
    assert rows.select("t", columns.timestamp_of(rows["t"]).cast("string")).collect() == got
    assert sum(row[1] is not None for row in got) > 20


def test_a_text_is_rewritten_once(spark):
    rows = spark.createDataFrame([("Jul 26 2026",)], "t string").withColumn("t", columns.strip(F.col("t")))
    plan = rows.select(columns.timestamp_of(rows["t"]).alias("made"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(columns._COMPLETED[0][0]) == 1


def test_trimming_equals_a_trim_by_the_set(spark):
    texts = [None, "", " ", "a", "ab", " a", "a ", "é", " é\t", "\x7f", "~", "!", " x　", "x\xa0", "\x1fa b\x85", "日本", "\x00", "a\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(columns.strip(rows["t"])).collect()] == [t if t is None else t.strip(columns.WHITESPACE) for t in texts]


def test_the_cleaning_is_compiled(spark):
    """A generator with a lambda in it would be interpreted, with all that it computes."""
    raw = spark.createDataFrame([("26 Jul 2026", "10.0.0.1")], "event_time string, source_ip string")
    plan = clean_logs(map_log_schema(raw)).flagged._jdf.queryExecution().optimizedPlan().toString()
    generators = [line for line in plan.splitlines() if "Generate inline" in line]
    assert len(generators) == 2 and not any("lambda" in line or "transform(" in line for line in generators)
