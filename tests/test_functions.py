import ipaddress
import random
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fwlens.config import Config
from fwlens.functions import columns, net, scoring


def values(spark, items, kind, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r.out for r in df.select("i", make(F.col("v")).alias("out")).orderBy("i").collect()]


def addresses():
    rng = random.Random(7)
    found = [
        "10.0.0.1", "0.0.0.0", "255.255.255.255", "256.1.1.1", "1.2.3", "1.2.3.4.5", "01.2.3.4", "1.2.3.04", " 1.2.3.4",
        "1.2.3.4\n", "", "abc", "::", "::1", "1::", "1::2", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::",
        "::2:3:4:5:6:7:8", "1::3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1::2::3", ":1:2:3:4:5:6:7", "fe80::1%eth0", "fe80::1%", "fe80::1%a%b",
        "12345::", "g::1", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3.4", "1::1.2.3.256", ":::", "1:", ":1", "2001:db8::7",
    ]
    for _ in range(300):
        groups = [format(rng.choice([0, 1, 0xDB8, 0xFFFF, rng.randrange(65536)]), "x") for _ in range(rng.randint(1, 9))]
        cut = rng.randint(0, len(groups))
        text = ":".join(groups[:cut]) + rng.choice(["::", ":", "::"]) + ":".join(groups[cut:])
        found.append(text)
    return found


def test_address_check_agrees_with_the_standard_library(spark):
    def expected(text):
        try:
            ipaddress.ip_address(text)
            return True
        except ValueError:
            return False

    texts = addresses()
    assert values(spark, texts, "string", net.is_ip) == [expected(t) for t in texts]


@pytest.mark.parametrize("prefix", [1, 8, 13, 16, 24, 27, 32])
def test_network_key_agrees_with_the_standard_library(spark, prefix):
    def expected(text):
        try:
            return str(ipaddress.ip_network(f"{text.split('%')[0]}/{prefix}", strict=False))
        except ValueError:
            return text

    texts = [t for t in addresses() if not t.count("%") or t == "fe80::1%eth0"]
    assert values(spark, texts, "string", lambda c: net.asset_key(c, "subnet24", prefix)) == [expected(t) for t in texts]
    assert values(spark, ["10.0.0.55", "not_an_ip"], "string", net.asset_key) == ["10.0.0.55", "not_an_ip"]


def test_number_text(spark):
    rng = random.Random(3)
    numbers = [0.0, 1e7, 999999.5, 1234565.0, 0.001953125, 1e-5, 0.0001, 1.85, 2.25, 100000.0, 1000000.0]
    numbers += [rng.randint(1, 10**9) / rng.choice([1, 2, 8, 512, 1000]) for _ in range(300)]
    assert values(spark, numbers, "double", columns.general) == [f"{n:g}" for n in numbers]
    assert values(spark, numbers, "double", columns.fixed1) == [f"{n:.1f}" for n in numbers]


def _whole(c):
    text = columns.strip(c)
    return F.coalesce(columns.whole_part(text), columns.real_part(text).try_cast("bigint"))


MIXED = [
    "7/4/2026 9:25:27", "07/04/2026 9:25", "07/04/2026 09:25:27 PM", "07/04/2026 12:05 AM", "2026/07/26 09:25:27.123",
    "2026/07/26T09:25:27", "2026/7/4 09:25:27", "20260726T092527", "26 Jul 2026", "July 26, 2026 09:25", "2026.07.26 09:25:27",
    "Sat, 26 Jul 2026 09:25:27 GMT", "2026-07-01 09:00:00", "2026-07-01T09:00:00.250Z", "2026-07-01T09:00:00+02:00",
    "2026-07-01 09:00:00-0530", "2026-07-01", "20260726", "20260726092527", "26-Jul-2026 09:25:27", "Jul 4 2026 09:25:27",
    "13/07/2026 10:00", "2026-02-30", "2026-13-01 00:00", "2026-07-01 25:00:00", "2026-07-01 09:61", "bad", "no time",
    "2026-07-01T09:00:00.123456789", "2024-02-29 23:59:59.999999", "1/2/2026", "12:30", "July 2026 x",
]


def test_times_agree_with_pandas(spark):
    got = values(spark, MIXED, "string", lambda c: columns.timestamp_of(columns.strip(c)))
    for text, found in zip(MIXED, got):
        want = pd.to_datetime(pd.Series([text]), errors="coerce", format="mixed", utc=True)[0]
        if text == "12:30":  # a time without a date means today there
            assert found is None
            continue
        assert (None if pd.isna(want) else want.tz_localize(None).floor("us").to_pydatetime()) == found, text


def test_epoch_times(spark):
    times = ["1782896400", "1782896400.25", "x", None, "2026-07-01"]
    start = datetime(2026, 7, 1, 9)
    got = values(spark, times, "string", lambda c: columns.timestamp_of(c, "s"))
    assert got == [start, start.replace(microsecond=250000), None, None, datetime(2026, 7, 1)]
    assert values(spark, ["1782896400250"], "string", lambda c: columns.timestamp_of(c, "ms")) == [start.replace(microsecond=250000)]


def test_coercion(spark):
    texts = ["50000", " 7 ", "22.7", "1e3", "-5", "5d", "NaN", "", None, "9007199254740993", "0x10"]
    assert values(spark, texts, "string", _whole) == [
        50000, 7, 22, 1000, -5, None, None, None, None, 9007199254740993, None,
    ]
    times = [
        "2026-07-01 09:00:00", "2026-07-01T09:00:00.250", "2026/07/26 09:25:27", "2026-07-01T09:00:00Z",
        "2026-07-01T09:00:00+02:00", "07/26/2026 01:02:03", "bad", None, " 2026-07-01 ",
    ]
    assert values(spark, times, "string", lambda c: columns.timestamp_of(columns.strip(c))) == [
        datetime(2026, 7, 1, 9), datetime(2026, 7, 1, 9, 0, 0, 250000), datetime(2026, 7, 26, 9, 25, 27), datetime(2026, 7, 1, 9),
        datetime(2026, 7, 1, 7), datetime(2026, 7, 26, 1, 2, 3), None, None, datetime(2026, 7, 1),
    ]


def test_words_and_sets(spark):
    assert values(spark, [" deny\t", "Accepted", "reset", None], "string", columns.normal_action) == ["BLOCK", "ALLOW", "RESET", None]
    assert values(spark, [443, 9999, None], "int", columns.service_name) == ["HTTPS", "Unknown", "Unknown"]
    assert values(spark, [["b", "a", "nan", "", "b"]], "array<string>", columns.joined) == ["a, b"]
    assert values(spark, [["22", "1000"]], "array<string>", columns.joined) == ["1000, 22"]
    assert values(spark, [" a, b,,c "], "string", columns.split_items) == [["a", "b", "c"]]
    assert values(spark, ["x | y"], "string", lambda c: columns.split_items(c, "|")) == [["x", "y"]]


def test_slots_are_epoch_aligned_before_1970_too(spark):
    assert values(spark, [-1, 0, 9, 10, -10, -11], "bigint", lambda c: columns.slot(c, 10)) == [-1, 0, 0, 1, -1, -2]


def test_scores_and_severities(spark):
    config = Config()
    assert values(spark, [10, 29, 30, 59, 60, 79, 80], "int", lambda c: scoring.severity_of(c, config)) == [
        "Low", "Low", "Medium", "Medium", "High", "High", "Critical",
    ]
    assert values(spark, ["Low", "Critical", "x"], "string", scoring.severity_rank) == [1, 4, 0]
    kinds = [["Port scan"], ["Port scan", "Host scan"], list(scoring.RECOMMENDATIONS), ["unknown"]]
    assert values(spark, kinds, "array<string>", lambda c: scoring.incident_score(c, config)) == [25, 60, 100, 0]
    lines = values(spark, kinds, "array<string>", lambda c: scoring.score_breakdown(c, config))
    assert lines[1] == "Host scan: +20 | Port scan: +25 | Multiple alert types bonus: +15 | Final score: 60"
    assert lines[3] == "Final score: 0"
    advice = values(spark, kinds, "array<string>", scoring.recommendations)
    assert advice[0].split(" | ") == scoring.RECOMMENDATIONS["Port scan"] and advice[3] == ""
