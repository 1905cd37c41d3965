"""Registered queries against their SQL on the smallest tables."""

import decimal
from pathlib import Path

import pytest

import __spark_entry__ as driver

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


def plain(row):
    return tuple(float(v) if isinstance(v, decimal.Decimal) else v for v in row)


CHEAP = (
    "clean_logs", "cleaning_summary", "top_destination_ports", "asset_baseline", "large_transfer", "off_hours", "incidents",
    "anomaly_explanations", "events_over_time", "incident_timeline", "isolation_forest", "anomalies_at_threshold",
)


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_sql(spark, duck, name):
    df = driver.queries()[name](spark, str(DATA))
    names = sorted(df.columns)
    found = [plain(row[n] for n in names) for row in df.collect()]
    result = duck.execute(driver.oracle_sql()[name])
    places = {d[0]: i for i, d in enumerate(result.description)}
    assert sorted(places) == names
    expected = [plain(row[places[n]] for n in names) for row in result.fetchall()]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_names_match():
    assert set(driver.oracle_sql()) <= set(driver.queries())
