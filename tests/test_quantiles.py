import numpy as np
import pytest
from pyspark.sql import functions as F

from fwlens.operators.quantiles import column_quantiles, histogram, quantiles

PROBABILITIES = [0.0, 0.02, 0.25, 0.5, 0.95, 0.99, 1.0]


@pytest.mark.parametrize("kind", ["bytes", "small", "signed", "fractions"])
def test_quantiles_are_exact(spark, kind):
    rng = np.random.default_rng(5)
    make = {
        "bytes": lambda n: rng.integers(0, 10**11, n).astype(float),
        "small": lambda n: rng.integers(0, 4, n).astype(float),
        "signed": lambda n: np.round(rng.normal(0, 50, n), 3),
        "fractions": lambda n: rng.random(n),
    }[kind]
    groups = {f"g{n}": make(n) for n in (1, 2, 3, 10, 997)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    rows = quantiles(histogram(df, ["g"], "v"), ["g"], PROBABILITIES).collect()
    assert len(rows) == len(groups) * len(PROBABILITIES)
    for row in rows:
        assert row.total == len(groups[row.g])
        assert row["quantile"] == pytest.approx(np.quantile(groups[row.g], row.p), rel=1e-12, abs=1e-12)


def test_one_value_may_hold_most_rows(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(0).cast("double").alias("v"))
    row = column_quantiles(df, ["v"], [0.9]).first()
    assert row["quantile"] == pytest.approx(np.quantile([i if i % 3 == 0 else 0 for i in range(9000)], 0.9))
