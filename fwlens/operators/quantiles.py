"""Exact grouped quantiles that never gather one group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Buckets per doubling of the value: a key has at most some 40,000 of them for values up to 2**64.
_RESOLUTION = 512
# non-decreasing in the value: signed logarithmic position
_BUCKET = f"cast(signum(value) * floor(log1p(abs(value)) * ({_RESOLUTION} / ln(2.0D))) AS int) AS bucket"


def histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n): equal values collapse on the map side, hot groups spread over their values."""
    rows = df.filter(f"{value} IS NOT NULL").selectExpr(*keys, f"cast({value} AS double) AS value")
    return rows.groupBy(*keys, "value").agg(F.expr("count(1) AS n"))


def quantiles(hist: DataFrame, keys: list[str], probabilities: list[float]) -> DataFrame:
    """(keys, p, quantile, total) with linear interpolation between closest ranks, exact.

    Ranks are found in two steps: running counts over value buckets (few rows per key) locate the buckets
    that hold the wanted ranks, and only the values of those buckets are ranked one by one.
    """
    by_key = ", ".join(keys)
    # the join below would ask for known buckets in its own branch only; asked for here, both branches share a shuffle
    spread = hist.selectExpr(*keys, "value", "n", _BUCKET).filter("bucket IS NOT NULL")
    running = (
        spread.groupBy(*keys, "bucket")
        .agg(F.expr("sum(n) AS held"))
        .selectExpr(
            *keys,
            "bucket",
            "held",
            f"sum(held) OVER (PARTITION BY {by_key} ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS through",
            f"sum(held) OVER (PARTITION BY {by_key}) AS total",
        )
    )
    targets = ", ".join(
        f"named_struct('p', {p!r}D, 'position', {p!r}D * (total - 1), 'low', floor({p!r}D * (total - 1)),"
        f" 'high', ceil({p!r}D * (total - 1)))"
        for p in map(float, probabilities)
    )
    wanted = running.selectExpr(
        *keys,
        "bucket",
        "total",
        "through - held AS before",
        f"filter(array({targets}), t -> through - held <= t.high AND through > t.low) AS targets",
    ).filter("size(targets) > 0")
    ranked = (
        spread.join(wanted, [*keys, "bucket"])
        .selectExpr(
            *keys, "value", "n", "total", "targets",
            f"before + sum(n) OVER (PARTITION BY {by_key}, bucket ORDER BY value ROWS UNBOUNDED PRECEDING) - 1 AS last",
        )
        .selectExpr(*keys, "value", "last - n + 1 AS first", "last", "total", "inline(targets)")
    )
    ends = ranked.groupBy(*keys, "p", "total", "position", "low").agg(
        F.expr("max(CASE WHEN low BETWEEN first AND last THEN value END) AS at_low"),
        F.expr("max(CASE WHEN high BETWEEN first AND last THEN value END) AS at_high"),
    )
    return ends.selectExpr(*keys, "p", "at_low + (at_high - at_low) * (position - low) AS quantile", "total")


def column_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> DataFrame:
    """(name, p, quantile, total) of several numeric columns of one frame."""
    pairs = ", ".join(f"named_struct('name', '{c}', 'v', cast({c} AS double))" for c in columns)
    return quantiles(histogram(df.selectExpr(f"inline(array({pairs}))"), ["name"], "v"), ["name"], probabilities)
