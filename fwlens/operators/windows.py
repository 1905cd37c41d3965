"""Trailing-window triggers and global numbering, cut into time slots so that no source is one task.

The log is cut into slots as wide as the window itself. A trailing window then touches its own slot and the
one before, which gives three exact steps: count per (source, slot) with map-side combining; keep only slots
that can hold the first crossing; look at single rows of those slots alone.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fwlens.session import checkpointed

MINUTE_US = 60_000_000


def slot_text(us: str, window_us: int) -> str:
    """SQL text of the index of the epoch-aligned interval that holds ``us``."""
    return f"({us} - pmod({us}, {window_us}L)) div {window_us}L"


def with_time(df: DataFrame, window_us: int, ts: str = "timestamp") -> DataFrame:
    """Adds ``us`` (epoch microseconds) and ``slot`` (index of the window-wide interval).

    The filter is what a later join on the slot would add to its own branch only; stated for all branches, they
    stay equal and share one shuffle.
    """
    timed = df.selectExpr("*", f"unix_micros(cast({ts} AS timestamp)) AS us")
    return timed.selectExpr("*", f"{slot_text('us', window_us)} AS slot").filter("slot IS NOT NULL")


def _candidate_slots(per_slot: DataFrame) -> DataFrame:
    """Slots that can hold a source's first crossing, from (src_ip, slot, n, threshold, ...).

    A window ending in slot c lies within c-1 and c, so n(c-1) + n(c) bounds it from above. A slot that reaches
    the threshold alone certainly crosses, hence nothing after the first such slot matters.
    """
    in_time = "OVER (PARTITION BY src_ip ORDER BY slot)"
    return (
        per_slot.selectExpr(
            "*",
            f"CASE WHEN lag(slot) {in_time} = slot - 1 THEN lag(n) {in_time} ELSE 0 END AS before",
            "min(CASE WHEN n >= threshold THEN slot END) OVER (PARTITION BY src_ip) AS certain",
        )
        .filter("before + n >= threshold AND (certain IS NULL OR slot <= certain)")
        .drop("before", "certain", "n")
    )


def _with_previous_slot(candidates: DataFrame) -> DataFrame:
    """Each candidate slot together with the slot before it; ``target`` keeps the candidate."""
    others = [name for name in candidates.columns if name != "slot"]
    return candidates.selectExpr(*others, "slot AS target", "explode(array(slot - 1, slot)) AS slot")


def _passed(candidates: DataFrame) -> list[str]:
    return [name for name in candidates.columns if name not in ("src_ip", "slot")]


def first_count_window(rows: DataFrame, window_us: int, rule) -> DataFrame:
    """Per source, the first time at which (t - W, t] holds at least ``threshold`` rows.

    ``rows`` has src_ip, us and slot; ``rule.attach`` adds the threshold columns to a frame with src_ip.
    Returns one row per firing source: src_ip, trigger_us and the threshold columns.
    """
    instants = rows.groupBy("src_ip", "slot", "us").agg(F.expr("count(1) AS n"))
    per_slot = rule.attach(instants.groupBy("src_ip", "slot").agg(F.expr("sum(n) AS n")))
    candidates = _candidate_slots(per_slot)
    frame = f"PARTITION BY src_ip, target ORDER BY us RANGE BETWEEN {window_us - 1}L PRECEDING AND CURRENT ROW"
    return (
        instants.join(_with_previous_slot(candidates), ["src_ip", "slot"])
        .selectExpr("*", f"sum(n) OVER ({frame}) AS in_window")
        .filter("slot = target AND in_window >= threshold")
        .groupBy("src_ip", *_passed(candidates))
        .agg(F.expr("min(us) AS trigger_us"))
    )


def first_distinct_window(rows: DataFrame, value: str, window_us: int, rule) -> DataFrame:
    """Per source, the first time at which [t - W, t] holds at least ``threshold`` distinct values.

    Only the first and last occurrence of a value within a slot can matter: inside one slot its occurrences are
    never more than W apart. So the first step reduces the log to one row per (source, slot, value). ``rows`` may be reduced
    before, to ``first_us`` and ``last_us`` of several columns' values together.
    """
    first, last = ("first_us", "last_us") if "first_us" in rows.columns else ("us", "us")
    seen = rows.groupBy("src_ip", "slot", F.col(value).alias("value")).agg(
        F.expr(f"min({first}) AS first_us"), F.expr(f"max({last}) AS last_us")
    )
    # the count asks for both times, so that one shuffle of ``seen`` serves it and the join below
    counted = seen.groupBy("src_ip", "slot").agg(F.expr("count_if(first_us <= last_us) AS n"))
    candidates = _candidate_slots(rule.attach(counted))
    passed = _passed(candidates)

    # A candidate's own slot is decided by its first ``threshold`` values at the latest, so the rest is not needed.
    # The previous slot keeps all its values: they number fewer than the threshold, or it would have been certain.
    near = (
        seen.join(_with_previous_slot(candidates), ["src_ip", "slot"])
        .selectExpr("*", "row_number() OVER (PARTITION BY src_ip, target, slot ORDER BY first_us) AS place")
        .filter("place <= threshold")
    )
    if rule.bound is not None:
        # a literal bound lets Spark drop the surplus before the shuffle
        near = near.filter(f"place <= {rule.bound}")
    # one exchange serves the grouping, the sweep and its window; at most twice the threshold rows per group remain
    near = near.repartition("src_ip", "target")
    active = near.groupBy("src_ip", "target", "value", *passed).agg(
        F.expr("max(CASE WHEN slot = target THEN first_us END) AS opens"),
        F.expr(f"max(CASE WHEN slot < target THEN last_us END) + {window_us}L AS expires"),
    )
    # a value of the previous slot is carried into the candidate slot and may lapse before it is seen again
    lapses = "(opens IS NULL OR opens > expires + 1)"
    changes = f"""array_compact(array(
        CASE WHEN expires IS NOT NULL THEN named_struct('at', target * {window_us}L, 'delta', 1, 'new', false) END,
        CASE WHEN expires IS NOT NULL AND {lapses} THEN named_struct('at', expires + 1, 'delta', -1, 'new', false) END,
        CASE WHEN opens IS NOT NULL AND (expires IS NULL OR {lapses}) THEN named_struct('at', opens, 'delta', 1, 'new', true) END
    ))"""
    return (
        active.selectExpr("src_ip", "target", *passed, f"inline({changes})")
        .selectExpr("*", "sum(delta) OVER (PARTITION BY src_ip, target ORDER BY at) AS distinct_values")
        .filter("new AND distinct_values >= threshold")
        .groupBy("src_ip", *passed)
        .agg(F.expr("min(at) AS trigger_us"))
    )


def rows_of_windows(rows: DataFrame, hits: DataFrame, window_us: int, closed_left: bool) -> DataFrame:
    """The rows inside each source's trigger window, joined by (source, slot) so that a busy source is spread."""
    last = slot_text("trigger_us", window_us)
    windows = hits.selectExpr("*", f"explode(array({last} - 1, {last})) AS slot")
    after = ">=" if closed_left else ">"
    return rows.join(windows, ["src_ip", "slot"]).filter(f"us {after} trigger_us - {window_us}L AND us <= trigger_us")


def combined_rows(window_rows: DataFrame, columns: list[str], value: str | None = None) -> DataFrame:
    """Window rows combined per source and ``columns``: n, first_us, last_us.

    With ``value``, rows that share the trigger time count only up to the row that brought the decisive value: the
    first appearance of the threshold-th distinct value in (time, row_id) order. Only such tied rows stay single;
    all others combine on the map side, so a window with very many rows reaches its source as one row per pair.
    """
    per_source = [c for c in window_rows.columns if c not in (*columns, "us", "slot", "row_id")]
    tied = "CASE WHEN us = trigger_us THEN row_id END" if value else "cast(NULL AS bigint)"
    combined = (
        window_rows.selectExpr(*per_source, *columns, "us", f"{tied} AS tied_row")
        .groupBy(*per_source, *columns, "tied_row")
        .agg(F.expr("count(1) AS n"), F.expr("min(us) AS first_us"), F.expr("max(us) AS last_us"))
    )
    if value is None:
        return combined.drop("tied_row")
    of_value = f"OVER (PARTITION BY src_ip, {value})"
    return (
        combined.repartition("src_ip")
        .selectExpr("*", f"min(first_us) {of_value} AS value_us", f"min(tied_row) {of_value} AS value_row")
        .selectExpr(
            "*",
            "dense_rank() OVER (PARTITION BY src_ip ORDER BY value_us,"
            f" CASE WHEN value_us = trigger_us THEN value_row END, {value}) AS place",
        )
        .selectExpr("*", "max(CASE WHEN place = threshold THEN value_row END) OVER (PARTITION BY src_ip) AS last_row")
        .filter("tied_row IS NULL OR last_row IS NULL OR tied_row <= last_row")
        .drop("tied_row", "value_us", "value_row", "place", "last_row")
    )


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Global 1-based position of each row in the order of some columns, without sorting the frame in one task.

    The range-partitioned sort is stored once; a row's position is its place in its partition after the rows of all
    partitions before it. Ranges split wherever the order columns differ, so rows that only begin alike do not meet.
    """
    places = {"_part": F.spark_partition_id(), "_local": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}
    stored = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns(places))
    firsts = stored.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).selectExpr(
        "_part", "sum(_n) OVER (ORDER BY _part) - _n + 1 AS _first"
    )
    joined = stored.join(firsts, "_part").withColumn(name, F.col("_first") + F.col("_local"))
    return joined.drop("_part", "_local", "_first")


def id_order(name: str) -> list[Column]:
    """Sort keys of a numbered id such as ``ALT-000001``: more digits mean a higher number."""
    return [F.length(name), F.col(name)]
