"""Cleaning with an exact account of what was dropped."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from fwlens.functions.columns import flag, normal_action, real_part, strip, timestamp_of, whole_part
from fwlens.functions.net import is_ip
from fwlens.sources.schema_map import CANONICAL, MappedLogs, kept_name, quoted

PORTS = ("src_port", "dst_port")
SIZES = ("bytes_sent", "bytes_received")
NUMERIC = PORTS + SIZES
BOOKKEEPING = ("copies", "null_cells", "bad_timestamp", "bad_ip", "bad_port", "bad_bytes", "row_valid")


@dataclass(frozen=True)
class CleanedLogs:
    """Distinct source rows, typed and flagged; the clean rows and the summary are views of them."""

    flagged: DataFrame
    mapped: dict[str, str]
    unavailable: tuple[str, ...]
    #: The summary's counters, where a write has taken them.
    counted: dict[str, int] | None = None

    @property
    def logs(self) -> DataFrame:
        return self.flagged.filter("row_valid").drop(*BOOKKEEPING)

    @property
    def summary(self) -> DataFrame:
        """One row of counters, from the write that has passed all rows, else by a scan."""
        if self.counted is None:
            return cleaning_summary(self.flagged)
        fields = ", ".join(f"{name} bigint" for name in self.counted)
        return self.flagged.sparkSession.createDataFrame([tuple(self.counted.values())], fields)

    def materialized(self, path: str) -> "CleanedLogs":
        """Write the flagged rows once to shared storage, so that every later operator scans columns of a table.

        Rows are laid out by date: the AQE rebalance splits large dates and merges small ones. The summary is observed on
        the rows as they are written, behind the exchange, where a task that runs again counts once.
        """
        spark = self.flagged.sparkSession
        dated = self.flagged.withColumn("event_date", F.to_date("timestamp"))
        counters = Observation()
        spread = dated.hint("rebalance", "event_date").observe(counters, *summary_counters())
        spread.write.mode("overwrite").partitionBy("row_valid", "event_date").parquet(path)
        stored = spark.read.schema(dated.schema).parquet(path).drop("event_date")
        return replace(self, flagged=stored, counted=counters.get)


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda left, right: left & right, conditions, F.lit(True))


def _computed(columns: dict[str, Column]) -> Column:
    """The columns as a one-element inline: whatever uses them, filters too, reads results and repeats no parsing."""
    return F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))


def clean_logs(mapped: MappedLogs, row_id: str | None = None, epoch_unit: str | None = None) -> CleanedLogs:
    """Drop duplicate and invalid rows.

    One aggregation over the source columns finds the distinct rows; copies collapse on the map side, so a
    row repeated any number of times reaches its reducer once per task. ``row_id`` names a unique source
    column; without one the hash of the distinct row serves, which does not depend on file order.
    Numeric times are epoch times in ``epoch_unit``; without one they are invalid.
    """
    names = mapped.source.columns
    keys = [quoted(name) for name in names]
    distinct = mapped.source.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))

    canonical = mapped.canonical
    supplied = set(mapped.mapped)
    # a renamed column counts under both of its names, and so do NULL placeholders
    cells = [quoted(name) for name in mapped.passthrough] + list(canonical.values())
    nulls = reduce(lambda left, right: left + right, [flag(c.isNull()) for c in cells])

    identity = quoted(kept_name(row_id)).cast("bigint") if row_id else F.xxhash64(*keys)
    text = {name: strip(c.cast("string")) for name, c in canonical.items()}
    rows = distinct.select(
        *[quoted(name) for name in mapped.passthrough],
        "copies",
        nulls.alias("null_cells"),
        identity.alias("row_id"),
        _computed({f"_{name}": c for name, c in text.items()}),
    )
    text = {name: F.col(f"_{name}") for name in CANONICAL}
    kept = [c for c in rows.columns if c not in {f"_{name}" for name in CANONICAL}]
    numbers = {}
    for name in NUMERIC:
        whole = whole_part(text[name])
        numbers[f"{name}_whole"], numbers[f"{name}_real"] = whole, F.when(whole.isNull(), real_part(text[name]))
    # a generator with a lambda in it is interpreted as a whole, so the time is made in a step of its own
    timed = rows.withColumn("_timestamp", timestamp_of(text["timestamp"], epoch_unit))
    parsed = timed.select(
        *[quoted(name) for name in kept],
        _computed(
            {
                "timestamp": text["timestamp"],
                "src_ip": text["src_ip"],
                "dst_ip": text["dst_ip"],
                "protocol": F.upper(text["protocol"]),
                "action": normal_action(text["action"]),
                **numbers,
                "bad_src_ip": ~is_ip(text["src_ip"]),
                "bad_dst_ip": ~is_ip(text["dst_ip"]) if "dst_ip" in supplied else F.lit(False),
            }
        ),
    )
    value = {name: F.coalesce(F.col(f"{name}_whole"), F.col(f"{name}_real")) for name in NUMERIC}
    number = {name: F.coalesce(F.col(f"{name}_whole"), F.col(f"{name}_real").try_cast("bigint")) for name in NUMERIC}
    good_port = {name: F.coalesce(value[name].between(0, 65535), F.lit(False)) for name in PORTS}
    good_size = {name: F.coalesce(value[name] >= 0, F.lit(False)) for name in SIZES}
    typed = {name: F.col(name) for name in ("timestamp", "src_ip", "dst_ip", "protocol", "action")}
    typed |= {name: F.when(good_port[name], number[name]).cast("int") for name in PORTS}
    typed |= {name: number[name] for name in SIZES}
    flagged = parsed.select(
        *[quoted(name) for name in mapped.passthrough],
        *[typed[name].alias(name) for name in CANONICAL],
        "row_id",
        "copies",
        "null_cells",
        F.col("timestamp").isNull().alias("bad_timestamp"),
        (F.col("bad_src_ip") | F.col("bad_dst_ip")).alias("bad_ip"),
        (~_all([good_port[name] for name in PORTS if name in supplied])).alias("bad_port"),
        (~_all([good_size[name] for name in SIZES if name in supplied])).alias("bad_bytes"),
    ).selectExpr("*", "NOT (bad_timestamp OR bad_ip OR bad_port OR bad_bytes) AS row_valid")
    return CleanedLogs(flagged, mapped.mapped, mapped.unavailable)


def cleaning_summary(flagged: DataFrame) -> DataFrame:
    """One row: nulls count every source row, the invalid counters count distinct rows and may overlap."""
    return flagged.agg(*summary_counters())


def summary_counters() -> list[Column]:
    copies = F.col("copies")

    def total(c: Column, name: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name)

    return [
        total(copies, "original_row_count"),
        total(flag(F.col("row_valid")), "final_row_count"),
        total(copies - 1, "duplicate_rows_removed"),
        total(flag(F.col("bad_timestamp")), "invalid_timestamps"),
        total(flag(F.col("bad_ip")), "invalid_ip_addresses"),
        total(flag(F.col("bad_port")), "invalid_ports"),
        total(copies * F.col("null_cells"), "missing_values"),
        total(flag(F.col("bad_bytes")), "invalid_bytes"),
    ]
