"""Exports: directories of CSV or parquet written by all executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _flat(df: DataFrame) -> DataFrame:
    """CSV holds no nested values: structs become JSON, arrays joined text."""
    shown = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith("array"):
            c = F.array_join(F.transform(c, lambda item: item.cast("string")), ", ")
        elif kind.startswith(("struct", "map")):
            c = F.to_json(c)
        shown.append(c.alias(name))
    return df.select(*shown)


def export_csv(df: DataFrame, path: str) -> str:
    """UTF-8 CSV with a header; an empty result still leaves a file with the header line."""
    flat = _flat(df)
    flat.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option(
        "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]"
    ).option("escape", '"').csv(path)
    return path


def export_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def export_cleaned(logs: DataFrame, output_root: str) -> str:
    return export_csv(logs, f"{output_root}/cleaned/cleaned_logs.csv")


def export_cleaned_columns(logs: DataFrame, output_root: str) -> str:
    """The cleaned log as parquet by day. Ranges are cut by time, so that a busy day is several files and quiet ones share a
    task, and rows lie in time order within each file."""
    path, order = f"{output_root}/cleaned/cleaned_logs.parquet", ("event_date", "timestamp", "row_id")
    dated = logs.withColumn("event_date", F.to_date("timestamp"))
    return export_parquet(dated.repartitionByRange(*order).sortWithinPartitions(*order), path, ("event_date",))


def export_by_key(table: DataFrame, path: str, *key: str) -> str:
    """Parquet ranged and sorted by a key, so that a look-up by the key reads few row groups."""
    return export_parquet(table.repartitionByRange(*key).sortWithinPartitions(*key), path)


def export_alerts(alerts: DataFrame, output_root: str) -> str:
    return export_csv(alerts, f"{output_root}/alerts/alerts.csv")


def export_incidents(incidents: DataFrame, output_root: str) -> str:
    return export_csv(incidents, f"{output_root}/incidents/incidents.csv")
