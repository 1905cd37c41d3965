"""Scans of log files: CSV, JSON documents, JSON lines and parquet."""

from __future__ import annotations

import re
from contextlib import contextmanager
from functools import reduce
from typing import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from fwlens.functions.columns import NULL_TOKENS

# names that the scan adds for a time
CORRUPT, FILE = "_corrupt_record", "_source_file"
# the columns of a rejected record, and what its error begins with
REJECTED = ("source_file", "record")
NOT_VALID = "Input log file is not valid"
# file suffix -> reader
FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".parquet": "parquet"}


def format_of(path: str) -> str:
    """Reader name for a path, from its suffix without regard to case; globs and directories may carry one too."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for suffix, kind in FORMATS.items():
        if name.endswith(suffix):
            return kind
    raise ValueError("Unsupported log format. Use CSV, JSON, JSONL, NDJSON, or parquet.")


def _check_present(spark: SparkSession, path: str) -> None:
    """Missing paths and zero-byte inputs are errors; only file status is read."""
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    matches = fs.globStatus(hadoop_path)
    if not matches:
        raise FileNotFoundError(f"Input log file not found: {path}")
    if sum(fs.getContentSummary(status.getPath()).getLength() for status in matches) == 0:
        raise ValueError(f"Input log file is empty: {path}")


def null_tokens_to_null(df: DataFrame) -> DataFrame:
    """CSV cells that spell a missing value become NULL."""
    columns = [F.col(f"`{name}`") for name in df.columns]
    return df.select(
        *[F.when(~c.isin(*NULL_TOKENS), c).alias(name) for c, name in zip(columns, df.columns)]
    )


def _csv_records(spark: SparkSession, path: str, multi_line: bool) -> tuple[DataFrame, Column]:
    """All records as text columns with their raw text and file, and whether a record has more cells than the header.

    Records with fewer cells lack the last ones. Only records that do not fit are split a second time.
    """
    reader = spark.read.options(header=True, inferSchema=False, multiLine=multi_line, escape='"', encoding="UTF-8")
    header = reader.csv(path).schema
    schema = StructType([*header.fields, StructField(CORRUPT, StringType())])
    records = reader.schema(schema).options(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, columnPruning=False).csv(path)
    cells = ", ".join(f"c{i} string" for i in range(len(header) + 1))
    last = F.from_csv(F.col(CORRUPT), cells, {"escape": '"', "mode": "PERMISSIVE"})[f"c{len(header)}"]
    return records.select("*", F.col("_metadata.file_path").alias(FILE)), F.col(CORRUPT).isNotNull() & last.isNotNull()


def _json_records(spark: SparkSession, path: str, lines: bool) -> tuple[DataFrame, Column]:
    """All records with their raw text and file, and whether a record could not be read."""
    records = spark.read.options(multiLine=not lines, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT).json(path)
    if not set(records.columns) - {CORRUPT}:
        raise ValueError(f"{NOT_VALID}: {path}")
    if CORRUPT not in records.columns:
        records = records.withColumn(CORRUPT, F.lit(None).cast("string"))
    return records.select("*", F.col("_metadata.file_path").alias(FILE)), F.col(CORRUPT).isNotNull()


def _with_a_cell(records: DataFrame) -> Column:
    """Always true; Spark refuses to read the raw text of records alone, so one cell is read too."""
    name = next(c for c in records.columns if c != CORRUPT)
    return F.length(F.concat_ws("", F.col(f"`{name}`").cast("string"))) >= 0


def _accepted(records: DataFrame, rejected: Column, keep_rejected: bool) -> DataFrame:
    """Records that could be read. Any other, early or late, ends the job that meets it, unless it is to be kept apart."""
    if keep_rejected:
        kept = records.filter(~F.coalesce(rejected, F.lit(False)) & _with_a_cell(records))
    else:
        said = F.concat(F.lit(f"{NOT_VALID}: "), F.col(FILE), F.lit(": "), F.substring(F.col(CORRUPT), 1, 200))
        kept = records.filter(F.when(rejected, F.raise_error(said).cast("boolean")).otherwise(_with_a_cell(records)))
    return kept.drop(CORRUPT, FILE)


def read_csv(spark: SparkSession, path: str, multi_line: bool = False, keep_rejected: bool = False) -> DataFrame:
    """Every column as text. Records that span lines need ``multi_line``, which makes each file one task."""
    return null_tokens_to_null(_accepted(*_csv_records(spark, path, multi_line), keep_rejected))


def read_json(spark: SparkSession, path: str, lines: bool, keep_rejected: bool = False) -> DataFrame:
    """An array of records per file, or one record per line (splittable)."""
    return _accepted(*_json_records(spark, path, lines), keep_rejected)


def rejected_records(spark: SparkSession, path: str, file_format: str | None = None, multi_line: bool = False) -> DataFrame:
    """source_file, record: what could not be read, for logs loaded with ``keep_rejected``."""
    kind = file_format or format_of(path)
    if kind == "parquet":
        return spark.createDataFrame([], ", ".join(f"{name} string" for name in REJECTED))
    records, rejected = _csv_records(spark, path, multi_line) if kind == "csv" else _json_records(spark, path, kind == "jsonl")
    found = records.filter(rejected & _with_a_cell(records))
    return found.select(F.col(FILE).alias(REJECTED[0]), F.col(CORRUPT).alias(REJECTED[1]))


@contextmanager
def input_errors() -> Iterator[None]:
    """Turns the error of a record that was met in a job into the error of the input."""
    try:
        yield
    except (PySparkException, Py4JJavaError) as error:
        found = re.search(rf"{NOT_VALID}: [^\n]*", str(error))
        if found is None:
            raise
        raise ValueError(found[0]) from error


def _check_utf8(df: DataFrame, path: str) -> None:
    """Undecodable bytes arrive as U+FFFD; finding one takes a scan of all text."""
    broken = [F.coalesce(F.col(f"`{name}`").contains("\ufffd"), F.lit(False)) for name, kind in df.dtypes if kind == "string"]
    if broken and not df.filter(reduce(lambda left, right: left | right, broken)).isEmpty():
        raise ValueError(f"Input log file is not valid UTF-8 text: {path}")


def load_logs(
    spark: SparkSession, path: str, file_format: str | None = None, multi_line: bool = False, check_utf8: bool = False,
    keep_rejected: bool = False,
) -> DataFrame:
    """Lazy scan of a log file, directory or glob, with the checks a caller expects before analysis.

    ``check_utf8`` reads everything once more, so it is a choice. Records that cannot be read are errors, also where a later
    job meets them (:func:`input_errors`); with ``keep_rejected`` they are left to :func:`rejected_records`.
    """
    kind = file_format or format_of(path)
    _check_present(spark, path)
    try:
        if kind == "csv":
            df = read_csv(spark, path, multi_line, keep_rejected)
        elif kind == "parquet":
            df = spark.read.parquet(path)
        else:
            df = read_json(spark, path, kind == "jsonl", keep_rejected)
        empty = df.isEmpty()
    except (PySparkException, Py4JJavaError) as error:
        raise ValueError(f"{NOT_VALID}: {path}") from error
    if empty:
        raise ValueError(f"Input log file contains no rows: {path}")
    if check_utf8:
        _check_utf8(df, path)
    return df
