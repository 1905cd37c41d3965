"""One number for each distinct row, for tables whose ids are missing or name several rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fwlens.llm.storage import stored


def free_name(columns: list[str], wanted: str) -> str:
    """A name that no column has, case aside."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def row_keyed(documents: DataFrame, columns: list[str]) -> tuple[DataFrame, str]:
    """The table with one more column, and that column's name: equal for rows that agree in ``doc_id`` and ``columns``,
    else different, and in the order of ``doc_id``, null first.

    Ids serve as keys if none is null and none stands for different rows; otherwise the distinct rows, each named by 128
    bits of hash, are sorted by range and numbered.
    """
    key, *names = [free_name(documents.columns, name) for name in ("row_key", "row_mark_a", "row_mark_b")]
    cells = [F.col("doc_id"), *[F.col(f"`{c}`") for c in columns if c != "doc_id"]]
    # hashes pass over nulls
    content = [*[c.isNull() for c in cells], *cells]
    marks = [F.xxhash64(*content).alias(names[0]), F.xxhash64(F.lit("row"), *content).alias(names[1])]
    narrow = documents.select("doc_id", *marks)
    differ = [F.min(m) != F.max(m) for m in names]
    if narrow.groupBy("doc_id").agg((differ[0] | differ[1]).alias("differs")).where("doc_id IS NULL OR differs").isEmpty():
        return documents.withColumn(key, F.col("doc_id")), key
    order = [F.col("doc_id").asc_nulls_first(), *names]
    ranged = narrow.distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = stored(ranged.select(F.monotonically_increasing_id().alias(key), *names))
    return documents.select("*", *marks).join(numbered, names).drop(*names), key
