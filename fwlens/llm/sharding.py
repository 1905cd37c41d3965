"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Native: DataFrame functions only. Rows are numbered by (doc_id, checksum, size); a permutation of 0..n-1 that is a
short formula moves row ``i`` to position ``p``; shard ``p % shards``, slot ``p div shards``. Anybody who knows n, the
seed and the row number computes shard and slot without a table (:func:`place`), and shard sizes differ by one row at
most (law ``rows``).

Cases: a null text has size 1 and the checksum of the empty text; null ids sort first; repeated rows are numbered one
after the other and are interchangeable; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from fwlens.session import checkpointed

#: Even, so that both halves end on their own side of the grid.
ROUNDS = 6
SEED = 20240229


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """Odd multiplier and summand of each round, below 2^31, from a linear congruence over the seed."""
    keys, state = [], seed % 2**31
    for _ in range(rounds):
        pair = []
        for _ in range(2):
            state = (state * 1103515245 + 12345) % 2**31
            pair.append(state)
        keys.append((pair[0] | 2**30 | 1, pair[1]))
    return keys


def grid(n: int) -> tuple[int, int]:
    """Sides of the smallest near-square grid that holds n cells; less than one row of cells stays over."""
    wide = math.isqrt(max(n - 1, 0)) + 1
    return wide, max(1, -(-n // wide))


def _steps(number, wide: int, high: int, keys):
    """One pass of the network over integers or integer arrays."""
    left, right = number % wide, number // wide
    for i, (factor, summand) in enumerate(keys):
        y = right * factor + summand
        left, right = right, (left + (y ^ (y >> 16))) % (high if i % 2 else wide)
    return left + wide * right


def walks_needed(n: int, seed: int = SEED) -> int:
    """Longest walk from a surplus cell back into 0..n-1; there are fewer surplus cells than the square root of n.

    A surplus cell that comes back to itself is never reached from a row, so its circle is left out."""
    wide, high = grid(n)
    origins = np.arange(n, wide * high if n else 0, dtype=np.int64)
    cells, walks, keys = origins, 0, round_keys(seed)
    while len(cells):
        cells = _steps(cells, wide, high, keys)
        on = (cells >= n) & (cells != origins)
        cells, origins = cells[on], origins[on]
        walks += 1
    return walks


def place(number: int, n: int, shards: int, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of one row number, computed alone."""
    wide, high = grid(n)
    keys = round_keys(seed)
    position = _steps(number, wide, high, keys)
    while position >= n:
        position = _steps(position, wide, high, keys)
    return position % shards, position // shards


def permuted(number: Column, n: int, seed: int = SEED) -> Column:
    """Position of a row number after the shuffle."""
    wide, high = grid(n)
    rounds = F.array(*[
        F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(c).cast("bigint").alias("c"), F.lit(high if i % 2 else wide).cast("bigint").alias("m"))
        for i, (a, c) in enumerate(round_keys(seed))
    ])
    side = F.lit(wide).cast("bigint")

    def turned(state, key):
        y = state["r"] * key["a"] + key["c"]
        return F.struct(state["r"].alias("l"), ((state["l"] + y.bitwiseXOR(F.shiftright(y, 16))) % key["m"]).alias("r"))

    def once(cell):
        start = F.struct((cell % side).alias("l"), F.call_function("div", cell, side).alias("r"))
        return F.aggregate(rounds, start, turned, lambda s: s["l"] + side * s["r"])

    walks = walks_needed(n, seed)
    position = once(number)
    if walks:
        again = F.sequence(F.lit(1), F.lit(walks))
        position = F.aggregate(again, position, lambda p, _: F.when(p < n, p).otherwise(once(p)))
    return position


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``row_no``, 0.. in the given order, without gathering the rows: a range-partitioned sort is stored once,
    and each partition adds the number of rows before it."""
    local = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = checkpointed(sorted_rows.withColumns({"part_no": F.spark_partition_id(), "local_no": local}))
    sizes = stored.groupBy("part_no").agg(F.count(F.lit(1)).alias("part_rows"))
    before = Window.orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part_no", F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("part_start"))
    joined = stored.join(starts, "part_no")
    return joined.withColumn("row_no", F.col("part_start") + F.col("local_no")).drop("part_no", "local_no", "part_start")


def shard_documents(documents: DataFrame, shards: int = 8, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), row_no."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    table = numbered(rows, "doc_id", "text_crc32", "size")
    n = table.count()
    position = permuted(F.col("row_no"), n, seed)
    placed = table.withColumn("position", position)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("position") % shards).cast("int").alias("shard"),
        F.call_function("div", F.col("position"), F.lit(shards).cast("bigint")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_no",
    )
