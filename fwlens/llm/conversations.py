"""Repair of damaged conversations by their cheapest edits: a dynamic program with checkpoints at square-root distance.

A conversation is to read ``(s?(ua)+)?`` by the initials of its roles. Keeping a row costs nothing, giving it another role
1, deleting it 2, inserting an empty one 5; blank and repeated rows must go; a truncated row that stays costs 5. The
state is the last role so far (none, system, user, assistant), so what the rest of a conversation costs is a vector of
four numbers per row, found from the back.

* Equal rows of one turn are one unit with a count: all but the first must go, at a fixed cost.
* Units are numbered by a range-partitioned sort and cut into blocks of the square root of their conversation's length,
  of ``block_rows`` at least. Only at block ends are vectors stored: blocks turn into 4 x 4 matrices of costs, which are
  chained from the back, and the states at block starts are chained from the front. So no task ever holds more than one
  block's rows or the square root of a conversation's blocks.
* A block is walked forward with vectors recomputed from its own checkpoints, again at square-root distance. Of edits that
  keep the cost tight the walk takes the ASCII-least: D, I, K, R.

Cases: nulls in any column read as one blank, but a null ``turn`` counts for no gap and sorts first, and rows without
``conv_id`` are one conversation; rows of one turn are ordered by role and text; repeated rows are repeats in the sense
of the rules; a role that is none of the three can be replaced or deleted only; an empty table gives an empty result; other
columns are not read. A digest of a whole conversation is a chain, so its rows stream through one task, in constant memory
but for the audit, which the result wants in one cell.
"""

from __future__ import annotations

import hashlib
import math
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from fwlens.llm.sharding import numbered
from fwlens.session import checkpointed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 4096
FAR = 1 << 60
INSERT, DELETE, REROLE, BROKEN = 5, 2, 1, 5
_WORD, _CLOSED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
#: States: nothing yet, after a system row, after a user row, after an assistant row. Initials: s, u, a, another.
_NEXT = (2, 2, 3, 2)
_KEPT = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
_ROLES = {"u": "user", "a": "assistant"}
#: Cost of the end of a conversation with the closing inserts, by state; and without, where it may end at all.
_END, _MAY_END = (0, 2 * INSERT, INSERT, 0), (True, False, False, True)
_TOKEN = re.compile("I[ua]|R[ua]|[DK]")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after the damage, which a hash of conversation and turn deals out: conv_key, turn, role, text, copies."""
    blank = F.lit(" ")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("bigint")
    dealt = F.crc32(F.concat(F.coalesce(conv, blank), F.lit(":"), F.coalesce(turn.cast("string"), blank))) % 20
    text = F.coalesce(F.col("text"), blank)
    rows = conversations.select(conv_key().alias("conv_key"), turn.alias("turn"), F.coalesce("role", blank).alias("role"), text.alias("text"), dealt.alias("dealt"))
    changed = F.when(F.col("dealt") == 1, "").when(F.col("dealt") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.where("dealt != 0").select(
        "conv_key", "turn", F.when(F.col("dealt") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"),
        F.when(F.col("dealt") == 3, 2).otherwise(1).alias("copies"),
    )


def conv_key():
    """Text that names a conversation, the one without an id included."""
    return F.coalesce(F.concat(F.lit(":"), F.col("conv_id").cast("string")), F.lit(""))


def _before(after, code: int, n: int) -> tuple[int, int, int, int]:
    """Costs by state in front of a unit, from those behind it."""
    initial, fault = code % 4, code // 4
    fixed = DELETE * (n - 1)
    plain = []
    for state in range(4):
        best = DELETE * n + after[state]
        if fault < 2:
            rest = fixed + BROKEN * fault
            best = min(best, REROLE + rest + after[_NEXT[state]])
            kept = _KEPT[state][initial]
            if kept > 0:
                best = min(best, rest + after[kept])
        plain.append(best)
    user, assistant = min(plain[2], INSERT + plain[3]), min(plain[3], INSERT + plain[2])
    return min(plain[0], INSERT + user), min(plain[1], INSERT + user), user, assistant


def costs(codes: list[int], counts: list[int]) -> list[int]:
    """Least costs from each state in front of a block to each state behind it, row by row of the 4 x 4 matrix."""
    columns = []
    for goal in range(4):
        vector = tuple(0 if state == goal else FAR for state in range(4))
        for code, n in zip(reversed(codes), reversed(counts)):
            vector = _before(vector, code, n)
        columns.append(vector)
    return [min(columns[goal][state], FAR) for state in range(4) for goal in range(4)]


def edits(codes: list[int], counts: list[int], end, state: int, closing: bool) -> tuple[list[str], int]:
    """The ASCII-least tight edits of each unit and the state behind the block.

    An edit is D or K, or R or I with the initial of the role it gives; inserts stand in front of a unit, closing ones
    behind the last. All copies of a unit but the first are deleted without being named.
    """
    size = len(codes)
    step = max(1, math.isqrt(size))
    saved, vector = {}, tuple(end)
    for i in range(size, 0, -1):
        if i % step == 0 or i == size:
            saved[i] = vector
        vector = _before(vector, codes[i - 1], counts[i - 1])
    done: list[str] = []
    for first in range(0, size, step):
        last = min(first + step, size)
        block = [saved[last]]
        for i in range(last, first, -1):
            block.append(_before(block[-1], codes[i - 1], counts[i - 1]))
        block.reverse()
        for i in range(first, last):
            here, after = block[i - first], block[i - first + 1]
            initial, fault, n = codes[i] % 4, codes[i] // 4, counts[i]
            said = ""
            while True:
                if here[state] == DELETE * n + after[state]:
                    said += "D"
                    break
                onward = _NEXT[state]
                if here[state] == INSERT + here[onward]:
                    said += "I" + " ?ua"[onward]
                    state = onward
                    continue
                kept = _KEPT[state][initial]
                if kept > 0 and here[state] == DELETE * (n - 1) + BROKEN * fault + after[kept]:
                    said += "K"
                    state = kept
                else:
                    said += "R" + " ?ua"[onward]
                    state = onward
                break
            done.append(said)
    while closing and not _MAY_END[state]:
        state = _NEXT[state]
        done[-1] += "I" + " ?ua"[state]
    return done, state


def _mapped(rows_of, schema: pa.Schema):
    """Arrow batches through a function from one row's values to rows."""

    def run(batches):
        for batch in batches:
            columns = [column.to_pylist() for column in batch.columns]
            found = [row for values in zip(*columns) for row in rows_of(*values)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(zip(*found), schema)], schema=schema)

    return run


_LONG_LIST = pa.list_(pa.int64())


def _ends(blocks: DataFrame) -> DataFrame:
    """conv_key, block, ends: what the rest of the conversation costs behind each block, by state."""
    matrix = pa.schema([("conv_key", pa.string()), ("block", pa.int64()), ("matrix", _LONG_LIST)])
    tables = blocks.select("conv_key", "block", "codes", "counts").mapInArrow(
        _mapped(lambda key, block, codes, counts: [(key, block, costs(codes, counts))], matrix),
        "conv_key string, block bigint, matrix array<bigint>",
    )

    def chained(key, parts):
        end = list(_END)
        for part in reversed(parts):
            yield key, part["block"], end
            table = part["matrix"]
            end = [min(table[4 * state + goal] + end[goal] for goal in range(4)) for state in range(4)]

    out = pa.schema([("conv_key", pa.string()), ("block", pa.int64()), ("ends", _LONG_LIST)])
    grouped = tables.groupBy("conv_key").agg(F.sort_array(F.collect_list(F.struct("block", "matrix"))).alias("parts"))
    return grouped.mapInArrow(_mapped(chained, out), "conv_key string, block bigint, ends array<bigint>")


def _entries(blocks: DataFrame) -> DataFrame:
    """conv_key, block, entry: the state in which the walk comes to each block."""
    reached = pa.schema([("conv_key", pa.string()), ("block", pa.int64()), ("reached", pa.list_(pa.int32()))])
    tables = blocks.select("conv_key", "block", "codes", "counts", "ends").mapInArrow(
        _mapped(
            lambda key, block, codes, counts, ends: [(key, block, [edits(codes, counts, ends, state, False)[1] for state in range(4)])],
            reached,
        ),
        "conv_key string, block bigint, reached array<int>",
    )

    def chained(key, parts):
        state = 0
        for part in parts:
            yield key, part["block"], state
            state = part["reached"][state]

    out = pa.schema([("conv_key", pa.string()), ("block", pa.int64()), ("entry", pa.int32())])
    grouped = tables.groupBy("conv_key").agg(F.sort_array(F.collect_list(F.struct("block", "reached"))).alias("parts"))
    return grouped.mapInArrow(_mapped(chained, out), "conv_key string, block bigint, entry int")


def edited(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Units of ``(conv_key, turn, role, text, copies)`` with their faults and edits, numbered in their order.

    row_no, conv_key, turn, role, text, n, code (initial + 4 x fault; 0 none, 1 truncated, 2 repeated, 3 blank), edit.
    """
    units = rows.groupBy("conv_key", "turn", "role", "text").agg(F.sum("copies").cast("bigint").alias("n"))
    placed = numbered(units, "conv_key", "turn", "role", "text")
    # one unit of each role and text is the earliest of its conversation
    said = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    earliest = placed.groupBy("conv_key", said.alias("said")).agg(F.min("row_no").alias("row_no"))
    firsts = earliest.select("row_no", F.lit(True).alias("is_first"))
    fault = (
        F.when(~F.col("text").rlike(_WORD), 3).when(F.col("is_first").isNull(), 2)
        .when(~F.col("text").rlike(_CLOSED), 1).otherwise(0)
    )
    initial = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    faulted = checkpointed(placed.join(firsts, "row_no", "left").withColumn("code", initial + 4 * fault).drop("is_first"))

    narrow = faulted.select("conv_key", "row_no", "code", "n")
    sizes = narrow.groupBy("conv_key").agg(F.min("row_no").alias("start"), F.count(F.lit(1)).alias("size"))
    length = F.greatest(F.lit(block_rows).cast("bigint"), F.ceil(F.sqrt("size")).cast("bigint"))
    sizes = sizes.withColumn("length", length)
    cut = narrow.join(sizes, "conv_key").withColumn("block", F.call_function("div", F.col("row_no") - F.col("start"), F.col("length")))
    units_of = F.sort_array(F.collect_list(F.struct("row_no", "code", "n")))
    blocks = cut.groupBy("conv_key", "start", "size", "length", "block").agg(units_of.alias("units")).select(
        "conv_key", "block", (F.col("start") + F.col("block") * F.col("length")).alias("first"),
        (F.col("start") + (F.col("block") + 1) * F.col("length") >= F.col("start") + F.col("size")).alias("closing"),
        (F.col("size") > F.col("length")).alias("several"),
        F.col("units.code").alias("codes"), F.col("units.n").alias("counts"),
    )
    blocks = checkpointed(blocks)
    several = blocks.where("several").select("conv_key", "block", "codes", "counts")
    ends = checkpointed(_ends(several))
    entries = _entries(several.join(ends, ["conv_key", "block"]))
    joints = ends.join(entries, ["conv_key", "block"])
    ready = blocks.join(joints, ["conv_key", "block"], "left").select("first", "codes", "counts", "ends", "entry", "closing")

    def walked(first, codes, counts, end, entry, closing):
        found, _ = edits(codes, counts, end or _END, entry or 0, closing)
        return [(first + i, said) for i, said in enumerate(found)]

    out = pa.schema([("row_no", pa.int64()), ("edit", pa.string())])
    table = ready.mapInArrow(_mapped(walked, out), "row_no bigint, edit string")
    return faulted.join(table, "row_no")


def _lines(role: str, text: str, edit: str):
    """Role and text of what a unit leaves, and the named edits."""
    for token in _TOKEN.findall(edit):
        if token == "K":
            yield role, text
        elif token != "D":
            yield _ROLES[token[1]], text if token[0] == "R" else ""


def repaired(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of the repaired conversations: conv_key, row_no of the unit they come from, line in it, role, text."""
    out = pa.schema([("conv_key", pa.string()), ("row_no", pa.int64()), ("line", pa.int32()), ("role", pa.string()), ("text", pa.string())])
    found = edited(damaged(conversations), block_rows)

    def lines(key, row_no, role, text, edit):
        return [(key, row_no, i, *line) for i, line in enumerate(_lines(role, text, edit))]

    return found.select("conv_key", "row_no", "role", "text", "edit").mapInArrow(
        _mapped(lines, out), "conv_key string, row_no bigint, line int, role string, text string"
    )


_DIGEST = pa.schema(
    [("conv_key", pa.string()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
     ("audit", pa.string()), ("repaired_sha256", pa.string())]
)


class _Tally:
    """What one conversation adds up to, unit by unit."""

    def __init__(self, key: str):
        self.key, self.sums, self.audit, self.hash = key, dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0), [], hashlib.sha256()
        self.low = self.high = self.role = None
        self.turns = self.lines = 0

    def add(self, turn, role, text, code, n, edit):
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        sums, fault = self.sums, code // 4
        sums["blank"] += n * (fault == 3)
        sums["duplicate"] += n * (fault == 2) or (n - 1) * (fault < 2)
        sums["truncated"] += fault == 1
        mark = role[:1]
        sums["illegal"] += (n - 1) + (self.role is not None and self.role + mark not in ("su", "ua", "au"))
        self.role = mark
        for token in _TOKEN.findall(edit):
            kind = token[0]
            sums["cost"] += {"D": DELETE, "I": INSERT, "K": BROKEN * (fault == 1), "R": REROLE + BROKEN * (fault == 1)}[kind]
            self.audit.append(kind)
            if kind != "I" and n > 1:
                self.audit.append("D" * (n - 1))
        sums["cost"] += DELETE * (n - 1)
        for line in _lines(role, text, edit):
            self.hash.update(("\n" * (self.lines > 0) + ":".join(line)).encode("utf-8", "surrogatepass"))
            self.lines += 1

    def row(self):
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.key, gaps, *self.sums.values(), "".join(self.audit), self.hash.hexdigest())


def _digested(batches):
    tally = None
    for batch in batches:
        rows = []
        for key, *unit in zip(*[column.to_pylist() for column in batch.columns]):
            if tally is None or tally.key != key:
                if tally:
                    rows.append(tally.row())
                tally = _Tally(key)
            tally.add(*unit)
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(_DIGEST.names, row)) for row in rows], schema=_DIGEST)
    if tally:
        yield pa.RecordBatch.from_pylist([dict(zip(_DIGEST.names, tally.row()))], schema=_DIGEST)


def repair_digests(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""
    found = edited(damaged(conversations), block_rows)
    in_order = found.select("conv_key", "row_no", "turn", "role", "text", "code", "n", "edit").repartition("conv_key").sortWithinPartitions("conv_key", "row_no")
    fields = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'bigint'}" for f in _DIGEST)
    digests = in_order.drop("row_no").mapInArrow(_digested, fields)
    ids = conversations.select("conv_id").distinct().withColumn("conv_key", conv_key())
    sums = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in _DIGEST.names[1:7]]
    empty = hashlib.sha256().hexdigest()
    return ids.join(digests, "conv_key", "left").select(
        "conv_id", *sums, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256")
    )
