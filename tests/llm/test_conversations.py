"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from fwlens.llm import conversations as op

SCHEMA = "conv_id bigint, turn bigint, role string, text string, place string"


def damage(rows):
    """Rows after the damage by conversation, in order."""
    found = {}
    for conv, turn, role, text, _ in rows:
        found.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (turn is not None, turn or 0, "user" if kind == 4 else role, text)
        found[conv] += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {conv: sorted(kept) for conv, kept in found.items()}


def best(rows):
    """The digest of one conversation by memoised search: least cost, then least audit."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))

    def after(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))

    @lru_cache(None)
    def search(i, state, inserts):
        options = []
        if i == len(rows) and state in ("", "a"):
            options.append((0, "", ()))
        if inserts < 3:
            for role in ("user", "assistant"):
                if after(state, role[0]):
                    cost, audit, lines = search(i, after(state, role[0]), inserts + 1)
                    options.append((cost + 5, "I" + audit, (f"{role}:", *lines)))
        if i < len(rows):
            _, _, role, text = rows[i]
            cost, audit, lines = search(i + 1, state, 0)
            options.append((cost + 2, "D" + audit, lines))
            if faults[i] in ("", "truncated"):
                extra = 5 * (faults[i] == "truncated")
                for letter, name, price in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                    if after(state, name[:1]):
                        cost, audit, lines = search(i + 1, after(state, name[:1]), 0)
                        options.append((cost + price + extra, letter + audit, (f"{name}:{text}", *lines)))
        return min(options, default=(10**9, "", ()))

    cost, audit, lines = search(0, "", 0)
    turns = [turn for known, turn, _, _ in rows if known]
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"),
        faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def conversations(seed, ids=40, most=14):
    chance = random.Random(seed)
    rows = []
    for conv in [*range(ids), None]:
        for turn in range(chance.randint(1, most)):
            role = chance.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = chance.choice(["Yes.", "No", "Why?", " \t", "", None, "End! ", f"{turn}.", f"{turn}"])
            rows.append((conv, chance.choice([turn, turn, turn, turn // 2, None]), role, text, "x"))
    return rows + rows[:25]


def digests(table, **options):
    return {row[0]: tuple(row[1:]) for row in op.repair_digests(table, **options).collect()}


@pytest.mark.parametrize("block_rows", [1, 3, 4096])
def test_digests_equal_plain_search(spark, block_rows):
    rows = conversations(block_rows)
    found = digests(spark.createDataFrame(rows, SCHEMA).repartition(3), block_rows=block_rows)
    assert found == {conv: best(kept) for conv, kept in damage(rows).items()}


def test_long_conversation_in_blocks_of_the_square_root(spark):
    rows = [(7, i, "user" if i % 2 else "assistant", f"{i % 50}." if i % 3 else f"{i}", "x") for i in range(700)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert digests(table, block_rows=2) == digests(table) and digests(table)[7][0] > 0


def test_edits_from_checkpoints_equal_one_block():
    chance = random.Random(3)
    for size in (1, 2, 9, 50):
        codes = [chance.choice([0, 1, 2, 3, 5, 6, 9, 12]) for _ in range(size)]
        counts = [chance.choice([1, 1, 3]) for _ in codes]
        whole, _ = op.edits(codes, counts, op._END, 0, True)
        cut = size // 2
        table = op.costs(codes[cut:], counts[cut:])
        middle = [min(table[4 * s + goal] + op._END[goal] for goal in range(4)) for s in range(4)]
        first, state = op.edits(codes[:cut], counts[:cut], middle, 0, False)
        rest, _ = op.edits(codes[cut:], counts[cut:], op._END, state, True)
        assert first + rest == whole


def test_no_rows_left_and_empty_table(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256().hexdigest()
    assert digests(spark.createDataFrame([(gone, 0, "user", "Hi.", "x")], SCHEMA)) == {gone: (0, 0, 0, 0, 0, 0, "", empty)}
    assert digests(spark.createDataFrame([], SCHEMA)) == {}


def test_repaired_rows_alternate(spark):
    rows = op.repaired(spark.createDataFrame(conversations(5), SCHEMA)).orderBy("conv_key", "row_no", "line").collect()
    marks = {}
    for row in rows:
        marks[row["conv_key"]] = marks.get(row["conv_key"], "") + row["role"][0]
    assert marks and all(re.fullmatch("s?(ua)+", found) for found in marks.values())
