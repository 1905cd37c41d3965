"""Best-fit packing of documents into fixed-length token sequences by bin completion with branch and bound.

Only lengths matter, and there are at most ``capacity`` of them. Spark tokenises and counts pieces by length; bin
completion runs on that bounded histogram and returns fillings with multiplicities; Spark then gives the r-th piece of
each length its place in a filling, r being found from counts per partition and length. Nothing of the size of the
input passes through the driver, one task or one group.

The search is on the driver, within a number of nodes that is a parameter; how far it may be from the best packing is known
from the lower bound (:attr:`Packing.gap`).

Cases: a null text packs as an empty one (its end id alone); repeated rows are packed as often as they stand there; an
empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from itertools import islice
from types import ModuleType
from typing import Iterator, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from fwlens.session import checkpointed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 2048
#: Nodes of a search and steps inside them, open nodes that keep their options, and copies of one length that the test for
#: dominance looks at.
SEARCH_NODES, SEARCH_STEPS, OPEN_NODES, MOST_COPIES = 20_000, 4_000_000, 64, 64
MEMO_WORDS = 1_200_000
#: Bytes of text that are taken apart at once.
SLICE_BYTES = 8 << 20
#: Kinds of bytes of lower-cased UTF-8 text. Runs of letters, single digits and runs of marks are parts of their own for the
#: tokenizer's splitting rule; it has rules for what follows an apostrophe, which is no mark here.
SPACE, LETTER, DIGIT, MARK, OTHER = range(5)
_KIND = np.full(256, OTHER, dtype=np.uint8)
_KIND[list(b" \t\n\x0b\x0c\r")] = SPACE
_KIND[list(b"abcdefghijklmnopqrstuvwxyz\xc3")] = LETTER
_KIND[list(b"0123456789")] = DIGIT
_KIND[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = MARK
#: Bytes that make a letter with a byte C3 in front: U+00DF to U+00FF without the sign of division.
_SECOND = np.zeros(256, dtype=bool)
_SECOND[[*range(0x9F, 0xB7), *range(0xB8, 0xC0)]] = True
_LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
#: Special tokens are found in the text as it stands, and a capital may compose with a mark otherwise than its small letter.
_CASED = "<[|]|[\u0300-\u036f]"
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


class Parts(NamedTuple):
    """Parts of several texts: their bytes without blanks, where each part begins, and each text's first part, with the ends."""

    data: np.ndarray
    begins: np.ndarray
    rows: np.ndarray


def parts_of(texts: pa.LargeStringArray) -> Parts:
    """Texts without nulls cut into chunks free of blanks, and these where the tokenizer cuts them anyway.

    A chunk with a byte of no kind, or with what may begin a special token, stays whole.
    """
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    if not len(raw):
        return Parts(raw, np.zeros(1, dtype=np.int64), np.zeros(len(bounds), dtype=np.int64))
    codes = _LOWER[raw]
    seconds = np.flatnonzero(raw[:-1] == 0xC3) + 1
    capital = seconds[(raw[seconds] < 0x9F) & (raw[seconds] != 0x97)]
    codes[capital] += 32
    for row in np.flatnonzero(pc.match_substring_regex(texts, _CASED).to_numpy(zero_copy_only=False)):
        codes[bounds[row] : bounds[row + 1]] = raw[bounds[row] : bounds[row + 1]]
    kinds = _KIND[codes]
    kinds[seconds[_SECOND[codes[seconds]]]] = LETTER
    special = np.flatnonzero(codes[:-1] == ord("<"))
    kinds[special[codes[special + 1] == ord("|")]] = OTHER

    inside = kinds != SPACE
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    starts = bounds[:-1][bounds[:-1] < len(raw)]
    opens[starts] = inside[starts]
    data, kinds, opens = codes[inside], kinds[inside], opens[inside]
    cut = kinds == DIGIT
    cut[1:] |= kinds[1:] != kinds[:-1]
    odd = np.flatnonzero(kinds == OTHER)
    if len(odd):
        chunks = np.flatnonzero(opens)
        whole = np.zeros(len(chunks), dtype=bool)
        whole[np.searchsorted(chunks, odd, side="right") - 1] = True
        cut &= ~np.repeat(whole, np.diff(chunks, append=len(data)))
    begins = np.append(np.flatnonzero(cut | opens), len(data))
    sizes = [np.count_nonzero(inside[begin:end]) for begin, end in zip(bounds[:-1], bounds[1:])]
    return Parts(data, begins, np.searchsorted(begins, np.cumsum([0, *sizes])))


class WordIds(dict):
    """Ids of a part as little-endian bytes; the tokenizer drops white space and cuts between parts, so parts are independent."""

    def __init__(self, path: str):
        # tasks are the parallel units; threads inside a task only compete with them
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)

        ids = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(ids.values()) + 1, dtype=bool)
        self.closes[[number for token, number in ids.items() if token.endswith("</w>")]] = True

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        # a text with unpaired surrogates cannot reach the tokenizer; Arrow has replaced them already
        return [np.asarray(found.ids, dtype="<u4") for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_words(self, words: list[bytes]) -> None:
        """Runs of letters: each ends with the one closing token, so that many are read as one text."""
        for first in range(0, len(words), 10_000):
            part = words[first : first + 10_000]
            lines = [part[i : i + 200] for i in range(0, len(part), 200)]
            for line, ids in zip(lines, self._encoded([b" ".join(line).decode("utf-8") for line in lines])):
                ends = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
                data = ids.tobytes()
                if len(ends) != len(line):
                    raise ValueError("words and closing tokens differ in number")
                for word, begin, end in zip(line, [0, *ends], ends):
                    self[word] = data[begin:end]

    def learn(self, parts: list[bytes]) -> None:
        """Adds parts by the tokenizer itself, whose work is left to each part's first time."""
        letters, others = [], []
        for part in parts:
            (letters if part.isalpha() or _LETTERS.fullmatch(part) else others).append(part)
        self._learn_words(letters)
        for first in range(0, len(others), 5000):
            part = others[first : first + 5000]
            for chunk, ids in zip(part, self._encoded([c.decode("utf-8") for c in part])):
                self[chunk] = ids.tobytes()

    def ids_of(self, texts: pa.Array) -> Iterator[memoryview]:
        """Ids of several texts; each of their distinct parts is looked up, or learnt, once."""
        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        data, begins, rows = parts_of(texts)
        buffers = [None, pa.py_buffer(begins.astype(np.int64, copy=False)), pa.py_buffer(data)]
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins) - 1, buffers).dictionary_encode()
        distinct = found.dictionary.to_pylist()
        new = [part for part in distinct if part not in self]
        if len(self) + len(new) > MEMO_WORDS:
            self.clear()
            new = distinct
        self.learn(new)
        ids = pa.array([self[part] for part in distinct], pa.large_binary()).take(found.indices)
        ends = np.frombuffer(ids.buffers()[1], dtype=np.int64)[rows].tolist() if len(ids) else [0] * len(rows)
        joined = memoryview(ids.buffers()[2] or b"")
        for begin, end in zip(ends, ends[1:]):
            yield joined[begin:end]

    def ids(self, text: str | None) -> bytes:
        return bytes(next(self.ids_of([text])))


def _remembered(path: str) -> WordIds:
    """The chunks that this Python process has met in earlier tasks; they serve any task, in any order."""
    held = sys.modules.setdefault("_fwlens_word_ids", ModuleType("_fwlens_word_ids")).__dict__
    if path not in held:
        held[path] = WordIds(path)
    return held[path]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``SLICE_BYTES`` of text, a longer text on its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(ends):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + SLICE_BYTES, side="right")))
        yield first, last
        first = last


def _piece_rows(path: str, capacity: int, end_id: int, keep_ids: bool):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]

    def run(batches):
        memo = _remembered(path)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            numbers, texts = batch.column("doc_id").cast(pa.int64()), batch.column("text")
            for first, last in _slices(texts):
                rows = []
                for at, data in enumerate(memo.ids_of(texts.slice(first, last - first)), first):
                    data = bytes(data) + end
                    for piece, start in enumerate(range(0, len(data), 4 * capacity)):
                        cut = data[start : start + 4 * capacity]
                        row = (at, piece, start // 4, len(cut) // 4, zlib.crc32(cut))
                        rows.append(row + ((np.frombuffer(cut, dtype="<u4").astype(np.int32),) if keep_ids else ()))
                at, *columns = zip(*rows)
                columns = [numbers.take(pa.array(at, pa.int64()))] + [pa.array(c, kind) for c, kind in zip(columns, kinds[1:])]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def token_pieces(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if keep_ids else "")
    return documents.select("doc_id", "text").mapInArrow(_piece_rows(tokenizer_path, capacity, end_id, keep_ids), schema)


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Fillings with multiplicities; bins of equal content are handled together, and rooms just made count too."""
    open_bins: dict[int, list[tuple[dict[int, int], int]]] = {}
    rooms = 0  # bit r: some bin has room r

    def put(room: int, content: dict[int, int], times: int) -> None:
        nonlocal rooms
        open_bins.setdefault(room, []).append((content, times))
        rooms |= 1 << room

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            large = rooms >> length
            if not large:
                fit = min(capacity // length, left)
                put(capacity - fit * length, {length: fit}, left // fit)
                left -= left // fit * fit
                continue
            room = length + (large & -large).bit_length() - 1
            content, times = open_bins[room].pop()
            # as many copies as still fit beside each other keep the bins of one kind together
            fit = min(room // length, max(1, left // times))
            used = min(times, left // fit)
            if used < times:
                open_bins[room].append((content, times - used))
            if not open_bins[room]:
                rooms &= ~(1 << room)
            put(room - fit * length, content | {length: content.get(length, 0) + fit}, used)
            left -= used * fit
    return [bin_ for bins in open_bins.values() for bin_ in bins]


def _shifted(bits: int, span: int) -> int:
    """Bit s is set if one of the bits s to s + span is."""
    done = 0
    while done < span:
        step = min(done + 1, span - done)
        bits |= bits >> step
        done += step
    return bits


def dominated(content: dict[int, int], stock: list[int], lengths: list[int], lost: int) -> bool:
    """Whether an item left out fits besides, or in place of a shorter one or of several that are no longer together.

    Then a filling with that item is no worse, as what it replaces fits wherever the item would have gone.
    """
    outside = sum(1 << length for length in lengths if stock[length] > content.get(length, 0))
    if outside & ((1 << (lost + 1)) - 1):
        return True
    single = sum(1 << length for length in content)
    if lost and _shifted(outside >> 1, lost - 1) & single:
        return True
    one = several = 0
    for length, n in content.items():
        for _ in range(min(n, MOST_COPIES)):
            several |= (one | several) << length
            one |= 1 << length
    return bool(_shifted(outside, lost) & several)


class Work:
    """Steps that a search may still take."""

    def __init__(self, steps: int):
        self.left = steps

    def done(self, steps: int) -> bool:
        """Takes some steps; whether none are left."""
        self.left -= steps
        return self.left < 0


def fillings(stock: list[int], room: int, most_lost: int, work: Work) -> Iterator[tuple[int, dict[int, int]]]:
    """All undominated fillings of ``room`` that leave at most ``most_lost`` of it, least first, one at a time, as far as the
    steps go.

    ``reach[i]`` has a bit for each sum of items from the i-th length on, so that the search, longest items first, never
    enters a branch without a filling.
    """
    lengths = [length for length in range(min(room, len(stock) - 1), 0, -1) if stock[length]]
    reach, mask = [1] * (len(lengths) + 1), (1 << (room + 1)) - 1
    if work.done(len(lengths)):
        return
    for i in range(len(lengths) - 1, -1, -1):
        bits, n, step = reach[i + 1], min(stock[lengths[i]], room // lengths[i]), 1
        while n:
            copies = min(step, n)
            bits |= (bits << (lengths[i] * copies)) & mask
            n, step = n - copies, step * 2
        reach[i] = bits
    for lost in range(min(most_lost, room) + 1):
        pending = [(0, room - lost, None)]
        while pending:
            i, left, taken = pending.pop()
            if work.done(1):
                return
            if not reach[i] >> left & 1:
                continue
            if not left:
                content = {}
                while taken:
                    at, n, taken = taken
                    content[lengths[at]] = n
                if work.done(len(lengths)):
                    return
                if not dominated(content, stock, lengths, lost):
                    yield lost, content
                continue
            # most copies come first
            for n in range(min(stock[lengths[i]], left // lengths[i]) + 1):
                pending.append((i + 1, left - n * lengths[i], (i, n, taken) if n else taken))


class Packing(NamedTuple):
    """Fillings with multiplicities, how many bins no packing goes below, and the nodes that the search took."""

    bins: list[tuple[dict[int, int], int]]
    bound: int
    nodes: int

    @property
    def gap(self) -> int:
        """Bins above the bound; 0 means that the packing is proven to be the best."""
        return sum(times for _, times in self.bins) - self.bound


def complete_bins(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = SEARCH_NODES, steps: int = SEARCH_STEPS) -> Packing:
    """Few bins for a histogram of lengths: bin completion around the longest item left, with best fit as incumbent.

    A node fixes the filling of as many bins as the counts allow. Depth first, each node tries all undominated fillings, least
    waste first, that leave the waste below the incumbent's; no branch is dropped. The search ends when the incumbent
    reaches the lower bound, when all branches are done, or after ``nodes`` nodes or ``steps`` steps inside them with the
    best packing so far, whose distance from the bound is its ``gap``.
    """
    work = Work(steps)
    counts = {length: n for length, n in counts.items() if n}
    total = sum(length * n for length, n in counts.items())
    # items over half a sequence need one each; others fill what those leave
    bound = max(-(-total // capacity), sum(n for length, n in counts.items() if 2 * length > capacity))
    best = best_fit_decreasing(counts, capacity)
    fewest = sum(times for _, times in best)

    def options(stock: list[int], waste: int) -> Iterator[tuple[int, dict[int, int]]]:
        longest = max(length for length, n in enumerate(stock) if n)
        rest = list(stock)
        rest[longest] -= 1
        for lost, filling in fillings(rest, capacity - longest, (fewest - 1) * capacity - total - waste, work):
            yield lost, filling | {longest: filling.get(longest, 0) + 1}

    # each open node: stock, bins and waste so far, fillings on the way, its options and how many of them are done
    stack, looked = [[[counts.get(length, 0) for length in range(capacity + 1)], 0, 0, None, None, 0]] if counts else [], 0
    while stack and looked < nodes and work.left > 0 and fewest > bound:
        node = stack[-1]
        stock, bins, waste, way, choices, done = node
        if choices is None:
            # the nodes far up give their options back for memory and make them again
            choices = node[4] = islice(options(stock, waste), done, None)
            if len(stack) > OPEN_NODES:
                stack[-OPEN_NODES - 1][4] = None
        choice = next(choices, None)
        if choice is None:
            stack.pop()
            continue
        node[5] += 1
        looked += 1
        lost, content = choice
        times = min(stock[length] // n for length, n in content.items())
        spent = waste + lost * times
        if spent > (fewest - 1) * capacity - total:
            continue
        rest = list(stock)
        for length, n in content.items():
            rest[length] -= n * times
        way = (content, times, way)
        if any(rest):
            stack.append([rest, bins + times, spent, way, None, 0])
        elif bins + times < fewest:
            best, fewest = [], bins + times
            while way:
                best.append(way[:2])
                way = way[2]
    return Packing(best, bound, looked)


def _intervals(bins: list[tuple[dict[int, int], int]]) -> pd.DataFrame:
    """For each length and filling: the ranks it serves, the first sequence, copies per sequence and their offset."""
    rows, first, seen = [], 0, {}
    for content, times in bins:
        offset = 0
        for length in sorted(content, reverse=True):
            k = content[length]
            rows.append((length, seen.get(length, 0), first, k, offset))
            seen[length] = seen.get(length, 0) + k * times
            offset += k * length
        first += times
    return pd.DataFrame(rows, columns=["length", "rank", "first", "copies", "offset"]).sort_values(["length", "rank"], ignore_index=True)


def _ranked(batches):
    """Adds the rank of each piece among those of its length in this partition."""
    seen = np.zeros(0, dtype=np.int64)
    for batch in batches:
        lengths = batch["length"].to_numpy()
        if not len(lengths):
            continue
        if lengths.max() >= len(seen):
            seen = np.concatenate([seen, np.zeros(lengths.max() + 1 - len(seen), dtype=np.int64)])
        batch["rank"] = seen[lengths] + batch.groupby("length").cumcount().to_numpy()
        seen += np.bincount(lengths, minlength=len(seen))
        yield batch


def _placed(plan: pd.DataFrame):
    def run(batches):
        key = plan["length"].to_numpy() * (1 << 44) + plan["rank"].to_numpy()
        for batch in batches:
            rank = (batch["rank"] + batch["before"]).to_numpy()
            at = np.searchsorted(key, batch["length"].to_numpy() * (1 << 44) + rank, side="right") - 1
            row = plan.iloc[at]
            within = rank - row["rank"].to_numpy()
            copies = row["copies"].to_numpy()
            batch["sequence_id"] = row["first"].to_numpy() + within // copies
            batch["offset"] = row["offset"].to_numpy() + within % copies * batch["length"].to_numpy()
            yield batch.drop(columns=["part", "rank", "before"])

    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = SEARCH_NODES) -> DataFrame:
    """Adds sequence_id and offset to a table with a ``length`` column (1 to capacity)."""
    stored = checkpointed(pieces).withColumn("part", F.spark_partition_id())
    per_part = checkpointed(stored.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {row["length"]: row["n"] for row in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = _intervals(complete_bins(histogram, capacity, nodes).bins)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = per_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema.fields)
    ranked = stored.mapInPandas(_ranked, f"{fields}, rank bigint").join(before, ["part", "length"])
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*pieces.columns, "part", "rank", "before").mapInPandas(_placed(plan), f"{own}, sequence_id bigint, offset bigint")


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 [, ids], sequence_id, offset."""
    return pack_pieces(token_pieces(documents, tokenizer_path, capacity, keep_ids=keep_ids), capacity)
