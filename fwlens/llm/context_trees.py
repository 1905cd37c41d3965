"""Language-model scores by context-tree weighting over bytes.

A text is a row of tokens: its words in lower case (A-Z), each closed by a blank, then one end sign. Each byte is coded as
eight binary decisions. Contexts are the ``DEPTH`` bytes before it, across blanks and words; before its first word a text
reads as a blank after end signs. Every context of every length, with every bit prefix, holds a Krichevsky-Trofimov
estimator over the training texts; each node weighs its own estimate against its longer contexts by their probability of
the training data, half and half beforehand. A text's score is the sum of log10 probabilities of its bytes, i.e. its
negative code length.

How it runs: each chunk of documents (about ``CHUNK_BYTES`` of text) sends its distinct (context, byte) pairs with their
training counts, as one row for each three latest context bytes. Pairs meet by these bytes, where depths 3 and more are
weighed in one pass over sorted keys. Depths 0 to 2 have at most 2^16 contexts, whatever the corpus; the driver weighs
them and sends them along. The pairs' probabilities go back to the chunks, which add them up along their own texts.
Distinct words with their counts go the same way, by ranges of their hashes, for ``n_known`` and the base score. Words, pairs
and logarithms travel as packed arrays, and the texts once.

Cases: a null or blank text is the end sign alone; repeated rows count as often as they stand there; a null id is in the
training part; an empty table, or one without training rows, scores by untrained estimators (one half a bit); other
columns are not read. ``documents`` must be a stored table, since chunks are named by scan partition.
"""

from __future__ import annotations

import sys
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from fwlens.llm import words as _words
from fwlens.llm.storage import stored

cloudpickle.register_pickle_by_value(_words)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DEPTH, TOP = 6, 3
CHUNK_BYTES = 24_000_000
#: Text whose words meet in one range of word hashes.
RANGE_BYTES = 16_000_000
#: Words that a task gathers before it sends some.
LOCAL_WORDS = 400_000
#: Pairs weighed together inside a task.
LOCAL_PAIRS = 300_000
#: Text whose pairs a task makes at once, and distinct pairs that it gathers before it sends some.
PIECE_BYTES = 4_000_000
HELD_PAIRS = 6_000_000
#: Text whose bytes are looked up together.
SCORE_BYTES = 1_000_000
END = b"\n"
#: What stands before a text.
_LEAD = END * (DEPTH - 1) + b" "
_HALF = np.log(0.5)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from learning: checksum of the id as text leaves remainder 2 by 7."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after raising small arguments by recurrence."""
    low = x < 12
    shift = np.where(low, 12.0, 0.0)
    y = x + shift
    inverse = 1 / y
    square = inverse * inverse
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + inverse * (
        1 / 12 - square * (1 / 360 - square * (1 / 1260 - square * (1 / 1680 - square / 1188)))
    )
    if low.any():
        z = x[low]
        product = np.zeros_like(z)
        for step in range(12):
            product += np.log(z + step)
        series[low] -= product
    return series


def weigh(key: np.ndarray, count: np.ndarray, depth: int, low: int, children=None):
    """Weighs the nodes of depths ``depth`` down to ``low`` that are above distinct keys with ``depth`` context bytes.

    Returns, per key, ``a, b`` of eight bits each, so that a bit's probability is a + b * (that of the next deeper
    contexts), b being 0 where no deeper ones exist; and the log probabilities of the nodes of depth ``low`` as
    ``(node keys, values)`` for each of the eight bit levels. ``children`` are such lists of depth + 1.
    """
    a, b = np.zeros((len(key), 8)), np.ones((len(key), 8))
    for d in range(depth, low - 1, -1):
        context = (key >> (8 * (depth - d + 1))) & ((1 << (8 * d)) - 1)
        short = (context << 8) | (key & 255)
        unique, inverse = np.unique(short, return_inverse=True)
        n = np.bincount(inverse, count, len(unique))
        leaf = children is None
        found = []
        for level in range(8):
            node = unique >> (8 - level)
            if not len(node):
                found.append((node, np.zeros(0)))
                continue
            first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            of = np.cumsum(np.concatenate(([True], node[1:] != node[:-1]))) - 1
            bit = (unique >> (7 - level)) & 1
            total, ones = np.add.reduceat(n, first), np.add.reduceat(n * bit, first)
            own = log_gamma(ones + 0.5) + log_gamma(total - ones + 0.5) - log_gamma(total + 1) - np.log(np.pi)
            nodes = node[first]
            if leaf:
                mixed, share = own, np.ones(len(node))
            else:
                child, value = children[level]
                parent = ((child >> (level + 8)) << level) | (child & ((1 << level) - 1))
                deeper = np.bincount(np.searchsorted(nodes, parent), value, len(nodes))
                mixed = _HALF + np.logaddexp(own, deeper)
                share = np.exp(_HALF + own - mixed)[of]
            hits = np.where(bit == 1, ones[of], (total - ones)[of])
            chance = (hits + 0.5) / (total[of] + 1)
            s, c = share[inverse], chance[inverse]
            # p = s c + (1 - s)(a + b q)
            a[:, level] = s * c + (1 - s) * a[:, level]
            b[:, level] = (1 - s) * b[:, level]
            found.append((nodes, mixed))
        children = found
    return a, b, children


def _two_bytes(pair: np.ndarray) -> np.ndarray:
    """A key cut to its two latest context bytes."""
    return (((pair >> (8 * (DEPTH - TOP + 2))) & 0xFFFF) << 8) | (pair & 255)


def _parents(pair: np.ndarray, n: np.ndarray, nodes):
    code = _two_bytes(pair)
    unique, inverse = np.unique(code, return_inverse=True)
    yield pd.DataFrame({"level": -1, "code": unique, "value": np.bincount(inverse, n, len(unique))})
    for level, (node, value) in enumerate(nodes):
        parent = ((node >> (level + 8)) << level) | (node & ((1 << level) - 1))
        unique, inverse = np.unique(parent, return_inverse=True)
        yield pd.DataFrame({"level": level, "code": unique, "value": np.bincount(inverse, value, len(unique))})


def _top(table: pd.DataFrame):
    """Weighs depths 0 to 2."""
    part = lambda level: table[table["level"] == level].sort_values("code")
    counts = part(-1)
    key = counts["code"].to_numpy(dtype=np.int64)
    # sums per parent stand for one child each
    children = []
    for level in range(8):
        rows = part(level)
        code = rows["code"].to_numpy(dtype=np.int64)
        children.append((((code >> level) << (level + 8)) | (code & ((1 << level) - 1)), rows["value"].to_numpy(dtype=float)))
    a, b, _ = weigh(key, counts["value"].to_numpy(dtype=float), TOP - 1, 0, children)
    return key, a, b


def sequence(tokens: list[bytes]) -> bytes:
    """The bytes of a text with what stands before it; the first ``DEPTH`` are not coded."""
    return _LEAD + b" ".join(tokens) + (b" " if tokens else b"") + END


def _pieces(text: bytes):
    """A sequence as shorter ones that code the same bytes after the same contexts."""
    for first in range(0, len(text) - DEPTH, PIECE_BYTES):
        yield text[first : first + PIECE_BYTES + DEPTH]


def keys_of(texts: list[bytes]) -> np.ndarray:
    """(context, byte) keys of all coded bytes of sequences; the latest context byte is the highest, the byte the lowest."""
    flat = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.int64)
    key = np.zeros(len(flat) - DEPTH, dtype=np.int64)
    for back in range(1, DEPTH + 1):
        key <<= 8
        key |= flat[DEPTH - back : len(flat) - back]
    key <<= 8
    key |= flat[DEPTH:]
    # what a sequence begins with has no byte of the one before as its context
    ends = np.cumsum([len(t) for t in texts])[:-1]
    coded = np.ones(len(key), dtype=bool)
    coded[(ends[:, None] - DEPTH + np.arange(DEPTH)).ravel()] = False
    return key[coded]


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of several tables with the sums of their counts."""
    if len(parts) == 1:
        return parts[0]
    unique, inverse = np.unique(np.concatenate([key for key, _ in parts]), return_inverse=True)
    return unique, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(unique)).astype(np.int64)


def _counted(texts: list[bytes], training: bool) -> tuple[np.ndarray, np.ndarray]:
    key = np.sort(keys_of(texts))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    n = np.diff(np.append(first, len(key)))
    return key[first], n if training else np.zeros(len(first), dtype=np.int64)


def _packed(values: np.ndarray) -> bytes:
    """Numbers as bytes, all highest ones together, and so on, since neighbours mostly agree in these."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _packed_logs(log: np.ndarray) -> bytes:
    """Logarithms to 36 bits after the leading one, which is 2e-11 of each, as planes of bytes."""
    return np.ascontiguousarray(((log.view(np.uint64) + np.uint64(1 << 15)) >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def _unpacked_logs(data: bytes) -> np.ndarray:
    whole = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    whole[:, 2:] = np.frombuffer(data, dtype=np.uint8).reshape(6, -1).T
    return whole.view(float).ravel()


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(width, -1).T).view(kind).ravel()


def _word_requests(ranges: int):
    """Distinct tokens of each chunk with their training counts, one row for each range of word hashes."""

    def run(batches):
        held: dict[int, Counter] = {}
        others: dict[int, set] = {}
        for batch in batches:
            chunks, texts, outs = batch.column(0), batch.column(1), batch.column(2)
            for place in range(batch.num_rows):
                chunk = chunks[place].as_py()
                tokens = _words.encoded(texts[place].as_py(), lower=True).split()
                tokens.append(END)
                if outs[place].as_py():
                    others.setdefault(chunk, set()).update(tokens)
                else:
                    held.setdefault(chunk, Counter()).update(tokens)
            # a chunk that has gathered much is sent in parts, which add up
            while sum(map(len, held.values())) + sum(map(len, others.values())) > LOCAL_WORDS:
                chunk = max(set(held) | set(others), key=lambda c: len(held.get(c, ())) + len(others.get(c, ())))
                yield from _word_rows(chunk, held.pop(chunk, Counter()), others.pop(chunk, set()), ranges)
        for chunk in set(held) | set(others):
            yield from _word_rows(chunk, held.pop(chunk, Counter()), others.pop(chunk, set()), ranges)

    return run


def _word_rows(chunk: int, held: Counter, others: set, ranges: int):
    words = [*held, *others.difference(held)]
    counts = np.zeros(len(words), dtype=np.int64)
    counts[: len(held)] = list(held.values())
    of = np.fromiter((zlib.crc32(word) % ranges for word in words), dtype=np.int64, count=len(words))
    order = np.lexsort((np.array([word[:8] for word in words]), of))
    starts = np.flatnonzero(np.diff(of[order], prepend=-1))
    spans = list(zip(starts, np.append(starts[1:], len(order))))
    for first in range(0, len(spans), 2000):
        part = spans[first : first + 2000]
        columns = [
            pa.array([int(of[order[a]]) for a, _ in part], pa.int64()), pa.array([chunk] * len(part), pa.int64()),
            pa.array([_line(words[i] for i in order[a:b]) for a, b in part], pa.binary()), pa.array([_packed(counts[order[a:b]]) for a, b in part], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["range_no", "chunk", "words", "counts"])


def _line(words) -> bytes:
    """Words as one value; the end sign, which is what parts them, stands as an empty word."""
    return END.join(b"" if word == END else word for word in words)


_REPLY = pa.schema([("chunk", pa.int64()), ("words", pa.binary()), ("counts", pa.binary()), ("tokens", pa.int64()), ("kinds", pa.int64())])


def _word_replies(batches):
    """The words of each request with their counts in the whole training part; and per range one row of sums without a
    chunk. Rows come sorted by range."""

    def answered(requests):
        sums: dict[bytes, int] = {}
        for _, line, counts in requests:
            for word, n in zip(line.split(END), counts.tolist()):
                sums[word] = sums.get(word, 0) + n
        rows = [(chunk, line, _packed(np.array([sums[word] for word in line.split(END)], dtype=np.int64)), None, None) for chunk, line, _ in requests]
        rows.append((None, None, None, sum(sums.values()), sum(n > 0 for n in sums.values())))
        for first in range(0, len(rows), 2000):
            part = rows[first : first + 2000]
            yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*part), _REPLY)], schema=_REPLY)

    requests, last = [], None
    for batch in batches:
        ranges, chunks, lines, counts = (batch.column(i) for i in range(4))
        for row in range(batch.num_rows):
            if ranges[row].as_py() != last and requests:
                yield from answered(requests)
                requests = []
            last = ranges[row].as_py()
            requests.append((chunks[row].as_py(), lines[row].as_py(), _unpacked(counts[row].as_py(), np.int64)))
    if requests:
        yield from answered(requests)


def _asked(batches):
    """Distinct pairs of each chunk with their training counts, one row for each three latest context bytes."""
    texts: dict[tuple[int, bool], list[bytes]] = {}
    sizes: Counter = Counter()
    found: dict[int, list] = {}

    def settle(place):
        found.setdefault(place[0], []).append(_counted(texts.pop(place), not place[1]))
        del sizes[place]
        if sum(len(key) for key, _ in found[place[0]][1:]) > len(found[place[0]][0][0]):
            found[place[0]] = [_added(found[place[0]])]

    for batch in batches:
        chunks, bodies, outs = batch.column(0), batch.column(1), batch.column(2)
        for row in range(batch.num_rows):
            place = chunks[row].as_py(), outs[row].as_py()
            for piece in _pieces(sequence(_words.encoded(bodies[row].as_py(), lower=True).split())):
                texts.setdefault(place, []).append(piece)
                sizes[place] += len(piece)
                if sizes[place] >= PIECE_BYTES:
                    settle(place)
        while sum(sizes.values()) > 4 * PIECE_BYTES:
            settle(max(sizes, key=sizes.get))
        # a chunk that has gathered much is sent in parts, which add up
        while sum(len(key) for parts in found.values() for key, _ in parts) > HELD_PAIRS:
            chunk = max(found, key=lambda c: sum(len(key) for key, _ in found[c]))
            yield from _asked_rows(chunk, *_added(found.pop(chunk)))
    for place in list(texts):
        settle(place)
    for chunk in list(found):
        yield from _asked_rows(chunk, *_added(found.pop(chunk)))


def _asked_rows(chunk: int, key: np.ndarray, n: np.ndarray):
    below = 8 * (DEPTH - TOP + 1)
    subtree, pair = key >> below, (key & ((1 << below) - 1)).astype(np.uint32)
    starts = np.flatnonzero(np.concatenate(([True], subtree[1:] != subtree[:-1])))
    ends = np.append(starts[1:], len(key))
    for first in range(0, len(starts), 2000):
        spans = list(zip(starts[first : first + 2000], ends[first : first + 2000]))
        columns = [
            pa.array(subtree[starts[first : first + 2000]]), pa.array([chunk] * len(spans), pa.int64()),
            pa.array([_packed(pair[a:b]) for a, b in spans], pa.binary()), pa.array([_packed(n[a:b]) for a, b in spans], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["subtree", "chunk", "pairs", "counts"])


def _whole_subtrees(batches):
    """Some hundred thousand distinct pairs with their counts, and the chunks' requests ``(chunk, subtree, pairs)`` for
    them; rows come sorted by subtree. Counts are added up as they come."""
    below = 8 * (DEPTH - TOP + 1)
    requests, parts, loose, last = [], [], 0, None
    for batch in batches:
        subtrees, chunks, pairs, counts = (batch.column(i) for i in range(4))
        for row in range(batch.num_rows):
            subtree = subtrees[row].as_py()
            if subtree != last and loose + (len(parts[0][0]) if parts else 0) >= LOCAL_PAIRS:
                yield (*_added(parts), requests)
                requests, parts, loose = [], [], 0
            last = subtree
            blob = pairs[row].as_py()
            requests.append((chunks[row].as_py(), subtree, blob))
            key = (np.int64(subtree) << below) | _unpacked(blob, np.uint32).astype(np.int64)
            parts.append((key, _unpacked(counts[row].as_py(), np.int64)))
            loose += len(key)
            if loose > max(LOCAL_PAIRS, len(parts[0][0])):
                parts, loose = [_added(parts)], 0
    if requests:
        yield (*_added(parts), requests)


def _upward(batches):
    """What depths 0 to 2 need: log probabilities of depth-3 nodes, and counts, added up per context of two bytes."""
    for pair, n, _ in _whole_subtrees(batches):
        _, _, nodes = weigh(pair, n, DEPTH, TOP)
        for frame in _parents(pair, n, nodes):
            yield pa.RecordBatch.from_pandas(frame.astype({"level": "int32", "value": float}), preserve_index=False)


def _answers(top):
    """log10 probability of each asked pair, to the chunk that asked."""
    top_key, top_a, top_b = top
    below = 8 * (DEPTH - TOP + 1)

    def run(batches):
        for pair, n, requests in _whole_subtrees(batches):
            a, _, _ = weigh(pair, n, DEPTH, TOP)
            place = np.searchsorted(top_key, _two_bytes(pair))
            log = np.log10(top_a[place] + top_b[place] * a).sum(axis=1)
            for first in range(0, len(requests), 500):
                part = requests[first : first + 500]
                logs = []
                for _, subtree, blob in part:
                    key = (np.int64(subtree) << below) | _unpacked(blob, np.uint32).astype(np.int64)
                    logs.append(_packed_logs(log[np.searchsorted(pair, key)]))
                columns = [
                    pa.array([chunk for chunk, _, _ in part], pa.int64()), pa.array([subtree for _, subtree, _ in part], pa.int64()),
                    pa.array([blob for _, _, blob in part], pa.binary()), pa.array(logs, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "subtree", "pairs", "logs"])

    return run


def _sequence_scores(total: int, kinds: int):
    unseen = np.log10(1.0 / (total + kinds + 1))
    below = 8 * (DEPTH - TOP + 1)

    def run(documents: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        lines, pairs = answers[answers["pairs"].isna()], answers[answers["pairs"].notna()]
        number = {word or END: i for i, word in enumerate(word for line in lines["words"] for word in line.split(END))}
        n = np.concatenate([_unpacked(counts, np.int64) for counts in lines["counts"]]).astype(float)
        base = np.log10(n + 1) + unseen
        known = [
            (np.int64(subtree) << below) | _unpacked(blob, np.uint32).astype(np.int64)
            for subtree, blob in zip(pairs["subtree"], pairs["pairs"])
        ]
        known = np.concatenate(known) if known else np.zeros(0, dtype=np.int64)
        order = np.argsort(known)
        known, log = known[order], (np.concatenate([_unpacked_logs(logs) for logs in pairs["logs"]]) if len(pairs) else np.zeros(0))[order]
        rows, score, texts, owners, size = [], np.zeros(len(documents)), [], [], 0

        def add():
            key = keys_of(texts)
            by_key = np.argsort(key)
            key = key[by_key]
            # equal keys are looked up once
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            of_byte = np.empty(len(key))
            of_byte[by_key] = np.repeat(log[np.searchsorted(known, key[first])], np.diff(np.append(first, len(key))))
            lengths = np.array([len(t) - DEPTH for t in texts])
            np.add.at(score, owners, np.add.reduceat(of_byte, np.cumsum(lengths) - lengths))

        for doc_id, text, out in zip(documents["doc_id"], documents["text"], documents["held_out"]):
            tokens = _words.encoded(text, lower=True).split()
            for piece in _pieces(sequence(tokens)):
                texts.append(piece)
                owners.append(len(rows))
                size += len(piece)
                if size >= SCORE_BYTES:
                    add()
                    texts, owners, size = [], [], 0
            tokens.append(END)
            at = np.fromiter(map(number.__getitem__, tokens), dtype=np.int64, count=len(tokens))
            rows.append((doc_id, out, len(tokens), int((n[at] > 0).sum()), total, base[at].sum(), len(text.encode("utf-8", "surrogatepass")) if text else 0))
        if texts:
            add()
        frame = pd.DataFrame(rows, columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "n_bytes"])
        frame.insert(6, "score", score)
        frame["doc_id"] = frame["doc_id"].astype("Int64")
        return frame

    return run


_SCORED = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint"
)


def _chunked(documents: DataFrame) -> tuple[DataFrame, int]:
    """Rows with their chunk, and the number of word ranges, which grows with the texts."""
    rows = documents.select("doc_id", "text", held_out().alias("held_out"), F.spark_partition_id().alias("scan"))
    sizes = rows.groupBy("scan").agg(F.sum(F.octet_length("text")).alias("size"))
    largest, total = sizes.agg(F.max("size"), F.sum("size")).first()
    ways = max(1, -(-(largest or 0) // CHUNK_BYTES))
    chunk = (F.col("scan") * ways + F.pmod(F.xxhash64("doc_id"), F.lit(ways))).cast("bigint")
    return rows.withColumn("chunk", chunk).select("chunk", "doc_id", "text", "held_out"), max(8, -(-(total or 0) // RANGE_BYTES))


def score_sequences(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte (null for an empty text).

    The pairs serve two jobs; they stay on the executors' disks as long as the session keeps its cache.
    """
    rows, ranges = _chunked(documents)
    read = rows.select("chunk", "text", "held_out")
    requests = read.mapInArrow(_word_requests(ranges), "range_no bigint, chunk bigint, words binary, counts binary")
    in_ranges = requests.repartition("range_no").sortWithinPartitions("range_no")
    replies = stored(in_ranges.mapInArrow(_word_replies, "chunk bigint, words binary, counts binary, tokens bigint, kinds bigint"))
    total, kinds = replies.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "kinds")]).first()
    asked = read.mapInArrow(_asked, "subtree bigint, chunk bigint, pairs binary, counts binary")
    dealt = asked.repartition("subtree").sortWithinPartitions("subtree").persist(StorageLevel.DISK_ONLY)
    sums = dealt.mapInArrow(_upward, "level int, code bigint, value double")
    top = _top(sums.groupBy("level", "code").agg(F.sum("value").alias("value")).toPandas())
    answers = dealt.mapInArrow(_answers(top), "chunk bigint, subtree bigint, pairs binary, logs binary")
    wanted = replies.where("chunk IS NOT NULL").select("chunk", "words", "counts").unionByName(answers, allowMissingColumns=True)
    result = rows.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInPandas(_sequence_scores(total, kinds), _SCORED)
    return _with_bits(result)


def _with_bits(result: DataFrame) -> DataFrame:
    bits = -F.col("score") / F.log10(F.lit(2.0)) / F.when(F.col("n_bytes") > 0, F.col("n_bytes"))
    return result.withColumn("bits_per_byte", bits).drop("n_bytes")
