"""Repeated passages across and inside documents: windows of words, dealt by prefixes of measured length.

Suffixes that share ``window`` words share a node of that depth in the suffix tree of the corpus, and all but the
earliest suffix under it start a passage that stands earlier. No tree is built: of its nodes only those of depth
``window`` matter, and hashes name them.

* A suffix is dealt by its anchor, the ``gram`` consecutive words with the smallest hash within its first ``window``
  words. Equal suffixes have equal anchors. Suffixes of one document that share an anchor travel as one row with a
  64-bit fingerprint of their ``window`` words each, so that a suffix is a node only by anchor and fingerprint together,
  128 bits.
* Suffixes are counted first, by ``2^BUCKET_BITS`` hash ranges of their anchors. Where a range holds more than
  ``GROUP_SUFFIXES``, its anchors are followed by as many bits of the fingerprint as bring the groups below that, so a
  phrase that stands in many places in differing surroundings is many groups.
* Each task first resolves what repeats among its own rows and sends on only the earliest suffix of each node, so a
  passage that a third of all documents share costs a group one row per task and not one per document.
* A group is read in sorted order, and only the nodes of the prefix at hand are held.

The deep nodes' later suffixes, joined where they overlap, are the maximal repeats, returned as word spans.

Cases: a null or blank text has no words; a text shorter than the window has no suffix; rows of one id and text are
one document; rows without an id, and different texts of one id, are documents of their own; a null id is the smallest; an
empty table gives an empty result; other columns are not read by :func:`repeat_spans`, which wants one text an id, and
pass through :func:`without_repeats`.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from fwlens.llm import words as _words
from fwlens.llm.row_keys import free_name, row_keyed

cloudpickle.register_pickle_by_value(_words)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW, GRAM = 20, 5
#: Suffixes resolved together inside a task before rows are sent; bounds the task's memory.
LOCAL_SUFFIXES = 1_000_000
#: Suffixes of a group from which its prefix is made longer, and hash ranges in which they are counted.
GROUP_SUFFIXES, BUCKET_BITS = 500_000, 16
_ROW = "prefix bigint, doc bigint, pos int, n int, nodes array<bigint>"
_SPAN = "doc bigint, pos int, n int"


def anchored(hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each suffix of at least ``window`` words: its anchor, the anchor's place and the fingerprint of its node."""
    count = len(hashes) - window + 1
    grams = _words.gram_hashes(hashes, gram)
    best, place = grams[:count].copy(), np.arange(count)
    for shift in range(1, window - gram + 1):
        other = grams[shift : shift + count]
        less = other < best
        best[less] = other[less]
        place[less] = np.flatnonzero(less) + shift
    return best, place, _words.gram_hashes(hashes, window, 11)


def _runs(*same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs; ``same`` tells for each element but the first whether it goes on."""
    goes_on = np.logical_and.reduce(same)
    starts = np.flatnonzero(np.concatenate(([True], ~goes_on)))
    return starts, np.diff(np.append(starts, len(goes_on) + 1))


def _later(prefix: np.ndarray, node: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Marks suffixes that are not the earliest of their node; rows come in the order of (doc, pos) within a node."""
    if not len(node):
        return np.zeros(0, dtype=bool)
    order = np.lexsort((node, prefix)) if len(prefix) else np.zeros(0, dtype=np.int64)
    p, f = prefix[order], node[order]
    first = np.concatenate(([True], (p[1:] != p[:-1]) | (f[1:] != f[:-1])))
    leader = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
    later = np.zeros(len(order), dtype=bool)
    later[order] = (doc[order] != doc[leader]) | (pos[order] != pos[leader])
    return later


def _spans(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive starts of one document as (doc, first, how many)."""
    if not len(doc):
        return doc, pos, pos
    starts, lengths = _runs(doc[1:] == doc[:-1], pos[1:] == pos[:-1] + 1)
    return doc[starts], pos[starts], lengths


def _bucket(anchor: np.ndarray) -> np.ndarray:
    return (_words.mixed(anchor) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _measured(window: int, gram: int):
    """Suffixes of a task by hash range of their anchors."""

    def run(batches):
        total = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                hashes = _words.word_hashes(_words.encoded(text.as_py()))
                if len(hashes) >= window:
                    total += np.bincount(_bucket(anchored(hashes, window, gram)[0]), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return run


def further_bits(documents: DataFrame, window: int, gram: int) -> np.ndarray:
    """Bits of the fingerprint that follow an anchor, by hash range."""
    counted = documents.select("text").mapInArrow(_measured(window, gram), "bucket bigint, n bigint")
    large = counted.groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > GROUP_SUFFIXES).collect()
    bits = np.zeros(1 << BUCKET_BITS, dtype=np.uint8)
    for row in large:
        # one bit more than an even division needs
        bits[row["bucket"]] = (row["n"] // GROUP_SUFFIXES).bit_length() + 1
    return bits


def prefixes(anchor: np.ndarray, node: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Anchors, hashed with the leading bits of the fingerprint where there are some."""
    more = bits[_bucket(anchor)].astype(np.uint64)
    long = np.flatnonzero(more)
    result = anchor.copy()
    with np.errstate(over="ignore"):
        lead = (node[long] >> (np.uint64(64) - more[long])) + np.uint64(1)
        result[long] = _words.mixed(anchor[long] + lead * np.uint64(0x9E3779B97F4A7C15))
    return result


def _sent(window: int, gram: int, bits: np.ndarray):
    """Rows for the groups from whole texts: spans that are settled inside the task, and the earliest suffixes."""

    def flush(held):
        held.sort(key=lambda item: item[0])
        docs = np.repeat(np.array([item[0] for item in held], dtype=np.int64), [len(item[1]) for item in held])
        prefix, place, node = (np.concatenate([item[i] for item in held]) for i in (1, 2, 3))
        pos = np.concatenate([np.arange(len(item[1])) for item in held])
        later = _later(prefix, node, docs, pos)
        doc, first, n = _spans(docs[later], pos[later])
        settled = pa.RecordBatch.from_arrays(
            [
                pa.array(_words.mixed(doc.view(np.uint64)).view(np.int64)), pa.array(doc), pa.array(first.astype(np.int32)),
                pa.array(n.astype(np.int32)), pa.nulls(len(doc), pa.list_(pa.int64())),
            ],
            names=["prefix", "doc", "pos", "n", "nodes"],
        )
        early = ~later
        d, q, x, a, f = docs[early], pos[early], prefix[early], place[early], node[early]
        starts, lengths = _runs(d[1:] == d[:-1], q[1:] == q[:-1] + 1, x[1:] == x[:-1], a[1:] == a[:-1])
        offsets = pa.array(np.append(starts, len(d)).astype(np.int32))
        return settled, pa.RecordBatch.from_arrays(
            [
                pa.array(x[starts].view(np.int64)), pa.array(d[starts]), pa.array(q[starts].astype(np.int32)),
                pa.array(lengths.astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(f.view(np.int64))),
            ],
            names=["prefix", "doc", "pos", "n", "nodes"],
        )

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = batch.column(1)
            for place, doc_id in enumerate(ids):
                hashes = _words.word_hashes(_words.encoded(texts[place].as_py()))
                if len(hashes) < window:
                    continue
                anchor, at, node = anchored(hashes, window, gram)
                held.append((doc_id, prefixes(anchor, node, bits), at, node))
                size += len(held[-1][1])
                if size >= LOCAL_SUFFIXES:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


def _resolved(batches):
    """Later suffixes of each group as spans; rows come sorted by prefix, document and place."""
    known = None
    for batch in batches:
        prefix, doc, pos, n = (batch.column(i).to_numpy() for i in range(4))
        nodes = batch.column(4)
        settled = np.asarray(nodes.is_null().to_numpy(zero_copy_only=False))
        if settled.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[settled]), pa.array(pos[settled]), pa.array(n[settled])], names=["doc", "pos", "n"]
            )
        rows = np.flatnonzero(~settled)
        if not len(rows):
            continue
        lengths = n[rows].astype(np.int64)
        node = nodes.flatten().to_numpy()
        x, d = np.repeat(prefix[rows], lengths), np.repeat(doc[rows], lengths)
        begins = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        q = np.repeat(pos[rows].astype(np.int64) - begins, lengths) + np.arange(len(node))
        skip = 0
        if known is not None and known[0][0] == x[0]:
            skip = len(known[0])
            x, node, d, q = (np.concatenate([old, new]) for old, new in zip(known, (x, node, d, q)))
        later = _later(x, node, d, q)
        last = (x == x[-1]) & ~later
        # of equal (document, place) rows one is enough
        known = (x[last], node[last], d[last], q[last])
        later[:skip] = False
        doc_of, first, count = _spans(d[later], q[later])
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc_of), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))], names=["doc", "pos", "n"]
        )


def repeat_spans(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc, pos, n``: n consecutive windows from word ``pos`` on that all stand earlier in the corpus."""
    bits = further_bits(documents, window, gram)
    rows = documents.select("doc_id", "text").mapInArrow(_sent(window, gram, bits), _ROW)
    dealt = rows.repartition("prefix").sortWithinPartitions("prefix", "doc", "pos")
    return dealt.mapInArrow(_resolved, _SPAN)


def kept_words(data: bytes, starts, counts, window: int) -> np.ndarray:
    """True for the words of a text that no span covers."""
    total = len(data.split())
    change = np.zeros(total + 1, dtype=np.int64)
    for start, count in zip(starts, counts):
        change[start] += 1
        change[min(total, start + count - 1 + window)] -= 1
    return np.cumsum(change[:-1]) == 0


def _digests(window: int):
    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(batch["doc_id"], batch["text"], batch["spans"]):
                data = _words.encoded(text)
                words = data.split()
                total = len(words)
                if spans is not None:
                    keep = kept_words(data, [s["pos"] for s in spans], [s["n"] for s in spans], window)
                    words = [word for word, good in zip(words, keep) if good]
                rows.append((doc_id, total, total - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
            frame = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return run


def _cut(window: int):
    def shorter(text, spans):
        if spans is None:
            return text
        data = _words.encoded(text)
        keep = kept_words(data, [s["pos"] for s in spans], [s["n"] for s in spans], window)
        inside = np.concatenate(([False], ~np.isin(np.frombuffer(data, dtype=np.uint8), (9, 10, 11, 12, 13, 32))))
        begins = np.flatnonzero(inside[1:] & ~inside[:-1])
        ends = np.append(begins[1:], len(data))
        left = b"".join(data[a:b] for a, b, good in zip(begins, ends, keep) if good).rstrip()
        return left.decode("utf-8", "surrogatepass") or None

    def run(batches):
        for batch in batches:
            batch["text"] = [shorter(text, spans) for text, spans in zip(batch["text"], batch["spans"])]
            batch["whole"] = batch["spans"].isna()
            yield batch.drop(columns="spans")

    return run


def _with_spans(keyed: DataFrame, key: str, window: int, gram: int) -> DataFrame:
    """doc (the key), doc_id, text, spans."""
    rows = keyed.select(F.col(key).alias("doc_id"), "text")
    spans = repeat_spans(rows, window, gram).groupBy("doc").agg(F.collect_list(F.struct("pos", "n")).alias("spans"))
    return keyed.select(F.col(key).alias("doc"), "doc_id", "text").join(spans, "doc", "left")


def repeat_digests(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    rows = _with_spans(*row_keyed(documents.select("doc_id", "text"), ["text"]), window, gram)
    return rows.select("doc_id", "text", "spans").mapInPandas(_digests(window), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def without_repeats(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Documents without the covered words, white space after kept words as it was; a document that loses its last
    word goes. All columns stay."""
    keyed, key = row_keyed(documents, ["text"])
    narrow = _with_spans(keyed, key, window, gram).select("doc", "text", "spans")
    cut = narrow.where("spans IS NOT NULL").mapInPandas(_cut(window), "doc bigint, text string, whole boolean")
    change = free_name(documents.columns, "change")
    texts = cut.select(F.col("doc").alias(key), F.struct("text").alias(change)).dropDuplicates([key])
    joined = keyed.join(texts, key, "left")
    was_cut, left = F.col(change).isNotNull(), F.col(change)["text"]
    kept = joined.where(~was_cut | left.isNotNull())
    text = F.when(was_cut, left).otherwise(F.col("text"))
    return kept.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in documents.columns])
