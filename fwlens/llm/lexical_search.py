"""Exact ranked search over posting lists that are blocked by document similarity.

* The items come in blocks of ``ITEM_BLOCK``, so that what the driver and the tasks hold of them is bounded. One scan of all
  whole texts turns each document into its length and its occurrences of the block's terms; these vectors are stored, and
  document frequencies, the number of documents and their total length are sums over them.
* Tasks cut the vectors into shards of at most ``SHARD_POSTINGS`` postings. In a shard each term's posting list is
  clustered on its own: some documents of the list are pivots, every other one joins the pivot whose sketch (random
  projections of the weighted vector) points most nearly its way, and clusters are cut into blocks of ``BLOCK_DOCS``.
* A block keeps, for every term of its documents, the largest impact among them. The product of that summary with an
  item's weights bounds the score of each document in the block, exactly, as impacts and weights are whole numbers.
* An item visits the blocks of its terms by falling bound, scores their documents in full, and leaves out a block only if its
  bound is below the k-th best score so far. Blocks that tie are visited, since an equal score with a smaller id ranks
  before. Each shard returns its k best, and Spark ranks those.

Cases: a null or empty text has no terms and takes no part in the counts; an item without terms, or whose terms stand
nowhere, has no rows; repeated rows are documents, and items, of their own; a null ``doc_id`` ranks before others of its
score; an empty table gives an empty result; other columns are not read; long texts are read piece by piece.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from fwlens.llm.sharding import numbered
from fwlens.llm.storage import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ITEM_BLOCK, SHARD_POSTINGS, BLOCK_DOCS, SKETCH = 1000, 400_000, 128, 16
#: Fixed values of the score: saturation, length share and scale.
SHARE, SCALE, SATURATION = 75, 1_000_000_000, 8
_PIECE = 1 << 20
#: Digits, letters (in lower case) and all bytes of other characters stand; the rest separates.
_LOWER = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def term_pieces(text: str | None):
    """Lists of the terms of a text, about a MB at a time."""
    data = text.encode("utf-8", "surrogatepass").translate(_LOWER) if text else b""
    start = 0
    while start < len(data):
        end = len(data)
        if end - start > _PIECE:
            end = data.find(b" ", start + _PIECE)
            end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def _vectors(vocabulary):
    """doc_id, n, terms (rising numbers) and their occurrences."""

    def run(batches):
        known = {term: number for number, term in enumerate(vocabulary.value)}
        for batch in batches:
            lengths, sizes, terms, times = [], [0], [], []
            for text in batch.column(1):
                n, found = 0, Counter()
                for piece in term_pieces(text.as_py()):
                    n += len(piece)
                    found.update(map(known.get, piece))
                found.pop(None, None)
                numbers = sorted(found)
                lengths.append(n)
                terms += numbers
                times += map(found.__getitem__, numbers)
                sizes.append(len(terms))
            offsets = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(lengths, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))],
                names=["doc_id", "n", "terms", "times"],
            )

    return run


def _frequencies(size: int):
    """Documents of a task that hold each term, and at -1 and -2 how many hold any and how long they are."""

    def run(batches):
        held, some, long = np.zeros(size, dtype=np.int64), 0, 0
        for batch in batches:
            n = batch.column(0).to_numpy()
            some, long = some + int((n > 0).sum()), long + int(n.sum())
            held += np.bincount(batch.column(1).flatten().to_numpy(), minlength=size)
        terms = np.concatenate([[-1, -2], np.flatnonzero(held)])
        counts = np.concatenate([[some, long], held[held > 0]])
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(counts, pa.int64())], names=["term", "n"])

    return run


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(times: np.ndarray, lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What an occurrence count is worth in a document of some length; below 10^6."""
    # whole numbers without a bound, as lengths times documents may pass 64 bits
    damping = np.array([100 - SHARE + SHARE * n * documents // total for n in lengths.tolist()], dtype=np.int64)
    times = times.astype(np.int64)
    return SCALE * times // (1000 * times + SATURATION * damping)


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of several runs, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class TermBlocks:
    """One term's posting list in blocks: documents, block starts, and per block the largest impact of each term."""

    def __init__(self, docs, starts, terms, largest):
        self.docs, self.starts, self.terms, self.largest = docs, starts, terms, largest

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """No document of a block scores more than this."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        known = self.terms[at] == terms
        return self.largest[:, at[known]].astype(np.int64) @ weights[known]


class Shard:
    """Documents as rows of (term, impact), and the blocked posting lists of their terms."""

    def __init__(self, doc_ids, sizes, terms, values, weights, block_docs: int = BLOCK_DOCS):
        self.doc_ids, self.sizes, self.terms, self.values = doc_ids, sizes, terms, values
        self.starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        signs = np.random.default_rng(11).choice(np.array([-1, 1], dtype=np.float32), (len(weights), SKETCH))
        drawn = signs[terms] * (weights[terms] * values).astype(np.float32)[:, None]
        sketch = np.zeros((len(sizes), SKETCH), dtype=np.float32)
        filled = np.flatnonzero(sizes)
        if len(filled):
            sketch[filled] = np.add.reduceat(drawn, self.starts[filled], axis=0)
        sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
        order = np.argsort(terms, kind="stable")
        first = np.flatnonzero(np.diff(terms[order], prepend=-1))
        self.lists = {}
        for low, high in zip(first, np.append(first[1:], len(order))):
            self.lists[int(terms[order[low]])] = self._blocked(owner[order[low:high]], sketch, block_docs)

    def _blocked(self, docs, sketch, block_docs) -> TermBlocks:
        cluster = np.zeros(len(docs), dtype=np.int64)
        if len(docs) > block_docs:
            pivots = docs[:: max(1, block_docs // 2)]
            cluster = (sketch[docs] @ sketch[pivots].T).argmax(axis=1)
            order = np.argsort(cluster, kind="stable")
            docs, cluster = docs[order], cluster[order]
        begins = np.flatnonzero(np.diff(cluster, prepend=-1))
        within = np.arange(len(docs)) - np.repeat(begins, np.diff(np.append(begins, len(docs))))
        starts = np.flatnonzero(within % block_docs == 0)
        block = np.cumsum(within % block_docs == 0) - 1
        at = _places(self.starts[docs], self.sizes[docs])
        terms, place = np.unique(self.terms[at], return_inverse=True)
        largest = np.zeros(len(starts) * len(terms), dtype=np.int32)
        np.maximum.at(largest, np.repeat(block, self.sizes[docs]) * len(terms) + place, self.values[at].astype(np.int32))
        return TermBlocks(docs, np.append(starts, len(docs)), terms, largest.reshape(len(starts), len(terms)))

    def scores(self, docs: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Full scores of some documents; ``dense`` has a weight for every term."""
        sizes = self.sizes[docs]
        at = _places(self.starts[docs], sizes)
        return np.add.reduceat(dense[self.terms[at]] * self.values[at], np.cumsum(sizes) - sizes)

    def best(self, terms: np.ndarray, weights: np.ndarray, dense: np.ndarray, k: int, tally: Counter | None = None):
        """The k best documents as (score, doc_id place), every block left out being bounded below the k-th."""
        found = [(self.lists[t], t) for t in terms.tolist() if t in self.lists]
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        bounds = [blocks.bounds(terms, weights) for blocks, _ in found]
        which = np.repeat(np.arange(len(found)), [len(b) for b in bounds])
        block = np.concatenate([np.arange(len(b)) for b in bounds])
        bound = np.concatenate(bounds)
        order = np.argsort(-bound, kind="stable")
        seen = np.zeros(len(self.sizes), dtype=bool)
        docs, scores = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        least, at, step = 1, 0, 4
        while at < len(order) and bound[order[at]] >= least:
            taken = order[at : at + step]
            taken = taken[bound[taken] >= least]
            fresh = np.unique(np.concatenate([found[which[i]][0].docs[slice(*found[which[i]][0].starts[block[i] : block[i] + 2])] for i in taken]))
            fresh = fresh[~seen[fresh]]
            if len(fresh):
                seen[fresh] = True
                docs, scores = np.concatenate([docs, fresh]), np.concatenate([scores, self.scores(fresh, dense)])
                if len(scores) >= k:
                    least = max(1, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                    kept = scores >= least
                    docs, scores = docs[kept], scores[kept]
            at += len(taken)
            step *= 2
        if tally is not None:
            tally.update(visited=at, skipped=len(order) - at)
        kept = scores > 0
        docs, scores = docs[kept], scores[kept]
        order = np.lexsort((self.doc_ids[docs], -scores))[:k]
        return docs[order], scores[order]


_NULL = np.iinfo(np.int64).min
_HITS = "item_no bigint, doc_id bigint, score bigint"


def _searched(asked, documents: int, total: int, k: int, postings: int, block_docs: int):
    """The k best documents of each shard for each item; ``asked`` has weights by term and the items' terms and factors."""

    def answers(ids, lengths, sizes, terms, times):
        weights, items = asked.value
        values = impacts(times, np.repeat(lengths, sizes), documents, total)
        shard = Shard(ids, sizes, terms, values, weights, block_docs)
        rows: list[tuple] = []
        for item_no, item_terms, factors in items:
            dense = np.zeros(len(weights), dtype=np.int64)
            own = weights[item_terms] * factors
            dense[item_terms] = own
            docs, scores = shard.best(item_terms, own, dense, k)
            rows += [(item_no, None if ids[d] == _NULL else int(ids[d]), int(s)) for d, s in zip(docs, scores)]
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_no", "doc_id", "score"])

    def run(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            return answers(*[np.concatenate(parts) for parts in zip(*held)])

        for batch in batches:
            ids, lengths = batch.column(0).fill_null(_NULL).to_numpy(), batch.column(1).to_numpy()
            sizes = batch.column(2).value_lengths().to_numpy().astype(np.int64)
            terms, times = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            ends, low = np.cumsum(sizes), 0
            while low < len(sizes):
                before = int(ends[low] - sizes[low])
                high = max(low + 1, int(np.searchsorted(ends, before + postings - size, side="right")))
                part = slice(before, int(ends[high - 1]))
                held.append((ids[low:high], lengths[low:high], sizes[low:high], terms[part], times[part]))
                size += part.stop - part.start
                if high < len(sizes) or size >= postings:
                    yield flush()
                    held, size = [], 0
                low = high
        if held:
            yield flush()

    return run


def _block_hits(documents: DataFrame, items: list, k: int, postings: int, block_docs: int) -> DataFrame | None:
    """item_no, doc_id, score: the best of all shards for one block of items."""
    context = documents.sparkSession.sparkContext
    wanted = [(row["item_no"], Counter(term for piece in term_pieces(row["text"]) for term in piece)) for row in items]
    vocabulary = sorted({term for _, found in wanted for term in found})
    vectors = stored(
        documents.select("doc_id", "text").mapInArrow(
            _vectors(context.broadcast(vocabulary)), "doc_id bigint, n bigint, terms array<int>, times array<int>"
        )
    )
    sums = vectors.select("n", "terms").mapInArrow(_frequencies(len(vocabulary)), "term bigint, n bigint")
    counts = {row["term"]: row["n"] for row in sums.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, total = counts.get(-1, 0), counts.get(-2, 0)
    if not total or not vocabulary:
        return None
    weights = np.array([term_weight(n, counts.get(number, 0)) for number in range(len(vocabulary))], dtype=np.int64)
    numbers = {term: number for number, term in enumerate(vocabulary)}
    asked = []
    for item_no, found in wanted:
        pairs = sorted((numbers[term], times) for term, times in found.items() if weights[numbers[term]] > 0)
        if pairs:
            asked.append((item_no, *[np.array(column, dtype=np.int64) for column in zip(*pairs)]))
    # documents without any of the terms are in no posting list
    rows = vectors.where(F.size("terms") > 0)
    return rows.mapInArrow(_searched(context.broadcast((weights, asked)), n, total, k, postings, block_docs), _HITS)


def search(
    documents: DataFrame, items: DataFrame, k: int = 10, item_block: int = ITEM_BLOCK, postings: int = SHARD_POSTINGS,
    block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, equal scores by rising id."""
    spark = documents.sparkSession
    asked = numbered(items.select("item_id", F.coalesce("text", F.lit("")).alias("text")), "item_id", "text").withColumnRenamed("row_no", "item_no")
    asked = stored(asked)
    hits = []
    for first in range(0, asked.count(), item_block):
        rows = asked.where(F.col("item_no").between(first, first + item_block - 1)).collect()
        found = _block_hits(documents, rows, k, postings, block_docs)
        if found is not None:
            hits.append(found)
    hits = reduce(DataFrame.unionByName, hits) if hits else spark.createDataFrame([], _HITS)
    best = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc("doc_id"))
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(asked.select("item_no", "item_id"), "item_no").select("item_id", "rank", "doc_id", "score")
