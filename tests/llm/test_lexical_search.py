"""Ranked search against a plain scorer over all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from fwlens.llm import lexical_search as op

DOCS, ITEMS = "doc_id bigint, text string, score string", "item_id bigint, text string, rank string"


def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower)


def plain(docs, items, k=10):
    held = [(doc_id, Counter(found), len(found)) for doc_id, text, *_ in docs if (found := terms(text))]
    n, total = len(held), sum(size for _, _, size in held)
    rows = []
    for item_id, text, *_ in items:
        scored = []
        for doc_id, found, size in held:
            m = 25 + (75 * size * n) // total
            score = 0
            for term, times in Counter(terms(text)).items():
                if term in found:
                    df = sum(term in other for _, other, _ in held)
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
                    score += times * w * (10**9 * found[term] // (1000 * found[term] + 8 * m))
            if score:
                scored.append((-score, doc_id is not None, doc_id or 0))
        for rank, (score, known, doc_id) in enumerate(sorted(scored)[:k], 1):
            rows.append((item_id, rank, doc_id if known else None, -score))
    return rows


def tables(seed, docs=150, items=12):
    chance = random.Random(seed)
    words = ["the", "The", "été", "Été", "x1", "a-b", "river", "stone", *[f"w{i}" for i in range(40)]]
    rows = [(i, " ".join(chance.choices(words, weights=[60, 20, 9, 9, 9, 9, 5, 5, *[2] * 40], k=chance.randint(1, 40))), "s") for i in range(docs)]
    rows += [(None, rows[3][1], "s"), (None, None, "s"), (9000, "", "s"), (9001, "!?", "s"), rows[3], rows[3], (9002, rows[5][1], "s")]
    asked = [(i, " ".join(chance.choices(words, k=chance.randint(1, 12))), "r") for i in range(items)]
    return rows, asked + [(None, "river stone", "r"), (50, None, "r"), (51, "nowhere", "r"), asked[0], (52, "the the THE", "r")]


def ordered(rows):
    return sorted(tuple(row) for row in map(lambda r: [(v is not None, v or 0) for v in r], rows))


@pytest.mark.parametrize("options", [{}, {"item_block": 4, "postings": 60, "block_docs": 2}, {"postings": 300, "block_docs": 8, "k": 3}])
def test_search_equals_plain_scores(spark, options):
    docs, items = tables(len(options))
    found = op.search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), **options)
    assert ordered(found.collect()) == ordered(plain(docs, items, options.get("k", 10)))


def test_no_documents_and_no_items(spark):
    docs, items = tables(7)
    empty = spark.createDataFrame([], DOCS)
    assert op.search(empty, spark.createDataFrame(items, ITEMS)).collect() == []
    assert op.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)).collect() == []


def test_pieces_of_a_long_text(monkeypatch):
    monkeypatch.setattr(op, "_PIECE", 7)
    text = "Ab cd-ef été 12 " * 20
    assert [t.decode() for piece in op.term_pieces(text) for t in piece] == terms(text)


def shard(seed, docs=900, words=60, groups=6):
    """Documents of a few subjects, each with words of its own."""
    chance = np.random.default_rng(seed)
    sizes, all_terms = [], []
    for i in range(docs):
        own = chance.choice(words // groups, 6, replace=False) + (i % groups) * (words // groups)
        found = np.unique(np.append(own, [words, words + 1]))
        sizes.append(len(found))
        all_terms.append(found)
    sizes = np.array(sizes)
    values = chance.integers(1, 400_000, sizes.sum())
    weights = np.append(np.full(words, 3000), [5, 5])
    return op.Shard(np.arange(docs), sizes, np.concatenate(all_terms), values, weights, 16), weights


def test_blocks_are_skipped_only_below_the_best():
    index, weights = shard(2)
    tally = Counter()
    for first in range(0, 60, 10):
        asked = np.array([first, first + 1, 60, 61])
        dense = np.zeros(len(weights), dtype=np.int64)
        dense[asked] = weights[asked]
        docs, scores = index.best(asked, weights[asked], dense, 10, tally)
        every = index.scores(np.arange(900), dense)
        order = np.lexsort((np.arange(900), -every))[:10]
        assert docs.tolist() == order.tolist() and scores.tolist() == every[order].tolist()
    assert tally["skipped"] > tally["visited"]


def test_summaries_are_the_largest_impacts():
    index, _ = shard(3)
    for blocks in list(index.lists.values())[:8]:
        for low, high, largest in zip(blocks.starts, blocks.starts[1:], blocks.largest):
            expected = Counter()
            for doc in blocks.docs[low:high]:
                part = slice(index.starts[doc], index.starts[doc] + index.sizes[doc])
                for term, value in zip(index.terms[part].tolist(), index.values[part].tolist()):
                    expected[term] = max(expected[term], value)
            assert {t: v for t, v in zip(blocks.terms.tolist(), largest.tolist()) if v} == dict(expected)
