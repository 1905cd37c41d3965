"""Missing and repeated ids in near duplicates and passages."""

from __future__ import annotations

import hashlib

from fwlens.llm import minhash, substrings
from tests.llm.test_pairs import CLASHING, table


def sentence(mark, count=30):
    return " ".join(f"{mark}{i}" for i in range(count))


def test_rows_without_an_own_id_are_documents(spark):
    one, two, three = sentence("a"), sentence("b"), sentence("c")
    texts = [(None, one), (None, two), (None, two), (None, None), (3, three), (3, sentence("d")), (4, three + " x"), (5, one)]
    frame = table(spark, texts, CLASHING)
    kept = minhash.deduplicated(frame)
    assert kept.columns == frame.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    # a row without an id comes first in its group
    assert got == sorted([(None, one), (None, two), (None, None), (3, three), (3, sentence("d"))], key=str)


def test_passages_are_cut_from_their_own_row(spark):
    one, two = sentence("a"), sentence("b")
    texts = [(1, one), (None, "x " * 3 + two), (None, "y"), (7, sentence("p", 50) + " " + one), (7, "lone"), (8, two), (9, two), (9, two)]
    frame = table(spark, texts, CLASHING)
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.repeat_digests(frame).collect())
    digest = lambda text: hashlib.sha256(" ".join(text.split()).encode()).hexdigest()
    want = [(1, 30, 0, one), (0, 33, 0, "x " * 3 + two), (0, 1, 0, "y"), (7, 80, 30, sentence("p", 50)), (7, 1, 0, "lone")]
    want += [(8, 30, 30, ""), (9, 30, 30, ""), (9, 30, 30, "")]
    assert got == sorted((i, n, m, digest(t)) for i, n, m, t in want)
    cut = substrings.without_repeats(frame)
    assert cut.columns == frame.columns
    left = sorted(((r["doc_id"] or 0, r["text"]) for r in cut.collect()))
    assert left == sorted([(1, one), (0, "x " * 3 + two), (0, "y"), (7, sentence("p", 50)), (7, "lone")])
