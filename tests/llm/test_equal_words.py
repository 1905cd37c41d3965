"""Texts whose one shingle is the whole text."""

from __future__ import annotations

import pytest

from fwlens.llm import minhash
from tests.llm.test_pairs import table


@pytest.mark.parametrize("length", [4, 5])
def test_texts_of_equal_words_are_linked(spark, length):
    texts = [(i, "w " * n) for i, n in enumerate([4, 5, 6, 40, 3000])] + [(10, "v v v v v"), (11, "V v v v v v"), (12, "w w w")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(table(spark, texts), length).collect()}
    sets = {i: minhash.shingle_set(t, length) for i, t in texts}
    assert got == {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
