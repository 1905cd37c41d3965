"""Passage groups around one hot phrase."""

from __future__ import annotations

import hashlib
import random

import numpy as np

from fwlens.llm import substrings, words
from tests.llm.test_pairs import covered_words, table


def hot_texts(count):
    """One phrase with the smallest hash of all, in differing surroundings; each tenth text stands twice."""
    rng = random.Random(9)
    grams = {" ".join(f"{c}{k}" for k in range(5)): 0 for c in "abcdefghijklmnopqrstuvwxyz"}
    phrase = min(grams, key=lambda g: int(words.gram_hashes(words.word_hashes(g.encode()), 5)[0]))
    texts = [" ".join([*(str(rng.random()) for _ in range(15)), phrase, *(str(rng.random()) for _ in range(15))]) for _ in range(count)]
    return list(enumerate(texts + texts[::10]))


def test_windows_around_a_hot_phrase_are_many_groups(spark, monkeypatch):
    texts = hot_texts(60)
    whole = table(spark, texts)
    monkeypatch.setattr(substrings, "GROUP_SUFFIXES", 50)
    bits = substrings.further_bits(whole, 20, 5)
    assert bits.any()
    sizes = {}
    for _, text in texts:
        anchor, _, node = substrings.anchored(words.word_hashes(text.encode()), 20, 5)
        for key in substrings.prefixes(anchor, node, bits).tolist():
            sizes[key] = sizes.get(key, 0) + 1
    assert max(sizes.values()) <= 50
    got = {r["doc_id"]: r for r in substrings.repeat_digests(whole).collect()}
    for i, (own, cover) in covered_words(texts, 20).items():
        left = [w for w, c in zip(own, cover) if not c]
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(own), sum(cover))
        assert got[i]["kept_sha256"] == hashlib.sha256(b" ".join(left)).hexdigest()


def test_equal_windows_stay_in_one_group():
    anchor = np.array([5, 5, 5, 7], dtype=np.uint64)
    node = np.array([1 << 63, 1 << 63, 1, 1], dtype=np.uint64)
    key = substrings.prefixes(anchor, node, np.full(1 << substrings.BUCKET_BITS, 3, dtype=np.uint8))
    assert key[0] == key[1] and len(set(key.tolist())) == 3
