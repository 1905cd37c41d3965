"""Bin completion against an exact packer, on instances of known optimum, and the tokenizer's joined words."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from fwlens.llm import packing
from fwlens.llm.queries import tokenizer_path


def bins_of(found):
    return sum(times for _, times in found.bins)


def checked(found, counts, capacity):
    used = Counter()
    for content, times in found.bins:
        assert times > 0 and sum(length * n for length, n in content.items()) <= capacity
        used.update({length: n * times for length, n in content.items()})
    assert used == Counter(counts)
    return bins_of(found)


def exact(items, capacity):
    """Fewest bins by dynamic programming over subsets: (bins, filling of the last one)."""
    best = [(0, 0)] + [(len(items) + 1, 0)] * (2 ** len(items) - 1)
    for mask in range(2 ** len(items)):
        bins, used = best[mask]
        for i, length in enumerate(items):
            if not mask >> i & 1:
                fits = bins and used + length <= capacity
                best[mask | 1 << i] = min(best[mask | 1 << i], (bins, used + length) if fits else (bins + 1, length))
    return best[-1][0]


@pytest.mark.parametrize("seed", range(40))
def test_small_instances_equal_an_exact_packer(seed):
    rng = random.Random(seed)
    items = [rng.randint(1 if seed % 2 else 15, 60) for _ in range(rng.randint(1, 12))]
    found = packing.complete_bins(Counter(items), 60, nodes=100_000)
    assert checked(found, Counter(items), 60) == exact(items, 60)


def cut_from_full_bins(rng):
    bins, items = rng.randint(10, 40), []
    for _ in range(bins):
        left = 2048
        while left >= 300 and rng.random() < 0.8:
            items.append(rng.randint(150, left - 150))
            left -= items[-1]
        items.append(left)
    return bins, Counter(items)


def test_instances_without_slack():
    """Best fit misses them; the search finds the best packing or says by how much it may miss it."""
    rng, missed, fitted = random.Random(1), 0, 0
    for _ in range(60):
        bins, counts = cut_from_full_bins(rng)
        found = packing.complete_bins(counts, 2048)
        assert found.bound == bins and checked(found, counts, 2048) == bins + found.gap
        missed += found.gap > 0
        fitted += sum(times for _, times in packing.best_fit_decreasing(counts, 2048)) == bins
    assert missed <= 2 and fitted <= 5


def plain_fillings(items, room):
    """Undominated fillings by comparing all sets of items."""
    sets = {tuple(sorted(c)) for k in range(len(items) + 1) for c in combinations(items, k) if sum(c) <= room}

    def replaced(one):
        rest = Counter(items) - Counter(one)
        for size in range(1, len(one) + 1):
            for part in set(combinations(one, size)):
                for other in rest:
                    if sum(part) <= other and sum(one) - sum(part) + other <= room and part != (other,):
                        return True
        return False

    return {s for s in sets if s and not replaced(s)}


@pytest.mark.parametrize("seed", range(12))
def test_fillings_are_the_undominated_ones(seed):
    rng = random.Random(seed)
    items, room = [rng.randint(2, 14) for _ in range(7)], 20
    stock = [items.count(length) for length in range(room + 1)]
    found = [(lost, tuple(sorted(Counter(content).elements()))) for lost, content in packing.fillings(stock, room, room, packing.Work(10**6))]
    # a set to which another item could be added is no filling
    wanted = {s for s in plain_fillings(items, room) if not any(sum(s) + x <= room for x in (Counter(items) - Counter(s)))}
    assert [lost for lost, _ in found] == sorted(lost for lost, _ in found)
    assert {content for _, content in found} == wanted and len(found) == len(wanted)


def test_rooms_just_made_are_filled_by_the_same_length():
    assert sum(times for _, times in packing.best_fit_decreasing({6: 1, 2: 4}, 10)) == 2


def test_many_lengths_and_open_nodes(monkeypatch):
    """Nodes far up give their options back and make them again."""
    rng = random.Random(6)
    cases = [cut_from_full_bins(rng)[1] for _ in range(6)]
    whole = [bins_of(packing.complete_bins(c, 2048, 3000)) for c in cases]
    monkeypatch.setattr(packing, "OPEN_NODES", 2)
    assert [bins_of(packing.complete_bins(c, 2048, 3000)) for c in cases] == whole
    counts = {length: rng.randint(1, 10**6) for length in range(1, 2049)}
    found = packing.complete_bins(counts, 2048, steps=300_000)
    checked(found, counts, 2048)


def test_joined_words_have_the_ids_of_single_ones():
    path = tokenizer_path("word_bpe_49k.json")
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
    words = {"".join(rng.choices(letters, k=rng.randint(1, 25))) for _ in range(3000)} | {"don't", "a1", "x×y", "÷", "É", "it's", "ﬁ", "İ", "日本", "a.b", "..."}
    memo = packing.WordIds(path)
    words |= {w + m for w, m in zip(sorted(words), ["...", "!!", "&&&", "'s", "\"", "42", "é,", "-x-", ")", "¿"] * 60)}
    list(memo.ids_of(sorted(words)))
    for word in words:
        assert memo.ids(word) == np.asarray(memo.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes(), word


def test_parts_have_the_ids_of_whole_texts(monkeypatch):
    """Special tokens, capitals before combining marks and odd characters, in texts cut into small slices."""
    path = tokenizer_path("word_bpe_49k.json")
    memo, rng = packing.WordIds(path), random.Random(4)
    signs = ["a", "H", "T", "é", "É", "ß", "×", "Ä", "̱", "̈", "'", " ", "\n", "\xa0", "\x1c", "<|", "<|endoftext|>", "<|ENDOFTEXT|>", "|>"]
    signs += ["<", "1", "…", "日", "İ", "K", "'S", "\x00", "ﬁ", ".", "!", "\U0001f600", "Σ", "½", "the"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(14))) for _ in range(3000)] + [None, "", " ", "H̱ <|endoftext|>x"]
    wanted = [np.asarray(memo.tokenizer.encode(t or "", add_special_tokens=False).ids + [7], dtype="<u4") for t in texts]
    assert [bytes(ids) for ids in memo.ids_of(texts)] == [ids[:-1].tobytes() for ids in wanted]
    monkeypatch.setattr(packing, "SLICE_BYTES", 50)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    found = pa.Table.from_batches(packing._piece_rows(path, 2048, 7, True)([batch])).to_pydict()
    assert found["doc_id"] == batch.column("doc_id").to_pylist() and found["ids"] == [ids.tolist() for ids in wanted]


def test_chunks_are_remembered_by_their_parts():
    """What words and marks are joined to adds nothing to look up."""
    memo = packing.WordIds(tokenizer_path("word_bpe_49k.json"))
    memo.ids("Ab ab. ab, (ab) ab7, ab-ab 7ab")
    assert set(memo) == {b"ab", b".", b",", b"(", b")", b"7", b"-"}
