"""Embedding, MinHash and substring operators against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from fwlens.llm import components, embeddings, minhash, substrings

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use inside, as extra columns.
CLASHING = ", prefix string, doc string, spans string, class_id string, component string, vector string, dim string, kept string"


def table(spark, texts, extra=""):
    rows = [(i, t, "en", "s", None) + (("x",) * extra.count("string")) for i, t in texts]
    return spark.createDataFrame(rows, DOCUMENT + extra)


def groups(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(300, 300), (None, 5)]
    found = components.connected_components(spark.createDataFrame(links, "a bigint, b bigint"))
    got = {r["node"]: r["component"] for r in found.collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 24))
    rows = [v for v in base] + [base[i % 20] + rng.normal(size=24) * rng.choice([0.05, 0.3, 0.45]) for i in range(200)]
    rows += [base[0]] * 12 + [base[1] * 3.5] * 4
    data = [(i, [float(x) for x in v], 1) for i, v in enumerate(rows)]
    odd = [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 24, 1), (1003, [float("nan")] + [1.0] * 23, 1),
           (1004, [None] + [1.0] * 23, 1), (1005, [float("inf")] + [1.0] * 23, 1), (1006, [1.0, 0.0], 1), (1007, [2.0, 0.0], 1)]
    frame = spark.createDataFrame(data + odd, "vec_id bigint, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embeddings.near_vectors(frame, tile_rows=16).collect()}
    m = np.array(rows)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    linked = m @ m.T >= 0.9
    np.fill_diagonal(linked, False)
    want = groups(range(len(rows)), [(int(i), int(j)) for i, j in zip(*np.nonzero(linked))])
    assert linked.sum() > 300
    for i in range(len(rows)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (linked[i].sum(), want[i], want[i] == i)
    for i in range(1000, 1006):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert (got[1007]["n_links"], got[1007]["component_id"]) == (1, 1006)
    assert embeddings.near_vectors(frame.limit(0)).count() == 0


def test_survivors_lose_no_pair():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(300, 40)) * np.geomspace(1, 0.05, 40)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    i, j = embeddings.survivors(a, a, 0.9)
    assert {(x, y) for x, y in zip(*np.nonzero(a @ a.T >= 0.9))} <= set(zip(i, j))


def varied(count, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(count):
        if texts and rng.random() < 0.5:
            words = texts[rng.randrange(len(texts))].split()
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 5, 30, 90, 200]))]
        texts.append(" ".join(w.upper() if rng.random() < 0.02 else w for w in words))
    return texts


@pytest.mark.parametrize("length", [4, 5])
def test_near_duplicates_against_all_pairs(spark, length):
    texts = list(enumerate(varied(150, 3))) + [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "ONE")]
    got = {r["doc_id"]: r for r in minhash.near_duplicates(table(spark, texts, CLASHING), length).collect()}
    sets = {i: minhash.shingle_set(t, length) for i, t in texts}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    want = groups(sets, links)
    assert len(links) > 30
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), want[i], want[i] == i)


def test_links_that_only_a_chain_shows(spark):
    """Neighbours of a chain are alike and its ends are not; the chain is one group."""
    words = [f"c{i}" for i in range(100)]
    chain = []
    for step in range(12):
        words = [*words[2:], f"n{step}a", f"n{step}b"]
        chain.append((step, " ".join(words)))
    got = minhash.near_duplicates(table(spark, chain)).collect()
    assert {r["component_id"] for r in got} == {0}


def test_estimate_follows_similarity(spark):
    rng = random.Random(1)
    words = [str(i) for i in range(4000)]
    from pyspark.sql import functions as F

    for share in (0.5, 0.8, 0.95):
        one = words[:2000]
        two = one[: int(2000 * 2 * share / (1 + share))] + words[2000 : 2000 + 2000 - int(2000 * 2 * share / (1 + share))]
        rng.shuffle(words)
        prints = minhash._signature(minhash._words.word_hashes(" ".join(one).encode()), 1)[1], minhash._signature(minhash._words.word_hashes(" ".join(two).encode()), 1)[1]
        frame = spark.createDataFrame([([int(x) for x in prints[0]], [int(x) for x in prints[1]])], "l array<bigint>, r array<bigint>")
        got = frame.select(minhash.estimated_similarity(F.col("l"), F.col("r"))).first()[0]
        assert abs(got - share) < 0.15


def test_repeated_rows_keep_one(spark):
    frame = table(spark, [(5, "a b c d e f g"), (5, "a b c d e f g"), (7, "a b c d e f g"), (8, None), (None, "x y z")], CLASHING)
    kept = minhash.deduplicated(frame)
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 5, 8] and kept.columns == frame.columns
    assert minhash.deduplicated(frame.limit(0)).count() == 0


def covered_words(texts, window):
    seen, result = set(), {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        words = (t or "").encode().split()
        cover = [False] * len(words)
        for k in range(len(words) - window + 1):
            gram = tuple(words[k : k + window])
            if gram in seen:
                cover[k : k + window] = [True] * window
            seen.add(gram)
        result[i] = (words, cover)
    return result


def test_repeats_against_all_windows(spark, monkeypatch):
    monkeypatch.setattr(substrings, "LOCAL_SUFFIXES", 50)
    rng = random.Random(4)
    passages = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([15, 25, 60]))) for _ in range(6)]
    texts = [
        (i, " ".join(rng.choice(passages + [f"u{rng.random()}" for _ in range(6)]) for _ in range(rng.randrange(8))))
        for i in range(80)
    ]
    texts += [(200, None), (201, ""), (202, "z " * 300), (203, "z\n" * 25), (204, "é Z z " * 30)]
    for window in (20, 50):
        got = {r["doc_id"]: r for r in substrings.repeat_digests(table(spark, texts, CLASHING), window).collect()}
        for i, (words, cover) in covered_words(texts, window).items():
            left = [w for w, c in zip(words, cover) if not c]
            assert (got[i]["n_words"], got[i]["n_removed"]) == (len(words), sum(cover)), i
            assert got[i]["kept_sha256"] == hashlib.sha256(b" ".join(left)).hexdigest()


def test_cut_texts_keep_their_white_space(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    frame = table(spark, [(1, f"one\n{passage}\ttwo"), (2, f"  three\n\nfour {passage}\nfive  six"), (3, passage), (4, None)], CLASHING)
    cut = substrings.without_repeats(frame)
    assert cut.columns == frame.columns
    got = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert got == {1: f"one\n{passage}\ttwo", 2: "three\n\nfour five  six", 4: None}
    assert substrings.without_repeats(frame.limit(0)).count() == 0
