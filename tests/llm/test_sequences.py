"""Context trees over whole texts against recursion over plain lists."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from fwlens.llm import context_trees, queries, words
from tests.llm.test_pairs import table


def brute(train, score):
    """log10 probability of one text by recursion, each text being a list of tokens."""
    depth = context_trees.DEPTH

    def events(tokens):
        data = b"\n" * (depth - 1) + b" " + b"".join(t + b" " for t in tokens) + b"\n"
        return [(data[i - depth : i], data[i]) for i in range(depth, len(data))]

    seen = Counter(e for tokens in train for e in events(tokens))

    def counts(suffix, level, prefix):
        tally = [0, 0]
        for (context, byte), n in seen.items():
            if context.endswith(suffix) and byte >> (8 - level) == prefix:
                tally[byte >> (7 - level) & 1] += n
        return tally

    def estimate(zeros, ones):
        return math.lgamma(ones + 0.5) + math.lgamma(zeros + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)

    def log_weight(suffix, level, prefix):
        own = estimate(*counts(suffix, level, prefix))
        if len(suffix) == depth:
            return own
        longer = {c[depth - len(suffix) - 1 :] for c, _ in seen if c.endswith(suffix)}
        return math.log(0.5) + np.logaddexp(own, sum(log_weight(x, level, prefix) for x in longer))

    def chance(context, length, level, byte):
        suffix, prefix = context[depth - length :], byte >> (8 - level)
        tally = counts(suffix, level, prefix)
        own = (tally[byte >> (7 - level) & 1] + 0.5) / (sum(tally) + 1)
        if length == depth:
            return own
        weight = math.exp(math.log(0.5) + estimate(*tally) - log_weight(suffix, level, prefix))
        return weight * own + (1 - weight) * chance(context, length + 1, level, byte)

    return sum(math.log10(chance(c, 0, level, byte)) for c, byte in events(score) for level in range(8))


@pytest.mark.parametrize("piece", [7, 4_000_000])
def test_contexts_run_across_words(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(context_trees, "PIECE_BYTES", piece)
    monkeypatch.setattr(context_trees, "LOCAL_PAIRS", piece)
    texts = list(enumerate(["the hen", "then the", "", None, "off the hen é", "hen the", "the  Hen", "hen the"]))
    table(spark, texts, ", chunk string, n string, word string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op7_context_trees(spark, str(tmp_path)).collect()}
    tokens = {i: words.encoded(t, lower=True).split() for i, t in texts}
    held = {i for i in tokens if zlib.crc32(str(i).encode()) % 7 == 2}
    assert held and set(got) == set(tokens)
    train = [t for i, t in tokens.items() if i not in held]
    n = Counter(w for t in train for w in [*t, b"\n"])
    for i, own in tokens.items():
        row = got[i]
        assert (row["held_out"], row["n_tokens"], row["train_tokens"]) == (i in held, len(own) + 1, n.total())
        assert row["n_known"] == sum(n[t] > 0 for t in [*own, b"\n"])
        assert math.isclose(row["base_score"], sum(math.log10((n[t] + 1) / (n.total() + len(n) + 1)) for t in [*own, b"\n"]))
        assert math.isclose(row["score"], brute(train, own), rel_tol=1e-9), own
    # the same words in another order are another text
    assert abs(got[0]["score"] - got[5]["score"]) > 1e-6 and got[0]["score"] == got[6]["score"]
    empty = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    assert context_trees.score_sequences(empty).count() == 0
