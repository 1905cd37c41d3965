"""Personal data: base spans against the plain patterns, reliabilities on drawn votes, added spans on planted ones."""

import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from fwlens.llm import personal_data as op

SCHEMA = "doc_id bigint, text string, found string"
PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def holds(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == 1:
        return all(int(part) <= 255 for part in found.split("."))
    if kind == 2:
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0
    return kind == 0 or 9 <= len(digits) <= 15


def plain_spans(text):
    return [(kind, *m.span()) for kind, pattern in enumerate(PLAIN) for m in re.finditer(pattern, text) if holds(kind, m[0])]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", "@", ".", "a", "-", "%", "é", " ", "1.2.3.4", "256", "4111111111111111", "41 11", "7", "+1 (", ") 555", "0", "\n", "+49"]), max_size=30))
def test_base_spans_equal_plain_patterns(parts):
    text = "".join(parts)
    assert op.base_spans(text) == plain_spans(text)


def test_base_of_the_given_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {row["doc_id"]: row["text"] or "" for row in table.collect()}
    rows = op.find_spans(table).collect()
    assert len(rows) == len(texts)
    for row in rows:
        base = plain_spans(texts[row["doc_id"]])
        said = ",".join(f"{op.KINDS[k]}:{s}:{e}" for k, s, e in base)
        assert row["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [row[f"n_{kind}"] for kind in op.KINDS] == [sum(b[0] == k for b in base) for k in range(4)]
        assert set(filter(None, said.split(","))) <= set(row["spans"].split(","))


def test_reliabilities_of_drawn_votes():
    chance = np.random.default_rng(1)
    truth = chance.random(4000) < 0.4
    rates = [0.95, 0.9, 0.8, 0.7, 0.65]
    right = chance.random((4000, 5)) < rates
    votes = np.where(right == truth[:, None], 1, 2)
    votes[chance.random(votes.shape) < 0.3] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    _, found, share = op.reliabilities(patterns, counts.astype(float), rounds=200)
    assert np.abs(found - rates).max() < 0.05 and abs(share - 0.4) < 0.05


WORDS = "the of and to in that with for from report meeting paper river stone".split()


def corpus(seed, size=300):
    chance = random.Random(seed)

    def text(*inside):
        words = [chance.choice(WORDS) for _ in range(30)]
        for part in inside:
            words.insert(chance.randint(0, 30), part)
        return " ".join(words)

    def card():
        digits = "4" + "".join(chance.choice("0123456789") for _ in range(14))
        return next(digits + c for c in "0123456789" if op.luhn(digits + c))

    rows = []
    for i in range(size):
        number = f"{chance.randint(200, 999)}) {chance.randint(200, 999)}-{chance.randint(1000, 9999)}"
        rows.append((i, text(f"mail ann.{i}@mail{i}.example.com", f"call +1 ({number}", f"host 10.2.{i % 250}.{17 + i % 9}", f"card {card()}"), "x"))
    hidden = [
        (1000, "please mail john.smith [at] example [dot] com today", "email:12:45"), (1001, "call (743) 555-3824 now", "phone:5:19"),
        (1002, "the card 4111.1111.1111.1111 was used", "card:9:28"),
        (1003, "server 2001:db8:85a3::8a2e:370:7334 is down", "ip:7:35"),
    ]
    clean = [(2000 + i, text("at noon", "12:30:45", "2024-01-05", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "1 234 567 890"), "x") for i in range(60)]
    return rows + hidden + clean, {doc: span for doc, _, span in hidden}


def test_added_spans_and_clean_texts(spark):
    rows, hidden = corpus(4)
    table = spark.createDataFrame(rows, SCHEMA)
    found = {row["doc_id"]: row for row in op.find_spans(table.repartition(5)).collect()}
    for doc, span in hidden.items():
        assert span in found[doc]["spans"].split(","), (doc, found[doc]["spans"])
    assert all(found[doc]["spans"] == "" for doc in found if doc >= 2000)
    assert all(found[doc]["n_email"] == found[doc]["n_phone"] == found[doc]["n_ip"] == found[doc]["n_card"] == 1 for doc in range(300))
    again = {row["doc_id"]: row for row in op.find_spans(table.repartition(2)).collect()}
    assert again == found


def test_nulls_repeats_long_texts_and_no_rows(spark):
    rows = [(None, None, "a"), (1, "", "b"), (1, "", "b"), (2, "a" * 200_000 + "@x.org " + "1" * 200_000 + " " + "1.1" * 50_000, "c")]
    found = op.find_spans(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((row["doc_id"] is None, row["n_email"]) for row in found) == [(False, 0), (False, 0), (False, 1), (True, 0)]
    assert op.find_spans(spark.createDataFrame([], SCHEMA)).collect() == []


def test_overlapping_candidates_leave_the_likelier():
    code = op.code_of("a 4111.1111.1111.1111 b", op.CARD, 2, 21, False)
    model = {op.CARD: (None, np.ones(1 + sum(op.RADIX))), op.PHONE: (None, np.ones(1 + sum(op.RADIX)) / 2)}
    spans = np.array([[op.CARD, 2, 21, code], [op.PHONE, 2, 16, code], [op.PHONE, 30, 40, code]])
    assert op._accepted(spans, model, {}, 0.5) == [(op.CARD, 2, 21), (op.PHONE, 30, 40)]
