"""One id with several texts or vectors, null ids, weights of nothing, and columns named like an operator's own."""

from __future__ import annotations

import pytest

import corpus_pipeline
from fwlens.llm import embeddings, minhash, mixing, quality_rules
from fwlens.llm.row_keys import free_name

HELPERS = (
    "row row_key row_mark_a row_mark_b parts counts verdict change cut_text was_cut drawn_id leaf place epoch range_no key doc pos n spans"
    " class_id component_id kept prefix whole rest ranges n_tokens domain"
).split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{h} string" for h in HELPERS)


def frame(spark, rows):
    return spark.createDataFrame([(i, text, "en", source, None, *["x"] * len(HELPERS)) for i, text, source in rows], SCHEMA)


def prose(mark, words=60):
    return " ".join(f"{mark}{i}" + ("." if i % 10 == 9 else "") for i in range(words))


def test_free_names():
    assert free_name(["Key", "key_"], "key") == "key__" and free_name([], "key") == "key"


def test_one_id_with_two_vectors(spark):
    near = lambda *v: [float(x) for x in v]
    rows = [(5, near(1, 0, 0)), (5, near(0, 1, 0)), (6, near(1, 0.1, 0)), (7, near(0, 1, 0.1)), (None, near(0, 0, 1)), (8, near(0, 0, 1))]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in embeddings.near_vectors(table).collect())
    # a vector without an id links with nothing
    assert got == [(0, 0, None), (5, 1, 5), (5, 1, 5), (6, 1, 5), (7, 1, 5), (8, 0, 8)]


def test_one_id_with_two_texts(spark):
    one, two = prose("a"), prose("b")
    rows = [(1, two, "s"), (5, one, "s"), (5, two, "s"), (6, one, "s"), (None, two, "s"), (None, prose("c"), "s"), (None, None, "s"), (9, two, "s"), (9, two, "s")]
    got = [(r["doc_id"], r["n_shingles"] > 0, r["component_id"], r["kept"]) for r in minhash.near_duplicates(frame(spark, rows)).collect()]
    want = [(1, True, 1, True), (5, True, 5, True), (5, True, 1, False), (6, True, 5, False), (None, True, 1, False), (None, True, None, True),
            (None, False, None, True), (9, True, 1, False), (9, True, 1, False)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_branch_without_weight_leaves_its_share_to_its_siblings():
    tokens = {("a", "en", "x"): 1000, ("a", "en", "y"): 1000, ("b", "en", "x"): 1000}
    plan = mixing.MixPlan(weights={("a", "en", "y"): 0.0}, epochs=1)
    assert mixing.budgets(tokens, plan, 2000) == {("a", "en", "x"): 1000, ("a", "en", "y"): 0, ("b", "en", "x"): 1000}
    nothing = mixing.MixPlan(weights={("a", "en"): 0.0}, epochs=1)
    assert mixing.budgets(tokens, nothing, 1000) == {("a", "en", "x"): 0, ("a", "en", "y"): 0, ("b", "en", "x"): 1000}


def test_null_ids_are_drawn_row_by_row(spark):
    rows = [(None, prose(f"w{i}x", 10), "s") for i in range(100)] + [(3, prose("p", 10), "s"), (3, prose("q", 10), "s")]
    table = frame(spark, rows)
    drawn = mixing.drawn_documents(table, mixing.MixPlan(epochs=1, budget_percent=10))
    assert drawn.columns == table.columns and 10 <= drawn.count() <= 12


@pytest.mark.parametrize("closers", ["", '"', ")" * 8, "”’)]" * 9])
def test_a_line_closes_before_any_number_of_quotes(spark, closers):
    table = frame(spark, [(1, prose("a", 40) + closers, "s"), (2, prose("a", 39) + closers, "s")])
    assert [r["kept"] for r in quality_rules.quality_table(table).orderBy("doc_id").collect()] == [True, False]


def test_stages_pass_columns_of_any_name_and_null_ids(spark):
    rows = [(None, prose(f"n{i}x"), "src1") for i in range(8)] + [(i, prose(f"d{i}x", 80), "src9") for i in range(8)]
    rows += [(20, prose("d1x", 80), "src9"), (21, prose("z", 90) + "\n" + prose("d2x", 80), None), (None, None, "s"), (4, prose("e", 70), "src9")]
    kept = frame(spark, rows)
    columns = kept.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "").cache()
        assert kept.columns == columns, name
        values = [r.asDict() for r in kept.collect()]
        assert values and all(v[h] == "x" for v in values for h in HELPERS), name
        if name == "near duplicates":
            ids = [v["doc_id"] for v in values]
            assert ids.count(None) == 8 and ids.count(4) == 2 and 20 not in ids
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, "").collect()
    assert len(packed) == kept.count()


def test_stages_over_an_empty_table(spark):
    kept = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, "")
        assert kept.collect() == []
