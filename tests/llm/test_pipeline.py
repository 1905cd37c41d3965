"""Registered queries against their SQL, and the pipeline against the stages' meaning."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as driver
import corpus_pipeline
from fwlens.llm import minhash
from tests.llm.test_pairs import covered_words

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(driver.LLM.ORACLES))
def test_queries_equal_sql(spark, name):
    got = driver.queries()[name](spark, SF).toPandas()
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(driver.oracle_sql()[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    clean = lambda df: sorted(map(tuple, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()), key=str)
    assert clean(got) == clean(want)


def test_all_operators_are_registered():
    names = driver.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns, kept = docs.columns, docs
    results = []
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF).cache()
        results.append({r["doc_id"]: r for r in kept.collect()} if name != "packing" else kept.toPandas())
        assert name == "packing" or kept.columns == columns
    quality, near, passages, mixed, packed = results
    sets = {i: minhash.shingle_set(r["text"], 5) for i, r in quality.items()}
    for i in sets:
        alike = any(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in sets if j < i and sets[i])
        assert (i in near) or alike
    want = covered_words([(i, r["text"]) for i, r in near.items()], corpus_pipeline.PASSAGE_WORDS)
    for i, (words, cover) in want.items():
        left = [w for w, c in zip(words, cover) if not c]
        assert (passages[i]["text"].encode().split() if i in passages else []) == left
        assert i not in passages or passages[i]["n_chars"] == len(passages[i]["text"])
    assert 0 < len(mixed) <= len(passages) and set(mixed) <= set(passages)
    assert set(packed.doc_id) == set(mixed) and packed.groupby("sequence_id").length.sum().max() <= 2048
    whole = corpus_pipeline.run(spark, SF).toPandas()
    keys = ["doc_id", "piece", "ids_crc32"]
    assert sorted(map(tuple, whole[keys].values)) == sorted(map(tuple, packed[keys].values))
