"""The corpus pipeline: quality rules, near duplicates, repeated passages, source mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as parquet and read again by the next.
All stages but the last return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from fwlens.llm import minhash, mixing, packing, quality_rules, substrings
from fwlens.llm.queries import tokenizer_path
from fwlens.llm.storage import stored

#: Words of a passage that counts as repeated.
PASSAGE_WORDS = 50
#: Every document is drawn at most once, as the packed corpus is one epoch.
MIX = replace(mixing.PLAN, epochs=1, budget_percent=80)
#: SQL has no tokenizer, so the rows are compared with a brute-force version in tests/llm.
ORACLE_SQL = None


def _measured(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rejected documents, and failing lines of the others."""
    return _measured(quality_rules.clean(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near copies."""
    return minhash.deduplicated(docs, length=5, percent=80)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that stand earlier in the corpus."""
    return _measured(substrings.without_repeats(docs, window=PASSAGE_WORDS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents towards the target weights."""
    return mixing.drawn_documents(docs, MIX)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the pieces of all documents into sequences."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("repeated passages", passage_stage),
    ("source mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
