"""Registered queries of the dealt operators: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from fwlens.llm import context_trees, conversations, embeddings, lexical_search, minhash, mixing, packing, personal_data, quality_rules, quality_trees, sharding, substrings, token_counts
from fwlens.llm.sql import ORACLES  # noqa: F401


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pca_tiles(spark, sf_dir):
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op2_quality_rules(spark, sf_dir):
    return quality_rules.quality_table(_table(spark, sf_dir, "documents"))


def op10_feistel_shards(spark, sf_dir):
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=8)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file, which is the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_viterbi_counts(spark, sf_dir):
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_bin_completion(spark, sf_dir):
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op3_quality_trees(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents")
    return quality_trees.score_documents(documents, quality_trees.train(documents, _table(spark, sf_dir, "labels")))


def op6_prefix_trees(spark, sf_dir):
    return substrings.repeat_digests(_table(spark, sf_dir, "documents"), window=20)


def op7_context_trees(spark, sf_dir):
    return context_trees.score_sequences(_table(spark, sf_dir, "documents"))


def op8_budget_tree(spark, sf_dir):
    return mixing.draw(_table(spark, sf_dir, "documents"), mixing.PLAN)


def op9_minhash(spark, sf_dir):
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), length=4, percent=80)


def op11_geometric_blocks(spark, sf_dir):
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def op12_weak_supervision(spark, sf_dir):
    return personal_data.find_spans(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark, sf_dir):
    return conversations.repair_digests(_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_pca_tiles": op1_pca_tiles,
    "op2_quality_rules": op2_quality_rules,
    "op3_quality_trees": op3_quality_trees,
    "op4_viterbi_counts": op4_viterbi_counts,
    "op5_bin_completion": op5_bin_completion,
    "op6_prefix_trees": op6_prefix_trees,
    "op7_context_trees": op7_context_trees,
    "op8_budget_tree": op8_budget_tree,
    "op9_minhash": op9_minhash,
    "op10_feistel_shards": op10_feistel_shards,
    "op11_geometric_blocks": op11_geometric_blocks,
    "op12_weak_supervision": op12_weak_supervision,
    "op13_conversation_repair": op13_conversation_repair,
}
