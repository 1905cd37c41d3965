"""Near-duplicate documents by b-bit MinHash.

Texts of equal word sequences are one class. Each class has 128 minima over its shingles; 32 bands of four whole minima
give candidates, and the low four bits of each minimum, packed into eight longs, estimate similarity by bit counts,
corrected for the one in sixteen chance that low bits agree. A bitmap of parities (each shingle flips one of 1024 bits)
adds a proof: two bitmaps differ in no more bits than the sets have unshared shingles, so a pair whose bitmaps differ in
too many cannot be linked. Pairs that pass both are confirmed on their full shingle sets.

A band bucket is first linked to its smallest class only, so a bucket of any size costs as many pairs as it has rows.
After components of the confirmed links are known, a second round takes the pairs of a bucket whose components still
differ; pairs inside a component cannot change the result. A pair of similarity 0.8 misses all bands with
probability (1 - 0.8^4)^32 = 5e-8. The estimate drops a pair only below 0.55, over six standard errors from 0.8.

Cases: a null or blank text has the empty set, 0 shingles, and is linked with nothing; repeated rows and texts are one
class; different texts of one id, and texts without an id, are documents of their own; an empty table gives an empty
result; other columns are not read by :func:`near_duplicates` and pass through :func:`deduplicated`.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from fwlens.llm import words as _words
from fwlens.llm.components import connected_components
from fwlens.llm.row_keys import row_keyed
from fwlens.session import checkpointed

cloudpickle.register_pickle_by_value(_words)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BANDS, ROWS, BITS = 32, 4, 4
MINIMA = BANDS * ROWS
LEAST_ESTIMATE = 0.55
PARITY_BITS = 1024
_PACKED = MINIMA * BITS // 64
_random = np.random.default_rng(90210)
_FACTOR = _random.integers(1, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _random.integers(0, 2**63, MINIMA, dtype=np.uint64)


def shingle_set(text: str | None, length: int) -> set:
    """Distinct shingles of a text in lower case; a shorter text is one shingle, an empty one has none."""
    words = _words.encoded(text, lower=True).split()
    if len(words) <= length:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(length)]))


def _signature(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band keys over whole minima, the packed low bits, and the parity bitmap."""
    grams = _words.gram_hashes(hashes, length) if len(hashes) >= length else _words.gram_hashes(hashes, len(hashes), 1)
    grams = np.unique(grams)
    least = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for first in range(0, len(grams), 2048):
            part = grams[first : first + 2048, None] * _FACTOR + _SHIFT
            np.minimum(least, part.min(axis=0), out=least)
        scrambled = _words.mixed(least)
        groups = scrambled.reshape(BANDS, ROWS)
        keys = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
        for column in range(ROWS):
            keys = _words.mixed(keys * np.uint64(0x9E3779B97F4A7C15) + groups[:, column])
    low = (scrambled & np.uint64((1 << BITS) - 1)).reshape(_PACKED, 64 // BITS)
    packed = np.bitwise_or.reduce(low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=1)
    parity = np.bincount((grams >> np.uint64(20)) % np.uint64(PARITY_BITS), minlength=PARITY_BITS) % 2
    return keys.view(np.int64), packed.view(np.int64), np.packbits(parity.astype(np.uint8)).view(np.int64)


def _fingerprints(length: int):
    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                data = _words.encoded(text, lower=True)
                hashes = _words.word_hashes(data)
                if not len(hashes):
                    rows.append((doc_id, 0, None, None, None, None))
                    continue
                signature = _signature(hashes, length)
                rows.append((doc_id, len(shingle_set(text, length)), _sequence_hash(hashes).to_bytes(16, "big"), *signature))
            frame = pd.DataFrame(rows, columns=["doc_id", "n_shingles", "class_key", "keys", "packed", "parity"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return run


def _sequence_hash(hashes: np.ndarray) -> int:
    """128 bits of a whole word sequence."""
    with np.errstate(over="ignore"):
        place = np.arange(len(hashes), dtype=np.uint64)
        sums = [np.add.reduce(_words.mixed(hashes + place * np.uint64(factor))) for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
    return int(sums[0]) << 64 | int(sums[1])


def estimated_similarity(left: Column, right: Column) -> Column:
    """Similarity from equal low bits, corrected for chance agreement."""
    # after folding the bits of each minimum onto its lowest one, set bits count the minima that differ
    def differing(a, b):
        x = a.bitwiseXOR(b)
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(0x1111111111111111))

    differ = sum((differing(left[i], right[i]) for i in range(1, _PACKED)), differing(left[0], right[0]))
    equal = 1.0 - differ / F.lit(float(MINIMA))
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def may_link(left: Column, right: Column, percent: int) -> Column:
    """Whether two classes, as structs of packed, parity and n_shingles, can be similar enough."""
    words = range(PARITY_BITS // 64)
    unshared = sum((F.bit_count(left["parity"][i].bitwiseXOR(right["parity"][i])) for i in words), F.lit(0))
    # similarity p/100 means that unshared * (100 + p) = (sum of sizes) * (100 - p)
    possible = unshared * (100 + percent) <= (left["n_shingles"] + right["n_shingles"]) * (100 - percent)
    return possible & (estimated_similarity(left["packed"], right["packed"]) >= LEAST_ESTIMATE)


def _confirmed(percent: int, length: int):
    def run(batches):
        for batch in batches:
            good = []
            last_text, last_set = None, set()
            for one, two in zip(batch["text_a"], batch["text_b"]):
                if one is not last_text:
                    last_text, last_set = one, shingle_set(one, length)
                other = shingle_set(two, length)
                shared = len(last_set & other)
                good.append(100 * shared >= percent * (len(last_set) + len(other) - shared))
            yield batch.loc[good, ["a", "b"]]

    return run


def _links(pairs: DataFrame, texts: DataFrame, percent: int, length: int) -> DataFrame:
    """Pairs whose full shingle sets are similar enough."""
    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    return checkpointed(joined.mapInPandas(_confirmed(percent, length), "a bigint, b bigint"))


def near_duplicates(documents: DataFrame, length: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id (smallest id of the same word sequence).

    Different texts of one id, and texts without an id, are compared as documents of their own. A group's id is the smallest
    of its ids; where none has one, the group has none, and its first row is kept.
    """
    keyed, key = row_keyed(documents.select("doc_id", "text"), ["text"])
    found = _compared_rows(keyed.select(F.col(key).alias("doc_id"), "text"), length, percent).withColumnRenamed("doc_id", key)
    rows = found.join(keyed.select(key, "doc_id").distinct(), key)
    ids = [
        rows.groupBy(of).agg(F.min("doc_id").alias(name)) for of, name in (("component_id", "first_id"), ("class_id", "first_of_class"))
    ]
    named = rows.join(ids[0], "component_id").join(ids[1], "class_id")
    kept = F.when(F.col("first_id").isNull(), F.col("kept")).otherwise(F.coalesce(F.col("doc_id") == F.col("first_id"), F.lit(False)))
    return named.select(
        "doc_id", "n_shingles", F.col("first_id").alias("component_id"), kept.alias("kept"), F.col("first_of_class").alias("class_id")
    )


def _compared_rows(documents: DataFrame, length: int, percent: int) -> DataFrame:
    """The same columns for a table whose ids are keys of its distinct rows."""
    rows = documents.select("doc_id", "text")
    schema = "doc_id bigint, n_shingles bigint, class_key binary, keys array<bigint>, packed array<bigint>, parity array<bigint>"
    prints = checkpointed(rows.mapInPandas(_fingerprints(length), schema))
    filled = prints.where(F.col("class_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = filled.groupBy("class_key").agg(F.min("doc_id").alias("class_id"))
    members = checkpointed(filled.join(classes, "class_key").select("doc_id", "class_id"))
    heads = members.where("doc_id = class_id").select("doc_id").distinct()
    print_ = F.struct("packed", "parity", "n_shingles").alias("print")
    signatures = filled.select("doc_id", "keys", print_).join(heads, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    exploded = signatures.select("doc_id", F.explode("keys").alias("bucket"))
    sizes = exploded.groupBy("bucket").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    buckets = checkpointed(exploded.join(sizes.select("bucket", "least"), "bucket"))

    bits = signatures.select("doc_id", "print").join(buckets.select("doc_id").distinct(), "doc_id", "left_semi")
    bits = checkpointed(bits)
    texts = rows.join(bits.select("doc_id"), "doc_id", "left_semi")

    def likely(pairs: DataFrame) -> DataFrame:
        joined = pairs.join(bits.select(F.col("doc_id").alias("a"), F.col("print").alias("print_a")), "a")
        joined = joined.join(bits.select(F.col("doc_id").alias("b"), F.col("print").alias("print_b")), "b")
        return joined.where(may_link(F.col("print_a"), F.col("print_b"), percent)).select("a", "b")

    star = buckets.where("doc_id > least").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct()
    first = _links(likely(star), texts, percent, length)
    found = connected_components(first)

    # what is left: pairs of one bucket whose components differ
    labelled = buckets.select("bucket", "doc_id").join(
        found.withColumnRenamed("node", "doc_id"), "doc_id", "left"
    ).select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    # members outside the largest component of a bucket are compared with all others of the bucket
    per = labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    main = per.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("parts"))
    open_rows = checkpointed(
        labelled.join(main.where("parts > 1").select("bucket", F.col("top.component").alias("top")), "bucket")
        .join(bits, "doc_id")
    )
    side = lambda name: [F.col("doc_id").alias(name), F.col("component").alias(f"component_{name}"), F.col("print").alias(f"print_{name}")]
    outside = open_rows.where("component != top").select("bucket", *side("a"))
    everyone = open_rows.select("bucket", *side("b"), "top")
    near = may_link(F.col("print_a"), F.col("print_b"), percent)
    rest = (
        outside.join(everyone, "bucket")
        .where((F.col("component_a") != F.col("component_b")) & ((F.col("component_b") == F.col("top")) | (F.col("a") < F.col("b"))) & near)
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        .join(star, ["a", "b"], "left_anti")
    )
    second = _links(checkpointed(rest), texts, percent, length)
    groups = connected_components(
        second.unionByName(found.select(F.col("component").alias("a"), F.col("node").alias("b")))
    )
    of_class = groups.select(F.col("node").alias("class_id"), F.col("component").alias("component_id"))
    labels = members.distinct().join(of_class, "class_id", "left").select(
        "doc_id", "class_id", F.coalesce("component_id", "class_id").alias("component_id")
    )
    return prints.select("doc_id", "n_shingles").join(labels, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
    )


def deduplicated(documents: DataFrame, length: int = 5, percent: int = 80) -> DataFrame:
    """The first document of each group, with all its columns. Of equal rows one stays; rows without an id, and different
    rows of one id, are compared as documents of their own."""
    keyed, key = row_keyed(documents, documents.columns)
    compared = _compared_rows(keyed.select(F.col(key).alias("doc_id"), "text"), length, percent)
    kept = compared.where("kept").select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(kept, key).dropDuplicates([key]).drop(key)
