"""Isolation forest (Liu, Ting, Zhou: Isolation Forest, ICDM 2008) over feature windows.

Spark draws the training sample, grows one tree per task row, and scores in Arrow batches. What passes the
driver is bounded by the parameters: 256 sampled rows and at most 511 nodes per tree.
"""

from __future__ import annotations

import hashlib
import math
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from fwlens.config import AnomalyModel
from fwlens.operators.explain import LABELS, explanation
from fwlens.operators.features import MODEL_FEATURES
from fwlens.operators.quantiles import column_quantiles, histogram, quantiles
from fwlens.session import checkpointed, concurrently

# Python workers get this module's functions by value, so that executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MINIMUM_WINDOWS = 5
TOO_FEW = "At least five complete behavioral windows are needed for AI detection."
DISABLED_SCHEMA = (
    "src_ip string, window_start timestamp_ntz, ai_anomaly_score double, is_ai_anomaly boolean, ai_explanation string"
)
RESULT_TYPES = {
    "ai_anomaly_score": "double",
    "raw_anomaly_score": "double",
    "isolation_forest_prediction": "int",
    "is_ai_anomaly": "boolean",
    "ai_explanation": "string",
}
NODE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, length double"


@dataclass(frozen=True)
class AnomalyResult:
    scores: DataFrame
    warning: str
    training_strategy: str | None = None


def average_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def numeric_features() -> list[Column]:
    return [F.coalesce(F.col(name).try_cast("double"), F.lit(0.0)).alias(name) for name in MODEL_FEATURES]


def feature_levels(features: DataFrame) -> dict[tuple[str, float], float]:
    """(column, p) -> exact quantile of every model feature, and of every explained feature as "raw_" column."""
    raw = {f"raw_{name}": F.col(name) for name in LABELS}
    frame = features.select(*numeric_features(), *[c.alias(name) for name, c in raw.items()])
    rows = column_quantiles(frame, [*MODEL_FEATURES, *raw], [0.25, 0.5, 0.75]).collect()  # 3 rows per column
    return {(row["name"], row["p"]): row["quantile"] for row in rows}


def scaling(levels: dict[tuple[str, float], float]) -> dict[str, Column]:
    """Per model feature: centred on its median and divided by its interquartile range (1 when that is 0)."""
    return {
        name: (c - levels[name, 0.5]) / ((levels[name, 0.75] - levels[name, 0.25]) or 1.0)
        for name, c in zip(MODEL_FEATURES, numeric_features())
    }


def robust_scale(features: DataFrame) -> DataFrame:
    return features.withColumns(scaling(feature_levels(features)))


# Draws are whole numbers below this prime, from sums of products that stay within 64 bits.
PRIME = 2**31 - 1


def _words(text: str) -> list[int]:
    """The first three 32-bit words of a text's MD5."""
    digest = hashlib.md5(text.encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16)]


def tree_factors(seed: int, trees: int) -> list[tuple[int, int, int]]:
    """Per tree the factors of both words of a row's ticket, and the summand, of its draw."""
    keys = [_words(f"{seed}:{tree}") for tree in range(trees)]
    return [(a % (PRIME - 1) + 1, b % (PRIME - 1) + 1, c % PRIME) for a, b, c in keys]


def ticket(seed: int) -> list[Column]:
    """Two 31-bit words of a row's own, from its source and time."""
    text = F.concat_ws("|", F.lit(str(seed)), "src_ip", F.unix_micros(F.col("window_start").cast("timestamp")).cast("string"))
    return [F.conv(F.substring(F.md5(text.cast("binary")), first, 8), 16, 10).cast("bigint") % PRIME for first in (1, 9)]


def _grow(sample: np.ndarray, seed: int, tree: int) -> list[tuple]:
    """Nodes of one tree, parents before children; leaves carry their expected path length.

    Nodes are named as in a heap, and a node's feature and cut are drawn by a hash of seed, tree and that name, so a tree
    depends on its sample alone.
    """
    limit = math.ceil(math.log2(max(len(sample), 2)))
    nodes, pending = [], [(sample, 0, -1, False, 1)]
    while pending:
        rows, depth, parent, is_right, name = pending.pop()
        index = len(nodes)
        if parent >= 0:
            nodes[parent][4 if is_right else 3] = index
        low, high = rows.min(axis=0), rows.max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(varying):
            nodes.append([index, -1, 0.0, -1, -1, depth + average_path(len(rows))])
            continue
        which, where, _ = _words(f"{seed}:{tree}:{name}")
        feature = int(varying[which * len(varying) >> 32])
        cut = float(low[feature] + where / 2**32 * (high[feature] - low[feature]))
        nodes.append([index, feature, cut, -1, -1, 0.0])
        goes_left = rows[:, feature] <= cut
        pending.append((rows[~goes_left], depth + 1, index, True, 2 * name + 1))
        pending.append((rows[goes_left], depth + 1, index, False, 2 * name))
    return nodes


@dataclass(frozen=True)
class Forest:
    """Per tree the arrays feature, cut, left, right and length over its nodes."""

    trees: list[tuple[np.ndarray, ...]]
    sample_size: int


def raw_scores(trees: list[tuple[np.ndarray, ...]], sample_size: int, matrix: np.ndarray) -> np.ndarray:
    """Score of each row: 2 to the minus mean path length over its expectation."""
    total = np.zeros(len(matrix))
    rows = np.arange(len(matrix))
    for feature, cut, left, right, length in trees:
        at = np.zeros(len(matrix), dtype=np.int64)
        while True:
            split = feature[at]
            inner = split >= 0
            if not inner.any():
                break
            goes_left = matrix[rows, np.maximum(split, 0)] <= cut[at]
            at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
        total += length[at]
    # rounded, so that scores that differ by the order of a sum only are equal
    return np.round(np.exp2(-(total / len(trees)) / max(average_path(sample_size), 1e-12)), 12)


def fit_forest(training: DataFrame, model: AnomalyModel, rows: int) -> Forest:
    """Each tree draws its own ``sample_size`` of all ``rows`` training rows and grows on an executor.

    A row has a ticket, a hash of seed, source and time; a tree's draw of the row is a sum of products of ticket and tree.
    A row stands for a tree if that falls under a bound that lets a few more rows than needed pass; the smallest draws are
    taken. Samples depend on rows and seed only, whatever the partitioning. Only the nodes come to the driver.
    """
    size, seed = min(model.sample_size, rows), model.random_state
    share = (size + 6 * size**0.5 + 6) / rows
    bound = math.ceil(share * PRIME) if share < 1 else PRIME
    factors = F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in zip("abc", key)]) for key in tree_factors(seed, model.n_estimators)])
    one, two = ticket(seed)
    trees = F.transform(factors, lambda f, i: F.struct(i.alias("tree"), ((F.col("one") * f["a"] % PRIME + F.col("two") * f["b"] % PRIME + f["c"]) % PRIME).alias("draw")))
    drawn = (
        training.withColumns({"one": one, "two": two}).withColumn("chosen", F.filter(trees, lambda t: t["draw"] <= bound))
        .select("src_ip", "window_start", *MODEL_FEATURES, F.inline("chosen"))
    )

    def grow(sample: pd.DataFrame) -> pd.DataFrame:
        chosen = sample.sort_values(["draw", "src_ip", "window_start"]).head(size)
        tree = int(chosen["tree"].iloc[0])
        matrix = chosen[list(MODEL_FEATURES)].to_numpy(dtype="float64")
        nodes = pd.DataFrame(_grow(matrix, seed, tree), columns=["node", "feature", "cut", "left", "right", "length"])
        nodes.insert(0, "tree", tree)
        return nodes

    nodes = drawn.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()
    trees = []
    for _, tree in nodes.sort_values(["tree", "node"]).groupby("tree"):
        trees.append(tuple(tree[name].to_numpy() for name in ("feature", "cut", "left", "right", "length")))
    return Forest(trees, size)


def score_windows(features: DataFrame, forest: Forest, scaled: dict[str, Column]) -> DataFrame:
    """Adds raw_anomaly_score in Arrow batches."""
    shared = features.sparkSession.sparkContext.broadcast((forest.trees, forest.sample_size))

    @F.pandas_udf("double")
    def raw_score(*columns: pd.Series) -> pd.Series:
        matrix = np.column_stack([column.to_numpy(dtype="float64") for column in columns])
        return pd.Series(raw_scores(*shared.value, matrix))

    return features.withColumn("raw_anomaly_score", raw_score(*[scaled[name] for name in MODEL_FEATURES]))


def unscored(features: DataFrame) -> DataFrame:
    return features.withColumns({name: F.lit(None).cast(kind) for name, kind in RESULT_TYPES.items()})


def disabled_anomalies(spark) -> DataFrame:
    return spark.createDataFrame([], DISABLED_SCHEMA)


def detect_anomalies(features: DataFrame, model: AnomalyModel) -> AnomalyResult:
    """Scores every window 0..100 and flags the ones the model isolates most easily.

    Fitting is a sequence of jobs over one materialised feature table.
    """
    if not set(MODEL_FEATURES) <= set(features.columns):
        return AnomalyResult(unscored(features), TOO_FEW)
    if "has_reliable_normal_label" not in features.columns:
        features = features.withColumn("has_reliable_normal_label", F.lit(False))
    features = checkpointed(features)
    reliable = F.coalesce(F.col("has_reliable_normal_label"), F.lit(False))
    counts = features.agg(F.count(F.lit(1)).alias("n"), F.count_if(reliable).alias("normal")).first()
    if counts["n"] < MINIMUM_WINDOWS:
        return AnomalyResult(unscored(features), TOO_FEW)
    labelled = counts["normal"] >= MINIMUM_WINDOWS

    levels = feature_levels(features)
    scaled = scaling(levels)
    training = features.filter(reliable) if labelled else features
    forest = fit_forest(training.withColumns(scaled), model, counts["normal"] if labelled else counts["n"])
    scored = checkpointed(score_windows(features, forest, scaled))

    trained = scored.filter(reliable) if labelled else scored
    negated = histogram(trained.select(F.lit("all").alias("scope"), (-F.col("raw_anomaly_score")).alias("v")), ["scope"], "v")
    cut, (low, high) = concurrently(
        features.sparkSession,
        [
            lambda: quantiles(negated, ["scope"], [model.contamination]).first()["quantile"],
            lambda: scored.agg(F.min("raw_anomaly_score"), F.max("raw_anomaly_score")).first(),
        ],
    )
    share = (F.col("raw_anomaly_score") - low) / (high - low) * 100 if high > low else F.lit(0.0)
    medians = F.struct(*[F.lit(levels.get((f"raw_{name}", 0.5), 0.0)).alias(name) for name in LABELS])
    explained = scored.withColumn("ai_explanation", explanation(medians))
    result = explained.withColumns(
        {
            "ai_anomaly_score": F.least(F.greatest(F.bround(share, 2), F.lit(0.0)), F.lit(100.0)),
            "isolation_forest_prediction": F.when(-F.col("raw_anomaly_score") < cut, -1).otherwise(1),
        }
    )
    result = flag_anomalies(result, model.anomaly_threshold).select(*features.columns, *RESULT_TYPES)
    if labelled:
        warning = (
            f"The model baseline used {counts['normal']} windows labelled as normal; human validation is still required."
        )
        return AnomalyResult(result, warning, "labelled_normal_windows")
    warning = (
        "No sufficiently large reliable normal-labelled baseline was available. The model learned from the currently "
        "loaded dataset; human validation is required."
    )
    return AnomalyResult(result, warning, "all_loaded_windows")


def flag_anomalies(scores: DataFrame, threshold: float) -> DataFrame:
    """Re-applies the score threshold to stored scores without fitting again."""
    isolated = (F.col("isolation_forest_prediction") == -1) & (F.col("ai_anomaly_score") >= threshold)
    return scores.withColumn("is_ai_anomaly", F.coalesce(isolated, F.lit(False)))


def anomalies_only(scores: DataFrame) -> DataFrame:
    return scores.filter(F.coalesce(F.col("is_ai_anomaly"), F.lit(False)))


def ranked(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.desc("ai_anomaly_score"), "src_ip", "window_start")


VIEW_COLUMNS = (
    "src_ip", "window_start", "connection_count", "unique_dst_ips", "unique_dst_ports", "blocked_ratio",
    "bytes_sent_total", "ai_anomaly_score", "is_ai_anomaly", "ai_explanation",
)


def anomaly_chart(scores: DataFrame, k: int = 30) -> DataFrame:
    """Highest scores with a printable window label."""
    label = F.concat_ws(" | ", "src_ip", F.col("window_start").cast("string"))
    return ranked(scores).limit(k).select(label.alias("window_label"), "ai_anomaly_score")


def anomaly_view(scores: DataFrame, k: int = 20) -> DataFrame:
    """The anomalies, or the highest scores when there are none."""
    any_found = scores.agg(F.coalesce(F.max("is_ai_anomaly"), F.lit(False)).alias("any_found"))
    leading = ranked(scores.filter(~F.coalesce(F.col("is_ai_anomaly"), F.lit(False)))).limit(k)
    # a subquery decides which of both is shown, without a job while the plan is built
    shown = leading.filter(~any_found.scalar())
    return ranked(anomalies_only(scores).unionByName(shown)).select(*VIEW_COLUMNS)
