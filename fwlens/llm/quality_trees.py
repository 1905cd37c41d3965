"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts; labels, language, source and id are no inputs. Trees are grown on a bounded sample of
labelled rows (``TreeSettings.train_rows``, the rows with the smallest hash of their id), and flattened into arrays:
scoring walks all documents of a batch down all trees at once.

Cases: a null text counts as an empty one, whose statistics are zeros; labels that are null or other than 0 and 1 are
not learned; of repeated labels of one id the smallest counts; without labelled rows, or with one class only, every score
is the share of label 1 (0.5 without rows); repeated documents get equal scores; other columns are not read.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from fwlens.llm import words as _words

cloudpickle.register_pickle_by_value(_words)
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class TreeSettings:
    """``train_rows`` bounds the labelled rows that the driver fits on; the rest is usual for boosting."""

    train_rows: int = 20_000
    trees: int = 80
    leaves_depth: int = 4
    rate: float = 0.15
    bins: int = 64
    ridge: float = 1.0
    least_rows: int = 20
    seed: int = 7


FEATURES = (
    "words", "bytes", "mean_word", "sd_word", "distinct_share", "top_word_share", "repeat_pair_share", "repeat_window_share",
    "capital_share", "shout_share", "digit_share", "mark_share", "symbol_share", "bang_share", "bar_share", "stop_share",
    "other_share", "space_share", "lines", "dup_line_share", "closed_line_share", "mean_line", "entropy", "top_byte_share",
    "short_word_share", "long_word_share",
)
_SYMBOLS = np.frombuffer(b"#*$%&<>@^_~=+{}[]\\/", dtype=np.uint8)
_MARKS = np.frombuffer(b".,;:!?\"'()-", dtype=np.uint8)


def statistics(text: str | None) -> list[float]:
    """The features of one text, in the order of FEATURES."""
    data = _words.encoded(text)
    hashes = _words.word_hashes(data)
    if not len(hashes):
        return [0.0] * len(FEATURES)
    codes = np.frombuffer(data, dtype=np.uint8)
    counts = np.bincount(codes, minlength=256).astype(float)
    size, n = float(len(codes)), float(len(hashes))
    space = np.isin(codes, (9, 10, 11, 12, 13, 32))
    edges = np.flatnonzero(np.diff((~space).astype(np.int8), prepend=0, append=0))
    lengths = edges[1::2] - edges[::2]
    _, repeats = np.unique(hashes, return_counts=True)
    pairs = _words.gram_hashes(hashes, 2)
    windows = _words.gram_hashes(hashes, 5)
    unlike = lambda grams: 1 - len(np.unique(grams)) / len(grams) if len(grams) else 0.0
    firsts, lasts = codes[edges[::2]], codes[edges[1::2] - 1]
    upper = (codes >= 65) & (codes <= 90)
    capital = (firsts >= 65) & (firsts <= 90)
    uppers = np.add.reduceat(upper.astype(np.int64), edges[::2])
    shout = (uppers >= 2) & (uppers * 2 > lengths)
    lines = [line for line in data.split(b"\n") if line.strip()]
    share = counts[counts > 0] / size
    return [
        n, size, lengths.mean(), lengths.std(), len(repeats) / n, repeats.max() / n, unlike(pairs), unlike(windows),
        capital.mean(), shout.mean(), counts[48:58].sum() / size, counts[_MARKS].sum() / n, counts[_SYMBOLS].sum() / n,
        counts[33] / n, counts[124] / n, np.isin(lasts, (46, 33, 63)).mean(), counts[128:].sum() / size, space.mean(),
        float(len(lines)), 1 - len(set(lines)) / len(lines), sum(line.rstrip()[-1:] in b".!?" for line in lines) / len(lines),
        n / len(lines), float(-(share * np.log2(share)).sum()), share.max(), (lengths <= 2).mean(), (lengths >= 12).mean(),
    ]


class Forest:
    """Boosted trees as arrays: node k of a tree has the children 2k+1 and 2k+2; a leaf repeats itself downward."""

    def __init__(self, base: float, edges: list[np.ndarray], feature: np.ndarray, cut: np.ndarray, value: np.ndarray):
        self.base, self.edges, self.feature, self.cut, self.value = base, edges, feature, cut, value

    def binned(self, table: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(edge, table[:, i], side="left") for i, edge in enumerate(self.edges)], axis=1)

    def scores(self, table: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row of statistics."""
        margin = np.full(len(table), self.base)
        if len(self.feature):
            bins = self.binned(table)
            trees, inner = self.feature.shape
            depth = int(np.log2(inner + 1))
            at = np.zeros((len(table), trees), dtype=np.int64)
            rows, tree = np.arange(len(table))[:, None], np.arange(trees)[None, :]
            for _ in range(depth):
                right = bins[rows, self.feature[tree, at]] > self.cut[tree, at]
                at = 2 * at + 1 + right
            margin = margin + self.value[tree, at - inner].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def grow(table: np.ndarray, labels: np.ndarray, settings: TreeSettings = TreeSettings()) -> Forest:
    """Fits the forest by gradient and curvature sums per bin; each level of a tree is one pass over the histogram."""
    inner = 2**settings.leaves_depth - 1
    none = Forest(0.0, [], np.zeros((0, inner), dtype=int), np.zeros((0, inner), dtype=int), np.zeros((0, inner + 1)))
    if not len(labels):
        return none
    share = min(max(labels.mean(), 1e-6), 1 - 1e-6)
    none.base = float(np.log(share / (1 - share)))
    if labels.min() == labels.max():
        return none
    quantiles = np.linspace(0, 1, settings.bins + 1)[1:-1]
    edges = [np.unique(np.quantile(table[:, i], quantiles)) for i in range(table.shape[1])]
    bins = np.stack([np.searchsorted(edge, table[:, i], side="left") for i, edge in enumerate(edges)], axis=1)
    width, columns = settings.bins, table.shape[1]
    slots = bins + np.arange(columns) * width
    margin = np.full(len(labels), none.base)
    features, cuts, values = [], [], []
    for _ in range(settings.trees):
        chance = 1 / (1 + np.exp(-margin))
        slope, curve = chance - labels, chance * (1 - chance)
        node = np.zeros(len(labels), dtype=np.int64)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, width, dtype=np.int64)
        for depth in range(settings.leaves_depth):
            nodes = 2**depth
            index = (node[:, None] * (columns * width) + slots).ravel()
            sums = [
                np.bincount(index, weights=np.repeat(w, columns), minlength=nodes * columns * width)
                .reshape(nodes, columns, width).cumsum(axis=2)
                for w in (slope, curve, np.ones(len(labels)))
            ]
            totals = [s[:, :, -1:] for s in sums]
            gain = sum(
                g * g / (h + settings.ridge) * sign
                for g, h, sign in ((sums[0], sums[1], 1), (totals[0] - sums[0], totals[1] - sums[1], 1), (totals[0], totals[1], -1))
            )
            small = (sums[2] < settings.least_rows) | (totals[2] - sums[2] < settings.least_rows)
            gain = np.where(small, 0.0, gain).reshape(nodes, -1)
            best = gain.argmax(axis=1)
            split = gain[np.arange(nodes), best] > 1e-9
            place = nodes - 1 + np.arange(nodes)
            feature[place] = np.where(split, best // width, 0)
            cut[place] = np.where(split, best % width, width)
            node = 2 * node + (bins[np.arange(len(node)), feature[nodes - 1 + node]] > cut[nodes - 1 + node])
        leaves = inner + 1
        value = -np.bincount(node, slope, leaves) / (np.bincount(node, curve, leaves) + settings.ridge) * settings.rate
        margin += value[node]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    return Forest(none.base, edges, np.array(features), np.array(cuts), np.array(values))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept from learning: checksum of the id as text leaves remainder 1 by 3 (a null id is held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def _statistics_of(texts) -> np.ndarray:
    return np.array([statistics(text) for text in texts], dtype=float).reshape(-1, len(FEATURES))


def _table_rows(batches):
    for batch in batches:
        table = pd.DataFrame(_statistics_of(batch["text"]), columns=list(FEATURES))
        table.insert(0, "label", batch["label"].to_numpy())
        table.insert(0, "doc_id", batch["doc_id"].to_numpy())
        yield table


def train(documents: DataFrame, labels: DataFrame, settings: TreeSettings = TreeSettings()) -> Forest:
    """A forest from labelled rows outside the held-out fold."""
    usable = labels.where(F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("label"))
    order = [F.xxhash64(F.col("doc_id"), F.lit(settings.seed)), F.col("doc_id")]
    chosen = usable.orderBy(*order).limit(settings.train_rows)
    # of several texts of one id the least serves, wherever the rows lie
    rows = documents.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    fields = ", ".join(f"{name} double" for name in FEATURES)
    table = rows.mapInPandas(_table_rows, f"doc_id bigint, label int, {fields}").toPandas().sort_values("doc_id")
    return grow(table[list(FEATURES)].to_numpy(dtype=float), table["label"].to_numpy(dtype=float), settings)


def _scored(forest: Forest):
    def run(batches):
        for batch in batches:
            for first in range(0, len(batch), 2000):
                part = batch.iloc[first : first + 2000]
                score = forest.scores(_statistics_of(part["text"]))
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].astype("Int64"), "held_out": part["held_out"], "score": score,
                    "predicted": (score >= 0.5).astype(np.int32),
                })

    return run


def score_documents(documents: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = documents.select("doc_id", "text", held_out().alias("held_out"))
    return rows.mapInPandas(_scored(forest), "doc_id bigint, held_out boolean, score double, predicted int")
