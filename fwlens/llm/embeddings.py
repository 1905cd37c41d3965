"""Near-duplicate vectors by PCA-ordered tiled comparison.

Unit vectors are rotated into the basis of their second-moment matrix, so that leading coordinates hold most of a dot
product. Rows are cut into tiles of bounded size that lie close together; pairs of tiles whose bounding boxes cannot
hold a link are never formed. Inside a pair of tiles the leading coordinates are multiplied first; the rest of a product
is bounded by the suffix norms (Cauchy-Schwarz), and pairs that cannot reach the threshold stop there. The survivors'
cosine is computed from the vectors as given, in double precision.

Equal vectors are one class with a weight. A pair of tiles returns, per linked class, the number of vectors it links
with and one link to the smallest class of its local component, so output stays in proportion to the tiles.

Cases: null, empty, zero and non-finite vectors (or null components) link with nothing; vectors link only with vectors
of their own length; repeated ids with equal vectors count as separate vectors of one id; an empty table gives an empty
result; other columns, labels too, are not read.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from fwlens.llm.components import connected_components
from fwlens.llm.sharding import numbered
from fwlens.session import checkpointed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

THRESHOLD = 0.9
TILE_ROWS = 2048
#: Rounding allowance of bounds; the decision itself uses the plain cosine.
SLACK = 1e-9


def _unit(matrix: np.ndarray) -> np.ndarray:
    scale = np.abs(matrix).max(axis=1, keepdims=True)
    scaled = matrix / scale
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _moments(batches):
    """Upper sums of products of unit vectors, one flat row per vector length and batch."""
    for batch in batches:
        for dim, part in batch.groupby("dim"):
            unit = _unit(np.stack(part["vector"].to_numpy()))
            product = unit.T @ unit
            yield pd.DataFrame({"dim": dim, "place": np.arange(product.size), "value": product.ravel()})


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length its rotation, leading axis first; the driver holds dim x dim numbers each."""
    sums = vectors.select("dim", "vector").mapInPandas(_moments, "dim int, place int, value double")
    table = sums.groupBy("dim", "place").agg(F.sum("value").alias("value")).toPandas()
    axes = {}
    for dim, part in table.groupby("dim"):
        values = part.sort_values("place")["value"].to_numpy().reshape(dim, dim)
        _, basis = np.linalg.eigh((values + values.T) / 2)
        axes[int(dim)] = np.ascontiguousarray(basis[:, ::-1])
    return axes


def _reach(threshold: float) -> float:
    """Largest distance of two linked unit vectors."""
    return math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6


def _celled(axes: dict[int, np.ndarray], width: float):
    """Cell of each vector on the first two axes: neighbours of a cell hold all vectors within reach."""

    def run(batches):
        for batch in batches:
            frames = []
            for dim, part in batch.groupby("dim"):
                unit = _unit(np.stack(part["vector"].to_numpy()))
                lead = unit @ axes[dim][:, : min(3, dim)]
                lead = np.pad(lead, ((0, 0), (0, 3 - lead.shape[1])))
                cells = np.floor(lead / width).astype(np.int64)
                frames.append(part.assign(cx=cells[:, 0], cy=cells[:, 1], cz=cells[:, 2], lead=lead[:, 0]))
            if frames:
                yield pd.concat(frames)[["dim", "vec_id", "weight", "vector", "cx", "cy", "cz", "lead"]]

    return run


def _tiled(axes: dict[int, np.ndarray], tile_rows: int):
    """Packs the sorted rows of a partition into tiles: ids, weights, vectors and the box they fill."""

    def run(batches):
        held: list[pd.DataFrame] = []

        def tiles(frame):
            for _, part in frame.groupby(["dim", "cx", "cy", "cz"], sort=False):
                for first in range(0, len(part), tile_rows):
                    yield part.iloc[first : first + tile_rows]

        def row(part):
            dim = int(part["dim"].iloc[0])
            matrix = np.stack(part["vector"].to_numpy())
            turned = _unit(matrix) @ axes[dim]
            return {
                "dim": dim, "cx": part["cx"].iloc[0], "cy": part["cy"].iloc[0], "cz": part["cz"].iloc[0],
                "tile": int(part["vec_id"].min()), "ids": part["vec_id"].to_numpy(), "weights": part["weight"].to_numpy(),
                "low": turned.min(axis=0) - SLACK, "high": turned.max(axis=0) + SLACK, "flat": matrix.ravel(),
            }

        for batch in batches:
            held.append(batch)
            frame = pd.concat(held)
            done = list(tiles(frame))
            # the last tile may go on in the next batch
            held = [done.pop()] if done else []
            if done:
                yield pd.DataFrame([row(part) for part in done])
        if held and len(held[0]):
            yield pd.DataFrame([row(part) for part in held])

    return run


def survivors(left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rotated unit vectors whose product may reach the threshold, leading coordinates first."""
    dim = left.shape[1]
    suffix = [np.sqrt((m * m)[:, ::-1].cumsum(axis=1)[:, ::-1]) for m in (left, right)]
    rest = lambda side, stop: suffix[side][:, stop] if stop < dim else np.zeros(len(suffix[side]))
    # the first product reaches so far that what is left can hold half of a unit length's square
    energy = (left * left).mean(axis=0).cumsum()
    first = min(dim, int(np.searchsorted(energy, 0.5)) + 1)
    stops = sorted({first, min(dim, first + (dim - first) // 2), dim})
    # with the suffix norms as one more coordinate, one matrix product gives the bounds
    a = np.column_stack([left[:, :first], rest(0, first)])
    b = np.column_stack([right[:, :first], rest(1, first)]).T
    found_i, found_j, found_sum = [], [], []
    for start in range(0, len(left), 256):
        bound = a[start : start + 256] @ b
        i, j = np.nonzero(bound >= threshold - SLACK)
        found_i.append(i + start)
        found_j.append(j)
        found_sum.append(bound[i, j] - a[i + start, first] * b[first, j])
    i, j, total = np.concatenate(found_i), np.concatenate(found_j), np.concatenate(found_sum)
    for begin, stop in zip(stops, stops[1:]):
        keep = []
        for start in range(0, len(i), 100_000):
            a, b = i[start : start + 100_000], j[start : start + 100_000]
            total[start : start + 100_000] += (left[a, begin:stop] * right[b, begin:stop]).sum(axis=1)
            keep.append(total[start : start + 100_000] + rest(0, stop)[a] * rest(1, stop)[b] >= threshold - SLACK)
        if keep:
            mask = np.concatenate(keep)
            i, j, total = i[mask], j[mask], total[mask]
    return i, j


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Plain cosine of rows, in double precision."""
    scale_a, scale_b = np.abs(a).max(axis=1, keepdims=True), np.abs(b).max(axis=1, keepdims=True)
    a, b = a / scale_a, b / scale_b
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable inside one pair of tiles."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compared(axes: dict[int, np.ndarray], threshold: float):
    def run(batches):
        for batch in batches:
            for row in batch.itertuples():
                dim = row.dim
                ids_a, ids_b = np.asarray(row.ids_a), np.asarray(row.ids_b)
                a, b = np.asarray(row.flat_a).reshape(-1, dim), np.asarray(row.flat_b).reshape(-1, dim)
                same = row.tile_a == row.tile_b
                i, j = survivors(_unit(a) @ axes[dim], _unit(b) @ axes[dim], threshold)
                if same:
                    i, j = i[i < j], j[i < j]
                good = [
                    _cosines(a[i[s : s + 100_000]], b[j[s : s + 100_000]]) >= threshold for s in range(0, len(i), 100_000)
                ]
                if not good:
                    continue
                mask = np.concatenate(good)
                i, j = i[mask], j[mask]
                if not len(i):
                    continue
                ids = np.concatenate([ids_a, ids_b])
                order = np.argsort(ids, kind="stable")
                place = np.empty_like(order)
                place[order] = np.arange(len(order))
                if same:
                    place[len(ids_a) :] = place[: len(ids_a)]
                shift = len(ids_a)
                counts = np.zeros(len(ids), dtype=np.int64)
                np.add.at(counts, i, np.asarray(row.weights_b)[j])
                np.add.at(counts, (j if same else j + shift), np.asarray(row.weights_a)[i])
                roots = _local_roots(len(ids), place[i], place[j + shift])
                touched = np.flatnonzero(counts)
                yield pd.DataFrame({
                    "vec_id": ids[touched], "links": counts[touched], "root": ids[order[roots[place[touched]]]],
                })

    return run


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, tile_rows: int = TILE_ROWS, column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    vector = F.col(column).cast("array<double>")
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    nonzero = F.exists(vector, lambda x: x != 0)
    usable = F.col("vec_id").isNotNull() & (F.size(vector) > 0) & finite & nonzero
    # adding zero turns negative zeros into zeros, so that equal vectors are one class
    rows = embeddings.select("vec_id", F.when(usable, F.transform(vector, lambda x: x + F.lit(0.0))).alias("vector"))
    # numbered in the order of their ids, as an id may name several vectors; a group's first class has its smallest id
    classes = checkpointed(
        numbered(
            rows.where(F.col("vector").isNotNull()).groupBy("vector")
            .agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("weight"))
            .withColumn("dim", F.size("vector")),
            "class_id", "vector",
        ).withColumnRenamed("row_no", "class_no")
    )
    axes = principal_axes(classes)
    width = _reach(threshold)
    celled = classes.select("dim", F.col("class_no").alias("vec_id"), "weight", "vector").mapInPandas(
        _celled(axes, width), "dim int, vec_id bigint, weight bigint, vector array<double>, cx bigint, cy bigint, cz bigint, lead double"
    )
    sort_key = ["dim", "cx", "cy", "cz", "lead", "vec_id"]
    # many tiles fill a partition, so only the cells at its edges give small tiles
    tiles = checkpointed(
        checkpointed(celled).repartitionByRange(*sort_key).sortWithinPartitions(*sort_key).mapInPandas(
            _tiled(axes, tile_rows),
            "dim int, cx bigint, cy bigint, cz bigint, tile bigint, ids array<bigint>, weights array<bigint>, low array<double>,"
            " high array<double>, flat array<double>",
        )
    )
    side = lambda name: [F.col(c).alias(f"{c}_{name}") for c in ("tile", "low", "high")]
    steps = F.array(*[F.lit(s).cast("bigint") for s in (-1, 0, 1)])
    near = tiles.select("dim", "cx", "cy", "cz", *side("a"))
    for axis in ("cx", "cy", "cz"):
        near = near.withColumn("step", F.explode(steps)).withColumn(axis, F.col(axis) + F.col("step")).drop("step")
    gaps = F.zip_with(
        F.zip_with("low_a", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high_a", lambda x, y: x - y),
        lambda x, y: F.greatest(x, y, F.lit(0.0)),
    )
    distance = F.aggregate(gaps, F.lit(0.0), lambda total, x: total + x * x)
    pairs = (
        near.join(tiles.select("dim", "cx", "cy", "cz", *side("b")), ["dim", "cx", "cy", "cz"])
        .where((F.col("tile_a") <= F.col("tile_b")) & (distance <= width * width))
        .select("dim", "tile_a", "tile_b")
    )
    load = lambda name: tiles.select("dim", *[F.col(c).alias(f"{c}_{name}") for c in ("tile", "ids", "weights", "flat")])
    joined = pairs.join(load("a"), ["dim", "tile_a"]).join(load("b"), ["dim", "tile_b"])
    one_by_one = joined.select("dim", "tile_a", "tile_b", "ids_a", "ids_b", "weights_a", "weights_b", "flat_a", "flat_b")
    found = checkpointed(one_by_one.mapInPandas(_compared(axes, threshold), "vec_id bigint, links bigint, root bigint"))
    groups = connected_components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy(F.col("vec_id").alias("class_no")).agg(F.sum("links").alias("links"))
    heads = classes.select(F.col("class_no").alias("component"), F.col("class_id").alias("first_id"))
    of_class = groups.join(heads, "component").select(F.col("node").alias("class_no"), "first_id")
    per_class = classes.select("vector", "class_no", "class_id", "weight").join(counts, "class_no", "left").join(of_class, "class_no", "left")
    labels = rows.join(per_class, "vector", "left")
    component = F.coalesce("first_id", "class_id", "vec_id")
    return labels.select(
        "vec_id", F.coalesce(F.col("weight") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).alias("n_links"),
        component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
