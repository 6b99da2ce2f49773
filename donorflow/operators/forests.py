"""Scores of a fitted forest for many rows: all trees at once, by masks of the leaves that a value leaves open."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from donorflow.session import workspace

LEAVES = 64  # of a tree, one bit each
VALUES = 1 << 18  # masks looked up at a time, which stay in a core's cache


def _nodes(model: RandomForestClassificationModel, spark: Any) -> list[dict[int, Any]]:
    """The nodes of each tree by their number, as Spark stores them."""
    folder = workspace(spark, "forest")
    model.write().save(folder)
    trees: list[dict[int, Any]] = [{} for _ in range(model.getNumTrees)]
    for r in spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*").collect():
        trees[r["treeID"]][r["id"]] = r
    return trees


def open_leaves(trees: Sequence[dict[int, Any]], features: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Thresholds of each feature, the masks (values between thresholds, trees) each leaves open, and votes (2, trees, leaves).

    A tree's leaves are numbered from the left. A condition that fails closes the leaves on its
    left; the first leaf that all features leave open is the row's.
    """
    split = [[[] for _ in trees] for _ in range(features)]  # (threshold, leaves on the left)
    votes = []
    for t, nodes in enumerate(trees):
        shares: list[tuple[float, float]] = []

        def walk(at: int) -> None:
            node = nodes[at]
            if node["leftChild"] < 0:
                counts = list(node["impurityStats"])
                total = sum(counts)
                shares.append((counts[0] / total, counts[1] / total) if total else (0.0, 0.0))
                return
            first = len(shares)
            walk(node["leftChild"])
            split[node["split"]["featureIndex"]][t].append((node["split"]["leftCategoriesOrThreshold"][0], ((1 << len(shares)) - (1 << first))))
            walk(node["rightChild"])

        walk(0)
        votes.append(shares)
    leaves = max(map(len, votes))
    kind = np.uint16 if leaves <= 16 else np.uint32 if leaves <= 32 else np.uint64
    full = np.iinfo(kind).max
    cuts, masks = [], []
    for per_tree in split:
        at = sorted({threshold for tree in per_tree for threshold, _ in tree})
        table = np.full((len(at) + 1, len(trees)), full, kind)
        for t, tree in enumerate(per_tree):
            for threshold, left in tree:
                table[at.index(threshold) + 1:, t] &= kind(full ^ left)
        cuts.append(np.array(at))
        masks.append(table)
    padded = np.zeros((2, len(trees), leaves))
    for t, shares in enumerate(votes):
        padded[:, t, :len(shares)] = np.array(shares).T
    return cuts, masks, padded


def scores(x: np.ndarray, cuts: Sequence[np.ndarray], masks: Sequence[np.ndarray], votes: np.ndarray) -> np.ndarray:
    """The share of votes for class 1 of rows x; trees are added in their order, as Spark adds them."""
    out, trees = np.empty(len(x)), votes.shape[1]
    step = max(1, VALUES // trees)
    for low in range(0, len(x), step):
        part = x[low:low + step]
        left = None
        for i, (cut, mask) in enumerate(zip(cuts, masks, strict=True)):
            if len(cut):
                found = mask[np.searchsorted(cut, part[:, i], side="left")]
                left = found if left is None else np.bitwise_and(left, found, out=left)
        if left is None:
            leaf = np.zeros((trees, len(part)), np.uint8)
        else:
            lowest = left & (~left + left.dtype.type(1))
            leaf = np.ascontiguousarray(np.bitwise_count(lowest - left.dtype.type(1)).T)
        zero, one = np.zeros(len(part)), np.zeros(len(part))
        for t in range(trees):
            zero += votes[0, t][leaf[t]]
            one += votes[1, t][leaf[t]]
        out[low:low + step] = one / (zero + one)
    return out


def forest_score(model: RandomForestClassificationModel, features: Sequence[str]) -> Callable[[DataFrame], DataFrame] | None:
    """Adds ``score``, the probability of class 1 that the model gives; None where a tree has too many leaves for a mask."""
    tables: list[Any] = []

    def score(df: DataFrame) -> DataFrame:
        if not tables:
            tables.append(open_leaves(_nodes(model, df.sparkSession), len(features)))
        cuts, masks, votes = tables[0]
        keep = [c for c in df.columns if c != "score"]
        numbers = [f"__f{i}" for i in range(len(features))]
        wide = df.select(*keep, *[F.col(f).cast("double").alias(c) for f, c in zip(features, numbers)])
        schema = StructType([*wide.schema.fields[:len(keep)], StructField("score", DoubleType())])

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [batch.column(len(keep) + i) for i in range(len(numbers))]
                x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns]).astype(float)
                if np.isnan(x).any():
                    raise ValueError("a feature of the forest is NULL or NaN")
                kept = batch.columns[:len(keep)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(scores(x, cuts, masks, votes))], names=schema.names)

        return wide.mapInArrow(scored, schema)

    return score if 1 << model.getMaxDepth() <= LEAVES else None
