"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorflow.llm.common import checkpointed


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges within one task as stars: (least node, other node) of each of their components."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        for x in (a, b, before[a], before[b]):
            np.minimum.at(label, x, least)
        label = label[label]
        if (label == before).all():
            far = label != np.arange(len(nodes))
            return nodes[label[far]], nodes[far]


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b): label is the smallest node that links lead to.

    Each round every node moves to its least neighbour, and once more to where that one moves; edges follow their ends, and
    those that have become loops or equal ones go. So what is left shrinks from round to round, and the smallest node of a
    component, which never moves, is the last. Minima are taken before each shuffle, so a node with most links is no hot
    spot; every round is written to the checkpoint folder, and only the number of edges reaches the driver.
    """
    left = checkpointed(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a != b").distinct())
    labels = left.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    while left.count():
        first = checkpointed(left.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")))
        moves = checkpointed(first.join(first.select(F.col("a").alias("by"), F.col("to").alias("least")), F.col("to") == F.col("by")).select(F.col("a").alias("was"), "least"))
        labels = checkpointed(labels.join(moves, labels["label"] == moves["was"], "left").select("node", F.coalesce("least", "label").alias("label")))
        ends = left.join(moves, left["a"] == moves["was"]).select(F.col("least").alias("a"), "b").filter("a != b").distinct()
        left = checkpointed(ends.join(moves, ends["b"] == moves["was"]).select("a", F.col("least").alias("b")).filter("a != b").distinct())
    return labels
