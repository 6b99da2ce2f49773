"""Cost-complexity pruning of Spark's decision trees, from counts per leaf.

Spark grows a tree; one aggregate counts the classes in each of its leaves. Everything else,
the order in which branches are worth least and the score of each leaf under every
complexity, follows from these few counts, so one fit and one aggregate serve a whole grid.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Branch:
    """A node of a tree; leaves are numbered from the left as Spark's leafCol does."""

    leaf: int | None = None
    children: list[Branch] = field(default_factory=list)
    counts: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def leaves(self) -> list[Branch]:
        return [self] if not self.children else [x for c in self.children for x in c.leaves()]

    def risk(self) -> float:
        """Rows of the smaller class: what a leaf here would get wrong."""
        return float(self.counts.min())


def branches(model: Any) -> Branch:
    """The shape of a fitted tree, from its description: conditions and predictions by their indentation."""
    root, path, number = Branch(), [], 0
    path.append((-1, root))
    for line in model.toDebugString.splitlines()[1:]:
        depth, text = len(line) - len(line.lstrip()), line.strip()
        while path[-1][0] >= depth:
            path.pop()
        parent = path[-1][1]
        if re.match(r"(If|Else) \(", text):
            child = Branch()
            parent.children.append(child)
            path.append((depth, child))
        elif text.startswith("Predict"):
            parent.leaf = number
            number += 1
    return root


def counted(root: Branch, rows: DataFrame, label: str = "label_index", leaf: str = "leaf", weight: str | None = None) -> dict[int, np.ndarray]:
    """Rows (or their weights) of each class in each leaf; one aggregate, as many rows as leaves."""
    one = F.sum(weight) if weight else F.count(F.lit(1))
    out = {x.leaf: np.zeros(2) for x in root.leaves()}
    for r in rows.groupBy(F.col(leaf).cast("int").alias("leaf"), F.col(label).cast("int").alias("hit")).agg(one.alias("n")).collect():
        out[r["leaf"]][r["hit"]] += float(r["n"])
    return out


def _fill(node: Branch, leaves: dict[int, np.ndarray]) -> np.ndarray:
    node.counts = leaves[node.leaf] if not node.children else sum((_fill(c, leaves) for c in node.children), np.zeros(2))
    return node.counts


def complexity(node: Branch, table: dict[int, float]) -> tuple[float, int]:
    """The complexity up to which each branch is kept, by id; (risk, leaves) of the node's best subtree at complexity 0.

    The weakest link goes first: a branch is worth the risk it saves for each leaf it adds.
    """
    order: dict[int, float] = {}

    def sums(x: Branch) -> tuple[float, int]:
        if not x.children or id(x) in order:
            return x.risk(), 1
        parts = [sums(c) for c in x.children]
        return sum(p[0] for p in parts), sum(p[1] for p in parts)

    def open_branches(x: Branch) -> list[Branch]:
        return [] if not x.children or id(x) in order else [x] + [y for c in x.children for y in open_branches(c)]

    highest = 0.0
    while found := open_branches(node):
        worth = []
        for x in found:
            risk, leaves = sums(x)
            worth.append((x.risk() - risk) / (leaves - 1))
        weakest = min(worth)
        highest = max(highest, weakest)
        for x, w in zip(found, worth, strict=True):
            if w <= weakest + 1e-12:
                for y in open_branches(x):  # what hangs below goes with it
                    order[id(y)] = highest
    table.update(order)
    return sums(node)


def pruned_scores(root: Branch, leaves: dict[int, np.ndarray], values: Sequence[float]) -> np.ndarray:
    """The share of positives that each leaf is given at each complexity: one row a value, one column a leaf.

    Complexities are in units of the root's risk, as usual for trees: a branch stays if it saves more than that for each leaf.
    """
    _fill(root, leaves)
    kept: dict[int, float] = {}
    complexity(root, kept)
    out = np.zeros((len(values), len(leaves)))
    unit = root.risk() or 1.0

    def walk(x: Branch, limit: float, row: np.ndarray, score: float | None) -> None:
        total = x.counts.sum()
        own = float(x.counts[1] / total) if total else 0.5
        if score is None and (not x.children or kept[id(x)] <= limit):
            score = own
        if not x.children:
            row[x.leaf] = own if score is None else score
        for c in x.children:
            walk(c, limit, row, score)

    for i, v in enumerate(values):
        walk(root, v * unit, out[i], None)
    return out


def ranked_area(score: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> float:
    """Area under the ROC curve of leaves with one score each; ties count one half. NaN without both classes."""
    order = np.argsort(score)
    score, pos, neg = score[order], pos[order], neg[order]
    edge = np.append(np.flatnonzero(np.diff(score)) + 1, len(score)) - 1
    p, n = np.diff(np.append(0, np.cumsum(pos)[edge])), np.diff(np.append(0, np.cumsum(neg)[edge]))
    if not pos.sum() or not neg.sum():
        return float("nan")
    below = np.cumsum(n) - n
    return float((p * (below + n / 2)).sum() / pos.sum() / neg.sum())
