"""Exact nearest neighbors of rows among themselves.

Equal points collapse first, so a mass of copies is one point with its smallest keys. Space is
cut into cells along each cell's widest axis until a cell holds few points. Points first meet
the others of their cell; the k-th distance found there then tells which further cells may
hold a nearer one. Those cells are looked up by going down the tree of boxes, one equi-join a
level, and only the points that need a cell are sent to it, in blocks. Nothing is left out, so
the result is that of comparing all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorflow.operators.ordered import in_chunks
from donorflow.session import reliable_checkpoint

CELL = 512  # points from which a cell is cut again
WAYS_BITS = 4
BLOCK = 4096  # points sent to a cell at a time
TASK_POINTS = 20_000  # points of a task that compares them; Spark would size tasks by their few bytes
SLACK = 1 + 1e-12  # box distances are rounded as well


def collapsed(rows: DataFrame, k: int) -> DataFrame:
    """(pid, x, keys) of different points from (key, x): pid is the smallest key, keys are the k + 1 smallest."""
    few = F.slice(F.sort_array(F.collect_list("key")), 1, k + 1)
    parts = in_chunks(rows, ["x", "key"]).groupBy("x", "__chunk").agg(few.alias("keys"))
    whole = parts.groupBy("x").agg(F.slice(F.sort_array(F.flatten(F.collect_list("keys"))), 1, k + 1).alias("keys"))
    return whole.select(F.col("keys")[0].alias("pid"), "x", "keys")


def _boxes(points: DataFrame, axes: int) -> DataFrame:
    ends = [F.array(*[f(F.col("x")[i]) for i in range(axes)]).alias(n) for f, n in ((F.min, "low"), (F.max, "high"))]
    return points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *ends)


def cut_space(points: DataFrame, axes: int, cell: int) -> tuple[DataFrame, DataFrame]:
    """Points with their ``cell``, and the tree of boxes (node, parent, low, high, wide, leaf).

    A node's children are its number shifted by WAYS_BITS; ``wide`` is the diagonal of its
    parent's box. Each round cuts all large cells at quantiles of their widest axis into 2, 4, 8 or
    16, no more than it takes, since every cell costs a task some time.
    """
    ways = 1 << WAYS_BITS
    points = reliable_checkpoint(points.withColumn("cell", F.lit(1).cast("long")))
    inner = []
    while True:
        boxes = reliable_checkpoint(_boxes(points, axes))
        large = boxes.filter(F.col("n") > cell)
        if large.isEmpty():
            break
        inner.append(large)
        spread = F.zip_with("high", "low", lambda a, b: a - b)
        axis = F.array_position(spread, F.array_max(spread)).cast("int")
        widest = large.select("cell", axis.alias("axis"), F.col("n").alias("points"))
        shares = [i / ways for i in range(1, ways)]
        value = F.element_at("x", F.col("axis"))
        cuts = points.join(widest, "cell").groupBy("cell", "axis", "points").agg(
            F.percentile_approx(value, shares, 2000).alias("cuts"), F.min(value).alias("least"), F.max(value).alias("most"))
        step = reduce(lambda found, w: F.when(F.col("points") <= cell * w, ways // w).otherwise(found), [8, 4, 2], F.lit(1))
        cuts = cuts.withColumn("step", step)
        every = F.array_distinct(F.filter("cuts", lambda c: c < F.col("most")))
        some = F.array_distinct(F.filter("cuts", lambda c, i: (c < F.col("most")) & ((i + 1) % F.col("step") == 0)))
        inside = F.when(F.size(some) > 0, some).otherwise(every)
        cuts = cuts.select(F.col("cell").alias("of"), "axis", F.when(F.size(inside) > 0, inside).otherwise(F.array("least")).alias("cuts"))
        moved = points.join(cuts, F.col("cell") == F.col("of"), "left")
        child = F.shiftleft("cell", WAYS_BITS) + F.size(F.filter("cuts", lambda c: c < value))
        points = reliable_checkpoint(moved.select("pid", "x", "keys", F.when(F.col("of").isNull(), F.col("cell")).otherwise(child).alias("cell")))
    tree = boxes.withColumn("leaf", F.lit(True))
    for large in inner:
        tree = tree.unionByName(large.withColumn("leaf", F.lit(False)))
    tree = tree.select(F.col("cell").alias("node"), F.shiftright("cell", WAYS_BITS).alias("parent"), "low", "high", "leaf")
    diagonal = F.sqrt(F.aggregate(F.zip_with("high", "low", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, v: t + v))
    above = tree.filter(~F.col("leaf")).select(F.col("node").alias("parent"), diagonal.alias("wide"))
    return points, reliable_checkpoint(tree.join(above, "parent", "left"))


def _gap(axes: int, low: str, high: str, other_low: str, other_high: str) -> Column:
    """Distance between two boxes; a point is a box of its own."""
    parts = [F.greatest(F.col(other_low)[i] - F.col(high)[i], F.col(low)[i] - F.col(other_high)[i], F.lit(0.0)) for i in range(axes)]
    return F.sqrt(reduce(lambda a, b: a + b, [p * p for p in parts]))


def _nearest(x: np.ndarray, y: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in y of the k nearest of each x (ties: first places), their distances and the k-th one; infinite: there are fewer."""
    total = np.zeros((len(x), len(y)))
    for i in range(x.shape[1]):
        gap = x[:, i][:, None] - y[:, i]
        total += gap * gap
    distance = np.sqrt(total)
    if own is not None:
        distance[np.arange(len(x)), own] = np.inf
    if len(y) <= k:
        place = np.argsort(distance, axis=1, kind="stable")
    else:
        place = np.sort(np.argpartition(distance, k - 1, axis=1)[:, :k], axis=1)
        near = np.take_along_axis(distance, place, axis=1)
        place = np.take_along_axis(place, np.argsort(near, axis=1, kind="stable"), axis=1)
        tied = np.flatnonzero((distance <= near.max(axis=1)[:, None]).sum(axis=1) > k)
        place[tied] = np.argsort(distance[tied], axis=1, kind="stable")[:, :k]
    far = np.take_along_axis(distance, place, axis=1)
    last = far[:, -1] if place.shape[1] == k else np.full(len(x), np.inf)
    return place, far, last


def _all_nearest(x: np.ndarray, y: np.ndarray, ids: pa.Array, k: int, own: bool = False) -> tuple[pa.Array, np.ndarray]:
    """For each x the (d, pid) of its k nearest y, ties to smaller ids, and the k-th distance. own: x are the points y themselves."""
    by_id = pc.sort_indices(ids).to_numpy()
    y, place = y[by_id], np.empty(len(by_id), int)
    place[by_id] = np.arange(len(by_id))
    parts = [_nearest(x[at:at + CELL], y, k, place[at:at + CELL] if own else None) for at in range(0, len(x), CELL)]
    places, far, last = (np.concatenate(p) for p in zip(*parts))
    there = np.isfinite(far)
    pairs = pa.StructArray.from_arrays([pa.array(far[there]), ids.take(pa.array(by_id[places[there]]))], names=["d", "pid"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(there.sum(axis=1))).astype(np.int32)), pairs), last


def _whole(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)


def _points(table: pa.Table, axes: int) -> np.ndarray:
    return _whole(table, "x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, axes)


def nearest_points(points: DataFrame, axes: int, k: int, cell: int = CELL) -> DataFrame:
    """(pid, found): the k nearest other points of each as (d, pid), by distance and then pid. points: of collapsed()."""
    points, tree = cut_space(points, axes, cell)
    kind = points.schema["pid"].dataType.simpleString()
    found_type = f"array<struct<d:double,pid:{kind}>>"
    leaves = tree.filter("leaf")
    ready = points.join(leaves.select(F.col("node").alias("cell"), "wide"), "cell").select("pid", "x", "cell", "wide", F.size("keys").alias("copies"))
    ready = reliable_checkpoint(ready)

    def inside(group: pa.Table) -> pa.Table:
        x, ids = _points(group, axes), _whole(group, "pid")
        found, last = _all_nearest(x, x, ids, k, own=True)
        wide = group.column("wide").to_numpy().astype(float)
        reach = np.where(np.isfinite(last), last, np.where(np.isnan(wide), -1.0, wide))
        reach = np.where(group.column("copies").to_numpy() > k, -1.0, reach)  # its own copies are enough
        return pa.table({"pid": ids, "x": group.column("x"), "cell": group.column("cell"), "reach": reach, "found": found})

    tasks = max(1, math.ceil(ready.count() / TASK_POINTS))
    first = ready.repartition(tasks, "cell").groupBy("cell").applyInArrow(inside, f"pid {kind}, x array<double>, cell long, reach double, found {found_type}")
    first = reliable_checkpoint(first)
    # cells that a cell's farthest reach touches: down the tree, level by level
    far = first.groupBy("cell").agg((F.max("reach") * SLACK).alias("reach")).filter("reach >= 0")
    at = far.join(leaves.select(F.col("node").alias("cell"), "low", "high"), "cell").withColumn("at", F.lit(1).cast("long"))
    children = tree.select("node", "parent", F.col("low").alias("olow"), F.col("high").alias("ohigh"), "leaf")
    pairs = None
    while True:
        near = at.join(children, F.col("at") == F.col("parent")).filter(_gap(axes, "low", "high", "olow", "ohigh") <= F.col("reach"))
        near = reliable_checkpoint(near.select("cell", "reach", "low", "high", "node", "olow", "ohigh", "leaf"))
        if near.isEmpty():
            break
        hit = near.filter("leaf AND node <> cell").select("cell", F.col("node").alias("other"), "olow", "ohigh")
        pairs = hit if pairs is None else pairs.unionByName(hit)
        at = near.filter("NOT leaf").select("cell", "reach", "low", "high", F.col("node").alias("at"))
    merged = first.select("pid", "found")
    if pairs is not None:
        sent = first.filter("reach >= 0").join(pairs, "cell").filter(_gap(axes, "x", "x", "olow", "ohigh") <= F.col("reach") * SLACK).select("pid", "x", "other")
        sent = reliable_checkpoint(sent)
        blocks = sent.groupBy("other").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        asking = sent.join(blocks, "other").select("pid", "x", "other", F.pmod(F.xxhash64("pid"), F.col("blocks")).cast("int").alias("block"))
        held = ready.select("pid", "x", F.col("cell").alias("other")).join(blocks, "other")
        held = held.select("pid", "x", "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

        def across(asked: pa.Table, there: pa.Table) -> pa.Table:
            if not (asked.num_rows and there.num_rows):
                return pa.table({"pid": _whole(asked, "pid"), "found": pa.nulls(asked.num_rows, pairs_type(asked.column("pid").type))})
            found, _ = _all_nearest(_points(asked, axes), _points(there, axes), _whole(there, "pid"), k)
            return pa.table({"pid": _whole(asked, "pid"), "found": found})

        def pairs_type(pid: pa.DataType) -> pa.DataType:
            return pa.list_(pa.struct([("d", pa.float64()), ("pid", pid)]))

        tasks = max(1, math.ceil(sent.count() / TASK_POINTS))
        asking, held = (df.repartition(tasks, "other", "block") for df in (asking, held))
        more = asking.groupBy("other", "block").cogroup(held.groupBy("other", "block")).applyInArrow(across, f"pid {kind}, found {found_type}")
        merged = merged.unionByName(more)
    best = F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k)
    return merged.groupBy("pid").agg(best.alias("found"))


def nearest_neighbors(df: DataFrame, features: Sequence[str], key: str, k: int, cell: int = CELL) -> DataFrame:
    """(key, x, near): the k nearest other rows of each row as (d, key, y), by distance and then key; exact.

    ``key`` must be unique. Rows with a NULL or NaN feature take no part. Copies of a row are its neighbors at distance 0.
    """
    numbers = [F.col(f).cast("double") for f in features]
    whole = reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c) for c in numbers])
    # -0.0 is 0.0: equal values must be equal points
    rows = reliable_checkpoint(df.filter(whole).select(F.col(key).alias("key"), F.array(*[c + F.lit(0.0) for c in numbers]).alias("x")))
    points = reliable_checkpoint(collapsed(rows, k))
    found = nearest_points(points, len(features), k, cell)
    others = points.select(F.col("pid").alias("other"), F.col("x").alias("y"), F.col("keys").alias("theirs"))
    wide = found.select("pid", F.explode_outer("found").alias("f")).join(others, F.col("f.pid") == F.col("other"), "left")
    lists = wide.groupBy("pid").agg(F.collect_list(F.when(F.col("f").isNotNull(), F.struct(F.col("f.d").alias("d"), "theirs", "y"))).alias("lists"))
    mine = points.join(lists, "pid").select(F.col("x").alias("at"), F.col("keys").alias("own"), "lists")
    joined = rows.join(mine, F.col("x") == F.col("at"))
    copies = F.transform(F.filter("own", lambda c: c != F.col("key")), lambda c: F.struct(F.lit(0.0).alias("d"), c.alias("key"), F.col("x").alias("y")))
    rest = F.flatten(F.transform("lists", lambda f: F.transform(f["theirs"], lambda c: F.struct(f["d"].alias("d"), c.alias("key"), f["y"].alias("y")))))
    return joined.select("key", "x", F.slice(F.sort_array(F.concat(copies, rest)), 1, k).alias("near"))
