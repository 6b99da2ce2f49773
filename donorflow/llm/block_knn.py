"""Exact nearest neighbours by tiles of int8 products with error bounds."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES, QUERIES = 16_384, 4_096
_STRIP = 64


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and the length of what rounding took from each row."""
    scale = np.maximum(np.abs(x).max(1), np.finfo(np.float64).tiny * 256) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(np.square(x - q * scale[:, None]).sum(1))


def int8_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T exactly: sums of at most 1024 products of int8 fit in a float's 24 bits."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], 1024):
        out += a[:, at : at + 1024].astype(np.float32) @ b[:, at : at + 1024].astype(np.float32).T
    return out


def nearest_in_tile(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> list[tuple[int, float, int]]:
    """(query's place, distance, vec_id) of the k nearest rows of each query; ties go to the smaller id.

    |true distance - distance of int8 rows| is at most the sum of both rounding lengths. Rows whose lower bound exceeds the
    k-th least upper bound are dropped; the others get their distance in double precision.
    """
    (q, qs, qe), (r, rs, re) = quantised(queries), quantised(rows)
    qn, rn = (np.square(q.astype(np.float64)).sum(1) * qs**2), (np.square(r.astype(np.float64)).sum(1) * rs**2)
    found = []
    for at in range(0, len(q), _STRIP):
        s = slice(at, at + _STRIP)
        near = np.sqrt(np.maximum(qn[s, None] + rn[None, :] - 2 * qs[s, None] * rs[None, :] * int8_product(q[s], r), 0))
        slack = (qe[s, None] + re[None, :]) * (1 + 1e-9) + 1e-7 * (np.sqrt(qn[s])[:, None] + np.sqrt(rn)[None, :])
        own = query_ids[s, None] == row_ids[None, :]
        upper = np.where(own, np.inf, near + slack)
        limit = np.partition(upper, k - 1, axis=1)[:, k - 1] if upper.shape[1] > k else np.full(len(upper), np.inf)
        for i, alive in enumerate((near - slack <= limit[:, None]) & ~own):
            at_rows = np.flatnonzero(alive)
            exact = np.sqrt(np.square(rows[at_rows] - queries[at + i]).sum(1))
            found += [(at + i, d, v) for d, v in heapq.nsmallest(k, zip(exact.tolist(), row_ids[at_rows].tolist(), strict=True))]
    return found


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and no component null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(table: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each query row by Euclidean distance, ties to the smaller id.

    Queries and candidates are dealt to blocks by hash; every pair of blocks is one tile, so a task holds two bounded blocks
    whatever the input, and a block travels once for each block of the other side. Each tile yields k rows a query, and the
    k best of all tiles are kept (Spark trims them before the shuffle, too).

    Rows with a null id, and vectors that are null, empty, zero or hold null or non-finite components, take no part. Vectors
    are compared with those of equal length only. Rows that repeat id and vector count once; a query isn't its own
    candidate, nor are rows of its id. Other columns are not read. No rows: no rows.
    """
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("v"))).dropDuplicates(["vec_id", "v"])
    rows = rows.withColumn("size", F.size("v"))
    n, asked = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("q"), 1))).first()
    across, down = max(1, math.ceil(n / candidates)), max(1, math.ceil(asked / queries))
    hashed = F.xxhash64("vec_id", "v")
    cells = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    left = rows.filter("q").select("size", F.pmod(hashed, F.lit(down)).cast("int").alias("down"), cells(across).alias("across"), "vec_id", "v")
    right = rows.select("size", cells(down).alias("down"), F.pmod(hashed, F.lit(across)).cast("int").alias("across"), "vec_id", "v")

    def matrix(t: pa.Table, width: int) -> np.ndarray:
        return t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    def tile(asked: pa.Table, held: pa.Table) -> pa.Table:
        found: list = []
        if asked.num_rows and held.num_rows:
            width = asked.column("size")[0].as_py()
            ids = asked.column("vec_id").to_numpy()
            found = [(int(ids[i]), v, d) for i, d, v in nearest_in_tile(matrix(asked, width), ids, matrix(held, width), held.column("vec_id").to_numpy(), k)]
        a, b, c = zip(*found, strict=True) if found else ((), (), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["query_id", "vec_id", "score"])

    by = ["size", "down", "across"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(tile, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
