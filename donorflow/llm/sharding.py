"""Uniform shuffle into shards of exact sizes, with a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from donorflow.llm.common import checkpointed, packed, small, unpacked

CELL_ROWS = 200_000


def draw_good(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many good ones a sample without replacement holds, exactly distributed for any population.

    numpy draws populations below 10^9; larger ones are drawn by inversion from the mode outwards, whose steps number a few
    standard deviations.
    """
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, sample)) if sample else 0
    low, high = max(0, sample - bad), min(good, sample)
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    mode = min(max((sample + 1) * (good + 1) // (good + bad + 2), low), high)
    here = math.exp(log(good, mode) + log(bad, sample - mode) - log(good + bad, sample))
    left, right, p_left, p_right, u = mode, mode, here, here, rng.random() - here
    while u > 0 and (left > low or right < high):
        if right < high:
            p_right *= (good - right) * (sample - right) / ((right + 1) * (bad - sample + right + 1))
            right, u = right + 1, u - p_right
            if u <= 0:
                return right
        if left > low:
            p_left *= left * (bad - sample + left) / ((good - left + 1) * (sample - left + 1))
            left, u = left - 1, u - p_left
            if u <= 0:
                return left
        if p_left + p_right < 1e-300:
            break
    return mode


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """How many rows each partition sends to each shard: a uniform permutation's counts, with shard sizes at most one apart."""
    rng = np.random.default_rng(seed)
    total = sum(rows)
    free = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = np.zeros((len(rows), shards), np.int64)
    for p, left in enumerate(rows):
        rest = sum(free)
        for s in range(shards):
            rest -= free[s]
            n = draw_good(rng, free[s], rest, left)
            matrix[p, s], left, free[s] = n, left - n, free[s] - n
    return matrix


def shuffle_into_shards(docs: DataFrame, shards: int = 16, seed: int = 2) -> DataFrame:
    """Every input row with `shard` (0 .. shards - 1) and `slot` (gapless from 0 in each shard), uniformly at random.

    1. Rows get a number in their partition and are written to the checkpoint folder, so a lost executor changes nothing.
    2. From the row counts of the partitions alone, the driver draws the communication matrix.
    3. Each partition permutes its rows and sends the drawn number to each shard.
    4. Shards are cut into cells of about 200,000 rows by leading hash bits; each cell permutes again and knows how many
       rows lie before it. Neither a shard nor a group of equal rows meets in one task.

    Shard sizes differ by at most one row. Nulls, empty texts and repeated rows are rows like any other; no rows: no rows.
    Input columns named `shard` or `slot` are replaced.
    """
    tagged = checkpointed(packed(docs, id=F.monotonically_increasing_id()))
    part = F.shiftright("id", 33)
    counts = sorted((r[0], r[1]) for r in tagged.groupBy(part).count().collect())  # one row for each partition
    matrix = communication_matrix([n for _, n in counts], shards, seed)
    sends = {p: (n, np.cumsum(m)) for (p, n), m in zip(counts, matrix, strict=True)}

    def permute(batches):
        place, at = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            p = int(ids[0] >> 33)
            if at != p:
                at, place = p, np.random.default_rng([seed, 1, p]).permutation(sends[p][0])
            shard = np.searchsorted(sends[p][1], place[ids & ((1 << 33) - 1)], side="right")
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(shard.astype(np.int32)), *batch.columns[1:]], names=["id", "shard", *batch.schema.names[1:]])

    row = tagged.schema["row"].dataType.simpleString()
    sent = tagged.select("id", "row").mapInArrow(permute, f"id long, shard int, row {row}")
    bits = max(0, math.ceil(math.log2(max(1, sum(n for _, n in counts)) / shards / CELL_ROWS)))
    key = F.xxhash64(F.lit(seed), F.col("id"))
    sent = sent.withColumn("key", key).withColumn("cell", F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long"))
    cells = sent.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("shard", "cell", F.coalesce(before, F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("key", "id"))
    placed = sent.withColumn("number", number).join(small(cells, shards << bits), ["shard", "cell"])
    return unpacked(placed.withColumn("slot", (F.col("before") + F.col("number") - 1).cast("long")), "shard", "slot")
