"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorflow.session import reliable_checkpoint

WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_ROWS = 100_000
Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def checkpointed(df: DataFrame) -> DataFrame:
    """Lineage cut in the shared folder of spark.checkpoint.dir."""
    return reliable_checkpoint(df)


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """The whole input row as one struct `row`, beside computed columns: names of the input can't clash with ours."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def unpacked(df: DataFrame, *more: str) -> DataFrame:
    """The input's columns again, and `more` of ours; an input column of the same name gives way."""
    names = [f.name for f in df.schema["row"].dataType.fields if f.name not in more]
    return df.select(*[F.col("row").getField(n).alias(n) for n in names], *more)


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint, only if the counted rows of a narrow table are few; otherwise the join shuffles and AQE splits hot keys."""
    return F.broadcast(df) if rows <= most else df


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) from the keys, the same in every run and engine: 52 bits of an MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string") if isinstance(k, str) else k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """Adds `place`, the row's number from 0 in the given order, without a window over one task."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = checkpointed(ranged)
    part = F.shiftright("_id", 33)
    sizes = sorted((r[0], r[1]) for r in ranged.groupBy(part).count().collect())  # one row for each partition
    before, at = [], 0
    for p, n in sizes:
        before += [F.lit(p), F.lit(at)]
        at += n
    offset = F.create_map(*before)[part] if before else F.lit(0)
    return ranged.withColumn("place", (offset + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_id")


def tidy(work: Batches) -> Batches:
    """`work` for mapInArrow; at a task's end the worker, which Spark uses again, gives freed memory back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return run
