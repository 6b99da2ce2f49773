"""Rows repeated with numbers, each with seeded uniform numbers: those of ``ordered.uniform``, made in batches."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

BATCH = 1 << 15  # numbers made at a time; their arrays stay in a core's cache
TASK_ROWS = 1_000_000  # repeated rows from which a task's work is dealt over more tasks
PAGE_BITS = 12  # a page holds 1 << PAGE_BITS numbered rows of a looked-up table
SENT_VALUES = 16_000_000  # counted values, 8 bytes each, up to which a looked-up table is sent to all executors
ONE_BLOCK = 55  # bytes of the longest text that MD5 takes as one block

_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = np.array([int(abs(math.sin(i + 1)) * 2**32) for i in range(64)], np.uint32)
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def spread(df: DataFrame, rows: int, per_task: int) -> DataFrame:
    """Rows dealt evenly over tasks of about ``per_task`` rows; a table for one task stays as it is."""
    return df.repartition(math.ceil(rows / per_task)) if rows > per_task else df


def looked_up(frame: DataFrame, at: str, table: DataFrame, number: str, columns: Sequence[str], values: int) -> DataFrame:
    """``columns`` of the row of ``table`` whose ``number`` (1, 2, 3 ... without gaps) the column ``at`` holds.

    Rows of the table are packed into pages, a page into one array a column, and pages are sent to all
    executors: many millions of repeated rows then stay where they were made. ``values`` counts
    what is sent together; above ``SENT_VALUES`` both sides meet by a shuffle.
    """
    if values > SENT_VALUES:
        one = table.select(F.col(number).alias("__number"), *columns)
        return frame.join(one, F.col(at) == F.col("__number")).drop("__number")
    place = F.col(number).cast("long") - 1
    rows = table.select(F.shiftright(place, PAGE_BITS).alias("__page"), F.struct(place.alias("__place"), *columns).alias("__row"))
    pages = rows.groupBy("__page").agg(F.sort_array(F.collect_list("__row")).alias("__rows"))
    pages = pages.select("__page", *[F.col(f"__rows.{c}").alias(f"__all_{c}") for c in columns])
    wanted = F.col(at).cast("long") - 1
    met = frame.join(F.broadcast(pages), F.shiftright(wanted, PAGE_BITS) == F.col("__page"))
    inside = wanted.bitwiseAND(F.lit((1 << PAGE_BITS) - 1)).cast("int")
    return met.select(*frame.columns, *[F.get(F.col(f"__all_{c}"), inside).alias(c) for c in columns])


def _bits(words: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The first 52 bits of the MD5 of one-block messages, given as 16 arrays of words that broadcast to ``shape``."""
    a, b, c, d = (np.full(shape, v, np.uint32) for v in _START)
    f, turned = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        if i < 16:
            at = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            at = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            at = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += words[at] + _SINES[i]
        np.left_shift(f, _TURNS[i], out=turned)
        f >>= 32 - _TURNS[i]
        f |= turned
        f += b
        a, b, c, d, f = d, f, b, c, a
    first, second = a + np.uint32(_START[0]), b + np.uint32(_START[1])
    return np.stack([first, second], axis=-1).astype("<u4").view(">u8")[..., 0].astype(np.uint64) >> np.uint64(12)


@lru_cache(maxsize=64)
def _end_words(tails: tuple[bytes, ...], size: int) -> np.ndarray:
    """The 16 words of each tail after a head of ``size`` bytes, with the mark and the length that end a message."""
    ends = np.zeros((len(tails), 64), np.uint8)
    for row, t in zip(ends, tails):
        row[size:size + len(t) + 1] = np.frombuffer(t + b"\x80", np.uint8)
        row[56:58] = np.frombuffer(((size + len(t)) * 8).to_bytes(2, "little"), np.uint8)
    return np.ascontiguousarray(ends.view("<u4").T)


def uniforms(heads: Sequence[bytes], tails: tuple[bytes, ...]) -> np.ndarray:
    """(heads, tails): the uniform number of each head followed by each tail, as ``ordered.uniform`` makes it from their text."""
    out = np.empty((len(heads), len(tails)))
    sizes = np.array([len(h) for h in heads], dtype=int)
    longest = max(map(len, tails))
    step = max(1, BATCH // len(tails))
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        if size + longest > ONE_BLOCK:
            for i in at:
                out[i] = [(int(hashlib.md5(heads[i] + t).hexdigest()[:13], 16) + 0.5) / float(1 << 52) for t in tails]
            continue
        ends = _end_words(tails, size)
        begins = np.frombuffer(b"".join(heads[i].ljust(64, b"\0") for i in at), "<u4").reshape(-1, 16)
        for low in range(0, len(at), step):
            part = begins[low:low + step]
            words = [part[:, i, None] if 4 * i + 4 <= size else part[:, i, None] | ends[i] if 4 * i < size else ends[i] for i in range(16)]
            out[at[low:low + step]] = (_bits(words, (len(part), len(tails))) + 0.5) / float(1 << 52)
    return out


def numbered(
    rows: DataFrame, key: str, n: int, name: str, seed: int, uniform: Mapping[str, tuple[Sequence[str], Sequence[str]]],
    normal: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Each row ``n`` times, with its number 1..n as ``name`` and columns of seeded numbers.

    ``uniform`` gives the tags before the key and after the number: a column holds
    ``uniform(seed, *before, key, name, *after)``. ``normal`` gives the tags before the key of
    ``gaussian(seed, *before, key, name)``.
    """
    normal = normal or {}
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    schema = StructType([*rows.schema.fields, StructField(name, IntegerType()), *[StructField(c, DoubleType()) for c in (*uniform, *normal)]])

    def around(before: Sequence[str], after: Sequence[str] = ()) -> tuple[bytes, bytes]:
        return "".join(f"{b}|" for b in [str(seed), *before]).encode(), "".join(f"|{a}" for a in after).encode()

    plain = [around(*tags) for tags in uniform.values()]
    pairs = [(around(["radius", *tags]), around(["angle", *tags])) for tags in normal.values()]

    def repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [k.encode() for k in batch.column(batch.num_columns - 1).to_pylist()]
            kept = batch.select(list(range(batch.num_columns - 1)))
            for start in range(1, n + 1, BATCH):
                numbers = np.arange(start, min(start + BATCH, n + 1), dtype=np.int32)
                ends = {end: tuple(b"|%d%s" % (i, end) for i in numbers.tolist()) for end in {b"", *[end for _, end in plain]}}
                step = max(1, 4 * BATCH // len(numbers))
                for low in range(0, len(keys), step):
                    some = keys[low:low + step]

                    def made(text: tuple[bytes, bytes]) -> np.ndarray:
                        return uniforms([text[0] + k for k in some], ends[text[1]]).ravel()

                    columns = kept.take(pa.array(np.repeat(np.arange(low, low + len(some)), len(numbers)))).columns
                    columns += [pa.array(np.tile(numbers, len(some))), *[pa.array(made(text)) for text in plain]]
                    columns += [pa.array(np.sqrt(-2.0 * np.log(made(radius))) * np.cos(2.0 * math.pi * made(angle))) for radius, angle in pairs]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.withColumn("__text", text).mapInArrow(repeat, schema)
