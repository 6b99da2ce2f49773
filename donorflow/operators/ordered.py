"""Ordered computations per subject, or over one global order, without a hot task.

A plain window puts all rows of one key into one task. That is right for ordinary
subjects, and wrong for a subject that owns a third of the table, or for a global order.

* ``in_chunks`` sorts rows over range partitions, as many as the counted rows ask for, and
  names each row's chunk and its place there. A global order (``running``) always takes
  this way: windows run inside a chunk, and one summary row per chunk carries sums, maxima
  and the last few rows forward.
* ``attach`` looks at the number of rows per key once (a map-side combined count). Keys
  with at most ``HOT_ROWS`` rows go through ordinary windows, all of which share a single
  exchange on the key; the rows of larger keys take the way of a global order. The larger
  keys stay a table: they meet the rows by a join, never as literals.

Results are the same whichever way a row went. Chunks are held in the checkpoint folder, so
plans stay short and a lost executor only rereads them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from donorflow.session import reliable_checkpoint

HOT_ROWS = 1_000_000
CHUNK_ROWS = 100_000
PLACE_BITS = 33  # of monotonically_increasing_id; the partition's number stands above
PIECE_DIGITS = 4


@dataclass(frozen=True)
class Lag:
    """Value ``n`` rows earlier in the subject's order."""

    value: Any
    n: int = 1
    default: Any = None


@dataclass(frozen=True)
class RunSum:
    """Running sum, with or without the current row; 0 before the first row."""

    value: Any
    current: bool = True


@dataclass(frozen=True)
class RunMax:
    """Running maximum of the non-NULL values so far.

    For a value that grows along the order (a date, a running sum) this is also
    'the last non-NULL value'.
    """

    value: Any
    current: bool = True


@dataclass(frozen=True)
class Total:
    """Sum over all rows of the subject."""

    value: Any


@dataclass(frozen=True)
class Whole:
    """Any aggregate over all rows of the subject, or of (subject, extra columns)."""

    agg: Column
    extra: tuple[str, ...] = ()


@dataclass(frozen=True)
class SpanSum:
    """Sum over rows whose clock lies in [clock - span, clock], peers included."""

    value: Any
    clock: str
    span: int


@dataclass(frozen=True)
class HotKeys:
    """Keys with more than ``limit`` rows, as a table of one column (None: there are none).

    ``only`` says that a frame holds no other rows, so that it need not be split again.
    """

    keys: DataFrame | None = None
    rows: int = 0
    limit: int = HOT_ROWS
    only: bool = False

    def split(self, df: DataFrame, key: str) -> list[tuple[DataFrame, HotKeys]]:
        """The ordinary rows, and (where there are any) the rows of hot keys, written once."""
        if self.keys is None:
            return [(df, self)]
        keys = self.keys.select(F.col(self.keys.columns[0]).alias("__hot"))
        hot = F.col(key) == F.col("__hot")
        big = reliable_checkpoint(df.join(keys, hot, "left_semi"))
        return [(df.join(keys, hot, "left_anti"), HotKeys()), (big, replace(self, only=True))]


def _names(value: str | Sequence[str]) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def _column(value: Any) -> Column:
    return F.col(value) if isinstance(value, str) else value


def hot_keys(df: DataFrame, key: str, limit: int | None = None) -> HotKeys:
    """Keys with more than ``limit`` rows; only their number and that of their rows reach the driver."""
    limit = limit or HOT_ROWS
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__rows"))
    held = reliable_checkpoint(counts.filter(F.col("__rows") > limit))
    rows = held.agg(F.sum("__rows")).first()[0]
    return HotKeys(held.select(key) if rows else None, rows or 0, limit)


def in_chunks(df: DataFrame, order: str | Sequence[str], by: str | Sequence[str] = (), chunk_rows: int | None = None) -> DataFrame:
    """Rows sorted by ``by`` and ``order`` in range partitions of about ``chunk_rows`` rows.

    Adds ``__chunk``, which rises along the order, and ``__step``, the row's place in its chunk.
    The number of partitions follows the rows, which are counted once they are written.
    """
    order, by = _names(order), _names(by)
    held = reliable_checkpoint(df)
    parts = max(1, math.ceil(held.count() / (chunk_rows or CHUNK_ROWS)))
    ranged = held.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order)
    ranged = reliable_checkpoint(ranged.withColumn("__id", F.monotonically_increasing_id()))
    place = F.col("__id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return ranged.withColumns({"__chunk": F.shiftright("__id", PLACE_BITS), "__step": place}).drop("__id")


def _over_windows(df: DataFrame, key: list[str], order: list[str], specs: dict) -> DataFrame:
    part = Window.partitionBy(*key)
    ordered = part.orderBy(*order) if order else part
    first = Window.unboundedPreceding
    plain, finer = {}, {}
    for name, spec in specs.items():
        if isinstance(spec, Lag):
            plain[name] = F.lag(_column(spec.value), spec.n, spec.default).over(ordered)
        elif isinstance(spec, RunSum):
            frame = ordered.rowsBetween(first, 0 if spec.current else -1)
            plain[name] = F.coalesce(F.sum(_column(spec.value)).over(frame), F.lit(0))
        elif isinstance(spec, RunMax):
            frame = ordered.rowsBetween(first, 0 if spec.current else -1)
            plain[name] = F.max(_column(spec.value)).over(frame)
        elif isinstance(spec, Total):
            plain[name] = F.sum(_column(spec.value)).over(part)
        elif isinstance(spec, SpanSum):
            frame = part.orderBy(spec.clock).rangeBetween(-spec.span, 0)
            plain[name] = F.coalesce(F.sum(_column(spec.value)).over(frame), F.lit(0))
        elif spec.extra:
            finer[name] = spec.agg.over(Window.partitionBy(*key, *spec.extra))
        else:
            plain[name] = spec.agg.over(part)
    if plain:
        df = df.withColumns(plain)
    return df.withColumns(finer) if finer else df


def _over_chunks(df: DataFrame, key: list[str], order: list[str], specs: dict, chunk_rows: int | None) -> DataFrame:
    keep = df.columns
    wholes = {n: s for n, s in specs.items() if isinstance(s, Whole)}
    spans = {n: s for n, s in specs.items() if isinstance(s, SpanSum)}
    runs = {n: s for n, s in specs.items() if n not in wholes and n not in spans}
    out = _runs_over_chunks(df, key, order, runs, chunk_rows) if runs else df
    for extra in sorted({s.extra for s in wholes.values()}):
        keys = [*key, *extra]
        group = df.groupBy(*keys).agg(*[s.agg.alias(n) for n, s in wholes.items() if s.extra == extra])
        out = out.join(group, keys)
    for name, spec in spans.items():
        out = out.join(_span_over_chunks(df, key, name, spec, chunk_rows), [*key, spec.clock])
    return out.select(*keep, *specs)


def _runs_over_chunks(df: DataFrame, key: list[str], order: list[str], specs: dict, chunk_rows: int | None) -> DataFrame:
    keep = df.columns
    base = in_chunks(df.withColumns({f"__v_{n}": _column(s.value) for n, s in specs.items()}), order, key, chunk_rows)
    keys = [*key, "__chunk"]
    part = Window.partitionBy(*keys)
    inside = part.orderBy("__step")
    first = Window.unboundedPreceding
    lags = {n: s for n, s in specs.items() if isinstance(s, Lag)}
    depth = max([s.n for s in lags.values()], default=0)

    local = {}
    for name, spec in specs.items():
        value = F.col(f"__v_{name}")
        if isinstance(spec, Lag):
            local[f"__l_{name}"] = F.lag(value, spec.n).over(inside)
        elif isinstance(spec, RunSum):
            frame = inside.rowsBetween(first, 0 if spec.current else -1)
            local[f"__l_{name}"] = F.coalesce(F.sum(value).over(frame), F.lit(0))
        elif isinstance(spec, RunMax):
            frame = inside.rowsBetween(first, 0 if spec.current else -1)
            local[f"__l_{name}"] = F.max(value).over(frame)
    if lags:
        local["__r"] = F.row_number().over(inside)
        local["__n"] = F.count(F.lit(1)).over(part)
    body = base.withColumns(local) if local else base

    sums = []
    for name, spec in specs.items():
        value = F.col(f"__v_{name}")
        if isinstance(spec, (RunSum, Total)):
            sums.append(F.coalesce(F.sum(value), F.lit(0)).alias(f"__s_{name}"))
        elif isinstance(spec, RunMax):
            sums.append(F.max(value).alias(f"__s_{name}"))
    sums.append(F.count(F.lit(1)).alias("__size"))
    summary = base.groupBy(*keys).agg(*sums)
    if lags:
        last = F.struct("__r", *[F.col(f"__v_{n}").alias(n) for n in lags])
        tails = (
            body.filter(F.col("__n") - F.col("__r") < depth)
            .groupBy(*keys)
            .agg(F.sort_array(F.collect_list(last)).alias("__tail"))
        )
        summary = summary.join(tails, keys)

    whole = Window.partitionBy(*key)
    before = whole.orderBy("__chunk").rowsBetween(first, -1)
    near = whole.orderBy("__chunk").rowsBetween(-max(depth, 1), -1)
    carry = {}
    for name, spec in specs.items():
        if isinstance(spec, RunSum):
            carry[f"__b_{name}"] = F.coalesce(F.sum(f"__s_{name}").over(before), F.lit(0))
        elif isinstance(spec, RunMax):
            carry[f"__b_{name}"] = F.max(f"__s_{name}").over(before)
        elif isinstance(spec, Total):
            carry[f"__b_{name}"] = F.sum(f"__s_{name}").over(whole)
    if lags:
        carry["__b_tail"] = F.flatten(F.collect_list("__tail").over(near))
    summary = summary.withColumns(carry).select(*keys, *carry)

    joined = body.join(summary, keys)
    final = {}
    for name, spec in specs.items():
        if isinstance(spec, RunSum):
            final[name] = F.col(f"__l_{name}") + F.col(f"__b_{name}")
        elif isinstance(spec, RunMax):
            final[name] = F.greatest(f"__l_{name}", f"__b_{name}")
        elif isinstance(spec, Total):
            final[name] = F.col(f"__b_{name}")
        else:
            place = F.size("__b_tail") - (F.lit(spec.n) - F.col("__r"))
            earlier = F.get(F.col("__b_tail"), place - 1)[name]
            final[name] = (
                F.when(F.col("__r") > spec.n, F.col(f"__l_{name}"))
                .when(place >= 1, earlier)
                .otherwise(F.lit(spec.default))
            )
    return joined.withColumns(final).select(*keep, *specs)


def _span_over_chunks(df: DataFrame, key: list[str], name: str, spec: SpanSum, chunk_rows: int | None) -> DataFrame:
    """Sum up to the clock minus the sum strictly before (clock - span).

    Peers collapse first; each distinct clock then asks for its own lower bound with one
    extra row at (clock - span) that sorts in front of real rows of the same time.
    """
    ticks = df.groupBy(*key, spec.clock).agg(F.sum(_column(spec.value)).alias("__v"))
    at = F.col(spec.clock)
    real = ticks.select(*key, at.alias("__at"), at.alias("__x"), F.lit(1).alias("__kind"), "__v")
    ask = ticks.select(
        *key, at.alias("__at"), (at - spec.span).alias("__x"), F.lit(0).alias("__kind"), (F.col("__v") * 0).alias("__v")
    )
    run = _runs_over_chunks(real.unionByName(ask), key, ["__x", "__kind"], {"__c": RunSum("__v")}, chunk_rows)
    upto = F.max(F.when(F.col("__kind") == 1, F.col("__c")))
    below = F.max(F.when(F.col("__kind") == 0, F.col("__c")))
    return run.groupBy(*key, F.col("__at").alias(spec.clock)).agg((upto - below).alias(name))


def attach(
    df: DataFrame,
    key: str,
    order: str | Sequence[str] = (),
    hot: HotKeys | None = None,
    chunk_rows: int | None = None,
    **specs: Any,
) -> DataFrame:
    """Add one column per spec, computed over the rows of ``key`` in ``order``.

    ``order`` must be total inside a key (end it with a unique column). Pass ``hot`` to
    reuse one detection for several calls; NULL keys are never cut. ``chunk_rows`` is the
    number of rows from which a key counts as hot, and of a chunk.
    """
    order = _names(order)
    if hot is None:
        hot = hot_keys(df, key, chunk_rows)
    size = min(hot.limit, CHUNK_ROWS)
    if hot.only:
        return _over_chunks(reliable_checkpoint(df), [key], order, specs, size)
    parts = hot.split(df, key)
    out = _over_windows(parts[0][0], [key], order, specs)
    for big, _ in parts[1:]:
        out = out.unionByName(_over_chunks(big, [key], order, specs, size))
    return out


def running(
    df: DataFrame, order: str | Sequence[str], by: str | Sequence[str] = (), chunk_rows: int | None = None, **specs: Any,
) -> DataFrame:
    """Running values along one order of the whole table, or of each group in ``by``.

    No group and no global order ends in a single task: see ``in_chunks``.
    """
    order, by = _names(order), _names(by)
    frame = df if by else df.withColumn("__all", F.lit(0))
    if any(isinstance(s, (Whole, SpanSum)) for s in specs.values()):
        frame = reliable_checkpoint(frame)  # read once more for each of them
    out = _over_chunks(frame, by or ["__all"], order, specs, chunk_rows)
    return out if by else out.drop("__all")


def row_ranks(df: DataFrame, order: str | Sequence[str], by: str | Sequence[str] = (), name: str = "rank",
              chunk_rows: int | None = None) -> DataFrame:
    """1, 2, 3 ... along ``order``, exact and distributed."""
    return running(df, order, by, chunk_rows, **{name: RunSum(F.lit(1).cast("long"))})


def hash_ranks(
    keys: DataFrame, key: str, seed: int, by: str | Sequence[str] = (), rank: str = "rank", size: str = "size"
) -> DataFrame:
    """Rank the rows of each stratum by a seeded hash of ``key``: an exact shuffle of them.

    The order is that of the MD5 of seed and key, which other engines have too. It is uniform,
    so its leading digits already cut every stratum into equal chunks.
    ``key`` must be unique in ``keys``. Adds ``rank`` (1..n) and ``size`` (n).
    """
    by = _names(by)
    frame = keys.withColumn("__hash", digest(seed, key))
    frame = frame.withColumn("__piece", F.conv(F.substring("__hash", 1, PIECE_DIGITS), 16, 10).cast("int"))
    strata = by or ["__all"]
    if not by:
        frame = frame.withColumn("__all", F.lit(0))
    sizes = frame.groupBy(*strata, "__piece").agg(F.count(F.lit(1)).alias("__count"))
    whole = Window.partitionBy(*strata)
    before = whole.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *strata,
        "__piece",
        F.coalesce(F.sum("__count").over(before), F.lit(0)).alias("__before"),
        F.sum("__count").over(whole).alias(size),
    )
    inside = Window.partitionBy(*strata, "__piece").orderBy("__hash", key)
    ranked = frame.withColumn("__inside", F.row_number().over(inside)).join(offsets, [*strata, "__piece"])
    return ranked.withColumn(rank, F.col("__inside") + F.col("__before")).select(*keys.columns, rank, size)


def digest(seed: Any, *parts: Any) -> Column:
    """MD5 of the seed and the given columns as text, joined by a bar; NULL is an empty text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(_column(p).cast("string"), F.lit("")) for p in parts]))


def uniform(seed: Any, *parts: Any) -> Column:
    """A number in (0, 1) from 52 bits of a seeded hash of the given columns."""
    bits = F.conv(F.substring(digest(seed, *parts), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def gaussian(seed: Any, *parts: Any) -> Column:
    """A standard normal number from a seeded hash (Box-Muller)."""
    first = uniform(seed, F.lit("radius"), *parts)
    second = uniform(seed, F.lit("angle"), *parts)
    return F.sqrt(-2.0 * F.log(first)) * F.cos(2.0 * math.pi * second)


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], by: str | Sequence[str] = (), chunk_rows: int | None = None
) -> DataFrame:
    """Quantiles with linear interpolation (type 7) from counts of distinct values.

    No group is collected: distinct values are ranked by a running count and only the two
    neighbors of each wanted position are kept.
    """
    by = _names(by)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    ranked = running(counts, value, by, chunk_rows, __upto=RunSum("__n"), __total=Total("__n"))
    start = F.col("__upto") - F.col("__n")
    picks, result = [], []
    for name, p in probs.items():
        spot = (F.col("__total") - 1) * F.lit(float(p))
        low = F.floor(spot)
        high = F.least(low + 1, F.col("__total") - 1)
        picks += [
            F.max(F.when((start <= low) & (low < F.col("__upto")), F.col(value))).alias(f"__lo_{name}"),
            F.max(F.when((start <= high) & (high < F.col("__upto")), F.col(value))).alias(f"__hi_{name}"),
            F.max(spot - low).alias(f"__fr_{name}"),
        ]
        lo, hi, part = F.col(f"__lo_{name}"), F.col(f"__hi_{name}"), F.col(f"__fr_{name}")
        result.append((lo + (hi - lo) * part).alias(name))
    return ranked.groupBy(*by).agg(*picks).select(*by, *result)
