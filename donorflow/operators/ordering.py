"""Top rows, nearest rows, ordered levels and running sums in score order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorflow.operators.ordered import RunSum, running


def sort_by_time(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A full sort, for sinks only; features order rows inside windows."""
    return df.orderBy(*columns)


def _best(df: DataFrame, by: Sequence[str], place, biggest: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in by]
    pick = F.max_by if biggest else F.min_by
    one = df.groupBy(*by).agg(pick(F.struct(*rest), place).alias("__row"))
    return one.select(*by, *[F.col(f"__row.{c}").alias(c) for c in rest])


def last_row_by_desc_date(df: DataFrame, donor: str = "donor", order: Sequence[str] = ("date", "don_id")) -> DataFrame:
    """One row per subject, the newest: an aggregate, not a sorted window."""
    return _best(df, [donor], F.struct(*order), True)


def min_row(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each group with the smallest ``order``, later columns breaking ties."""
    return _best(df, list(by), F.struct(*order), False)


def nearest_value(df: DataFrame, value: str, target: float, tie: str) -> DataFrame:
    """The row whose value is nearest the target; the smallest ``tie`` among equals."""
    gap = F.abs(F.col(value) - F.lit(target))
    row = df.agg(F.min_by(F.struct(*df.columns), F.struct(gap, F.col(tie))).alias("__row"))
    return row.select("__row.*")


def ordered_levels(df: DataFrame, name: str, kind: str, value: str, first: str, second: str) -> DataFrame:
    """Names ordered by the mean of one kind of value, then of the other, descending."""
    wide = df.groupBy(name).agg(
        F.avg(F.when(F.col(kind) == first, F.col(value))).alias("first_mean"),
        F.avg(F.when(F.col(kind) == second, F.col(value))).alias("second_mean"),
    )
    down = {"__a": -F.coalesce("first_mean", F.lit(float("-inf"))), "__b": -F.coalesce("second_mean", F.lit(float("-inf")))}
    ranked = running(wide.withColumns(down), ["__a", "__b", name], level=RunSum(F.lit(1).cast("long")))
    return ranked.drop(*down)


def distributed_prefix_sum(
    df: DataFrame, order: Sequence[str], sums: Sequence[str], by: Sequence[str] = (), chunk_rows: int | None = None
) -> DataFrame:
    """Cumulative sums in global (or per-group) order, never in one task."""
    return running(df, order, by, chunk_rows, **{f"cum_{s}": RunSum(s) for s in sums})
