"""Checks of units, NULLs and columns, each in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorflow.functions.metadata import UNIT_RANGES
from donorflow.operators.ordered import exact_quantiles
from donorflow.operators.shape import melt


def unit_sanity(df: DataFrame, unit: str, value: str = "Hb") -> DataFrame:
    """Mean of the column and whether it is plausible for the unit."""
    if unit not in UNIT_RANGES:
        raise ValueError(f"unknown hemoglobin unit: {unit}")
    low, high = UNIT_RANGES[unit]
    mean = df.agg(F.avg(value).alias("mean"))
    return mean.withColumn("sane", (F.col("mean") > low) & (F.col("mean") < high))


def na_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULLs per column: one aggregate over the table, then transposed."""
    names = list(columns or df.columns)
    one = df.agg(*[F.coalesce(F.sum(F.col(n).isNull().cast("long")), F.lit(0)).alias(n) for n in names])
    return one.unpivot([], names, "name", "nulls")


def na_contract(df: DataFrame, allow: Sequence[str] = ()) -> DataFrame:
    """NULL counts of the columns that must not have any, with a verdict per column."""
    names = [n for n in df.columns if n not in set(allow)]
    return na_counts(df, names).withColumn("ok", F.col("nulls") == 0)


def require_no_nulls(df: DataFrame, allow: Sequence[str] = ()) -> DataFrame:
    """Raise when the contract is broken (one small result comes to the driver)."""
    bad = [r["name"] for r in na_contract(df, allow).filter(~F.col("ok")).collect()]
    if bad:
        raise ValueError(f"unexpected NULLs in: {', '.join(bad)}")
    return df


def column_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, NULLs, min, quartiles, mean and max of numeric columns, one row per column."""
    long = melt(df, columns)
    stats = long.groupBy("name").agg(
        F.count("value").alias("n"),
        F.sum(F.col("value").isNull().cast("long")).alias("nulls"),
        F.min("value").alias("min"),
        F.avg("value").alias("mean"),
        F.max("value").alias("max"),
    )
    quarts = exact_quantiles(long, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, "name")
    return stats.join(quarts, "name", "left")
