"""Set operations, reshaping and grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def union_results(tables: Mapping[str, DataFrame], id_column: str = "Id") -> DataFrame:
    """Stack tables that may differ in columns, tagged with their key."""
    tagged = [df.withColumn(id_column, F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def multi_source_bind(tables: Mapping[str, DataFrame], id_column: str = ".id") -> DataFrame:
    """Stack runs of the same shape with a run column."""
    tagged = [df.withColumn(id_column, F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)


def id_intersection(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def row_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` that ``b`` lacks, counting duplicates."""
    return a.exceptAll(b.select(*a.columns))


def distinct_donors(df: DataFrame, key: str = "donor") -> DataFrame:
    return df.select(key).distinct()


def donor_count(df: DataFrame, key: str = "donor", name: str = "donors") -> DataFrame:
    """Number of different keys; the distinct step combines on the map side first."""
    return distinct_donors(df.filter(F.col(key).isNotNull()), key).agg(F.count(F.lit(1)).alias(name))


def melt(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Columns to (name, value) rows with double values; logical becomes 0/1."""
    cast = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    return cast.unpivot(list(keep), list(columns), "name", "value")


def melt_numeric(df: DataFrame, columns: Sequence[str], descriptions: Sequence[tuple] = ()) -> DataFrame:
    """Long form with display names; NULL lags are left out, other NULLs stay."""
    shown = {d[0]: d[1] for d in descriptions if d[0] in columns}
    names = [shown.get(c, c) for c in columns]
    frame = df.select(*[F.col(c).cast("double").alias(n) for c, n in zip(columns, names)])
    long = frame.unpivot([], names, "name", "value")
    lag = F.col("name").rlike("^Previous Hb [2-5]") | F.col("name").rlike("^Days to previous Hb( [2-5])?")
    return long.filter(~(lag & F.col("value").isNull()))


def melt_by_group(tables: Mapping[str, DataFrame], columns: Sequence[str], tag: str = "Sex") -> DataFrame:
    """Several sources in long form, tagged by source."""
    return melt(multi_source_bind(tables, tag), columns, [tag])


def pivot_results(
    long: DataFrame, keys: Sequence[str], names: Sequence[str], values: Sequence[str], value: str = "value"
) -> DataFrame:
    """(key, name..., value) to wide with a stated list of columns, e.g. ``E6_low``."""
    label = F.concat_ws("_", *[F.col(n) for n in names])
    tagged = long.withColumn("__name", label)
    cells = [F.max(F.when(F.col("__name") == v, F.col(value))).alias(v) for v in values]
    return tagged.groupBy(*keys).agg(*cells)


def axis(spark: SparkSession, name: str, start: float, stop: float, steps: int) -> DataFrame:
    """``steps`` equally spaced values from start to stop."""
    width = (stop - start) / (steps - 1) if steps > 1 else 0.0
    return spark.range(steps).select((F.lit(float(start)) + F.col("id") * float(width)).alias(name))


def grid_expand(df: DataFrame, axes: Mapping[str, Sequence]) -> DataFrame:
    """Every row once per combination of the axis values (one exploded array per axis)."""
    for name, values in axes.items():
        df = df.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return df
