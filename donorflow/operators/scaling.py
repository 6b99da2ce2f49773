"""Standardization by two standard deviations, model designs and thin QR."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorflow.operators.ordered import Lag, Whole, attach
from donorflow.operators.series import first_measurements

TWO = 2.0  # continuous inputs are divided by two standard deviations


@dataclass(frozen=True)
class Scale:
    """Means and standard deviations of columns, from one aggregate."""

    means: dict[str, float]
    sds: dict[str, float]
    factor: float = TWO


def column_scale(df: DataFrame, columns: Sequence[str], factor: float = TWO) -> Scale:
    aggs = [F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in columns]
    aggs += [F.stddev_samp(F.col(c).cast("double")).alias(f"s_{c}") for c in columns]
    one = df.agg(*aggs).first()
    means = {c: one[f"m_{c}"] for c in columns}
    return Scale(means, {c: one[f"s_{c}"] or 0.0 for c in columns}, factor)


def scaled(value: str | Column, mean: float, sd: float, factor: float = TWO) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return (value - mean) / (factor * sd) if sd and sd > 0 else value - mean


def unscaled(value: str | Column, mean: float, sd: float, factor: float = TWO) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return value * (factor * sd) + mean if sd and sd > 0 else value + mean


def standardize_with_train(df: DataFrame, scale: Scale, columns: Sequence[str] | None = None) -> DataFrame:
    names = columns or list(scale.means)
    return df.withColumns({c: scaled(F.col(c).cast("double"), scale.means[c], scale.sds[c], scale.factor) for c in names})


def standardize_2sd(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, Scale]:
    scale = column_scale(df, columns)
    return standardize_with_train(df, scale), scale


def denormalize(df: DataFrame, scale: Scale, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: unscaled(c, scale.means[c], scale.sds[c], scale.factor) for c in columns})


@dataclass
class Design:
    """Rows with ``y``, predictors and ``split``; scales; optional donor-level tables."""

    rows: DataFrame
    variables: list[str]
    scale: Scale
    constants: DataFrame | None = None
    first: DataFrame | None = None


def numeric_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns that are standardized: numbers, but not logical values."""
    types = dict(df.dtypes)
    return [c for c in columns if types[c] not in ("boolean", "string", "date", "timestamp")]


def _split_last(df: DataFrame, donor: str, order: Sequence[str], holdout: bool, minimum: int, tolag: Sequence[str]) -> DataFrame:
    """Series of at least ``minimum`` rows with lagged columns and the train / test split."""
    place = F.struct(*order)
    specs = {f"__lag_{c}": Lag(c) for c in tolag}
    seen = attach(
        df, donor, order, __n=Whole(F.count(F.lit(1))), __end=Whole(F.max(place)), __start=Whole(F.min(place)), **specs
    )
    seen = seen.filter(F.col("__n") >= minimum)
    split = F.when((place == F.col("__end")) & F.lit(holdout), "test").otherwise("train")
    out = seen.withColumns({"split": split, "is_first": place == F.col("__start"), **{c: F.col(f"__lag_{c}") for c in tolag}})
    return out.drop("__n", "__end", "__start", *specs)


def _constants(df: DataFrame, donor: str, columns: Sequence[str]) -> DataFrame | None:
    if not columns:
        return None
    table = df.select(donor, *columns).distinct()
    numeric = numeric_columns(table, columns)
    return standardize_with_train(table, column_scale(table, numeric)) if numeric else table


def _scaled_rows(df: DataFrame, y: str, variables: Sequence[str], y_factor: float, donor: str, order: Sequence[str]) -> tuple[DataFrame, Scale]:
    numeric = numeric_columns(df, [y, *[v for v in variables if v != y]])
    scale = column_scale(df.filter(F.col("split") == "train"), numeric)
    target = scaled(F.col(y).cast("double"), scale.means[y], scale.sds[y], y_factor)
    predictors = [
        (scaled(F.col(v).cast("double"), scale.means[v], scale.sds[v]) if v in numeric else F.col(v).cast("double")).alias(v)
        for v in variables
    ]
    return df.select(donor, *order, "split", "is_first", F.col(y).alias("original_value"), target.alias("y"), *predictors), scale


def lmm_design(
    df: DataFrame, variables: Sequence[str], donor_variables: Sequence[str] = (), holdout: bool = True,
    tolag: Sequence[str] = (), y: str = "Hb", donor: str = "donor", order: Sequence[str] = ("dateonly", "don_id"),
) -> Design:
    """Rows without first events; everything scaled by the training rows."""
    later = df.filter(~F.col("first_event"))
    rows = _split_last(later, donor, order, holdout, 1 + int(holdout), tolag)
    constants = _constants(rows, donor, donor_variables)
    out, scale = _scaled_rows(rows, y, variables, TWO, donor, order)
    return Design(out, list(variables), scale, constants)


# Predictors of the first event, and predictors that are 0 when unknown.
FIRST_EVENT_VARIABLES = ["age", "year", "warm_season", "hour"]
ZERO_WHEN_UNKNOWN = ["days_to_previous_fb", "previous_Hb_def", "previous_Hb"]


def dlmm_design(
    df: DataFrame, variables: Sequence[str], donor_variables: Sequence[str] = (), holdout: bool = True,
    tolag: Sequence[str] = (), y: str = "Hb", donor: str = "donor", order: Sequence[str] = ("dateonly", "don_id"),
    z_variables: Sequence[str] = tuple(FIRST_EVENT_VARIABLES),
) -> Design:
    """Rows with first events, which get their own predictors Z; unknown lags become 0."""
    rows = _split_last(df, donor, order, holdout, 2 + int(holdout), tolag)
    constants = _constants(rows, donor, donor_variables)
    names = list(dict.fromkeys([*variables, *z_variables]))
    out, scale = _scaled_rows(rows, y, names, TWO, donor, order)
    zero = [v for v in names if v in ZERO_WHEN_UNKNOWN or v in tolag]
    out = out.fillna(0.0, zero) if zero else out
    train = out.filter(F.col("split") == "train")
    first = first_measurements(train, [*z_variables, "y"], donor, order)
    return Design(out, list(variables), scale, constants, first)


def delta_design(
    df: DataFrame, variables: Sequence[str], tolag: Sequence[str] = (), donor_variables: Sequence[str] = (),
    y: str = "Hb", previous: str = "previous_Hb", donor: str = "donor", order: Sequence[str] = ("dateonly", "don_id"),
) -> Design:
    """The change model: lagged Hb kept apart as ``Hb_lag``, Hb scaled by one sd."""
    if tolag:
        rows = _split_last(df, donor, order, True, 3, tolag).dropna(subset=[*tolag, *variables, previous, y])
        rows = _split_last(rows.drop("split", "is_first"), donor, order, True, 1, ())
    else:
        rows = _split_last(df, donor, order, True, 2, ())
    constants = _constants(rows, donor, donor_variables)
    out, scale = _scaled_rows(rows, y, [*variables, previous], 1.0, donor, order)
    return Design(out.withColumnRenamed(previous, "Hb_lag"), list(variables), scale, constants)


def legacy_design(
    df: DataFrame, variables: Sequence[str], hlen: int | None = None, y: str = "Hb", donor: str = "donor",
    order: Sequence[str] = ("dateonly", "don_id"), holdout: str = "last", fraction: float = 0.8, seed: int = 1,
    unscaled_variables: Sequence[str] = ("previous_Hb_def", "warm_season"),
) -> Design:
    """The older designs: log interval, types K, * and T, scaled over all rows.

    An interval of zero days has no logarithm; such rows count as unknown and go.

    ``holdout`` is ``last`` (last event of each subject) or ``random`` (subjects).
    """
    from donorflow.operators.sampling import split_two_way

    logged = df.withColumn("days_to_previous_fb", F.log("days_to_previous_fb"))
    needed = [c for c in ("Hb_first", "days_to_previous_fb", "Hb", "previous_Hb", "previous_Hb_def") if c in df.columns]
    rows = logged.filter(~F.col("first_event") & F.col("donat_phleb").isin("K", "*", "T")).dropna(subset=needed)
    if hlen is not None:
        length = F.col("__n") <= -hlen if hlen < 0 else F.col("__n") >= hlen
        rows = attach(rows, donor, __n=Whole(F.count(F.lit(1)))).filter(length).drop("__n")
    if holdout == "last":
        rows = _split_last(rows, donor, order, True, 2, ())
    else:
        rows = _split_last(rows, donor, order, False, 1, ()).drop("split")
        rows = split_two_way(rows, donor, fraction, seed)
    numeric = [v for v in numeric_columns(rows, [y, *variables]) if v not in unscaled_variables]
    scale = column_scale(rows, numeric)
    predictors = [
        (scaled(F.col(v).cast("double"), scale.means[v], scale.sds[v]) if v in numeric else F.col(v).cast("double")).alias(v)
        for v in variables
    ]
    target = scaled(F.col(y).cast("double"), scale.means[y], scale.sds[y])
    out = rows.select(donor, *order, "split", "is_first", F.col(y).alias("original_value"), target.alias("y"), *predictors)
    return Design(out, list(variables), scale)


def gram(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, int]:
    """X'X and the number of rows: one aggregate of K(K+1)/2 sums."""
    names = list(columns)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    aggs = [F.sum(F.col(names[i]).cast("double") * F.col(names[j]).cast("double")).alias(f"g{i}_{j}") for i, j in pairs]
    one = df.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
    out = np.zeros((len(names), len(names)))
    for i, j in pairs:
        out[i, j] = out[j, i] = one[f"g{i}_{j}"]
    return out, one["n"]


def thin_qr(df: DataFrame, columns: Sequence[str], prefix: str = "q_") -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Scaled thin QR: X = Q* R*, Q* with variance near one, and the inverse of R*.

    R comes from the Cholesky factor of X'X (K x K on the driver); Q* is column maths.
    """
    g, n = gram(df, columns)
    r = np.linalg.cholesky(g).T / np.sqrt(n - 1)
    inverse = np.linalg.inv(r)
    q = {
        f"{prefix}{c}": sum((F.col(columns[i]) * float(inverse[i, j]) for i in range(j + 1)), F.lit(0.0))
        for j, c in enumerate(columns)
    }
    return df.withColumns(q), r, inverse
