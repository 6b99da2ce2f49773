"""Shapley attributions and permutation importance."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from donorflow.functions.expr import prettify_variables
from donorflow.operators.joins import attach_metadata
from donorflow.operators.numbered import looked_up, numbered, spread
from donorflow.operators.ordered import hash_ranks
from donorflow.operators.shape import melt
from donorflow.session import reliable_checkpoint

Score = Callable[[DataFrame], DataFrame]
SIMULATIONS = 50_000  # of all rows together, from which their scores are dealt over more tasks


def shap_linear_exact(df: DataFrame, coefficients: dict[str, float], key: str = "id") -> DataFrame:
    """coef * (x - mean x) per variable, in long form."""
    names = list(coefficients)
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in names])
    phi = [(F.lit(w) * (F.col(c).cast("double") - means.select(c).scalar())).alias(c) for c, w in coefficients.items()]
    return df.select(key, *phi).unpivot([key], names, "Variable", "attribution")


def sample_rows(df: DataFrame, n: int | None, seed: int, key: str) -> DataFrame:
    """All rows with a number 1.. by hash rank, or the first ``n`` of them."""
    ranked = hash_ranks(df, key, seed).drop("size").withColumnRenamed("rank", "row")
    return ranked if n is None else ranked.filter(F.col("row") <= n)


def _steps(sims: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """(key, __entered, __next, features): a simulation's row before the first and after each variable has entered.

    Columns of ``sims``: key, own values, those of the other row, and numbers that order the variables.
    ``__entered`` and ``__next`` are the places of variables among ``features``, -1 for none.
    """
    size = len(features)
    places = [StructField(c, IntegerType()) for c in ("__entered", "__next")]
    schema = StructType([sims.schema[key], *places, *[StructField(f, DoubleType()) for f in features]])

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(1 + i) for i in range(2 * size)]
            values = [c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns]
            missing = [c.is_null().to_numpy(zero_copy_only=False) for c in columns]
            turns = np.column_stack([batch.column(1 + 2 * size + i).to_numpy(zero_copy_only=False) for i in range(size)])
            order = np.argsort(turns, axis=1, kind="stable").astype(np.int32)
            none = np.full((len(order), 1), -1, np.int32)
            order = np.hstack([none, order, none])
            own = np.zeros((size, len(order)), bool)
            for step in range(size + 1):
                if step:
                    own[order[:, step], np.arange(len(order))] = True
                row = [pa.array(np.where(own[i], values[i], values[size + i]), mask=np.where(own[i], missing[i], missing[size + i])) for i in range(size)]
                arrays = [batch.column(0), pa.array(order[:, step]), pa.array(order[:, step + 1]), *row]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return sims.mapInArrow(filled, schema)


def shap_sampling(
    score: Score, df: DataFrame, features: Sequence[str], key: str = "id", n: int | None = None, nsim: int = 100, seed: int = 1
) -> DataFrame:
    """Monte-Carlo Shapley values (key, Variable, attribution) of all rows, or of ``n`` of them.

    For each row and simulation, variables enter in a random order; a random other row fills those
    that haven't entered. The row goes through the model once before the first and once after each,
    and a variable's attribution is the mean change of the score as it enters.
    """
    rows = sample_rows(df.select(key, *[F.col(f).cast("double").alias(f) for f in features]), n, seed, key)
    rows = reliable_checkpoint(rows)
    found = rows.count()
    turns = {f"__turn{i}": (["turn"], [f]) for i, f in enumerate(features)}
    dealt = spread(rows.select(key, *features), found * nsim, SIMULATIONS)
    sims = numbered(dealt, key, nsim, "sim", seed, {"__other": (["other"], []), **turns})
    other = (F.floor(F.col("__other") * found) + 1).cast("long")
    others = {f"__w{i}": f for i, f in enumerate(features)}
    reference = rows.select("row", *[F.col(f).alias(w) for w, f in others.items()])
    sims = looked_up(sims.withColumn("__other", other), "__other", reference, "row", list(others), found * len(others))
    scored = score(_steps(sims.select(key, *features, *others, *turns), key, features))
    changes = []
    for i, f in enumerate(features):
        change = F.when(F.col("__entered") == i, F.col("score")).when(F.col("__next") == i, -F.col("score"))
        changes.append((F.sum(change) / nsim).alias(f))
    return scored.groupBy(key).agg(*changes).unpivot([key], list(features), "Variable", "attribution")


def shap_long(phi: DataFrame, df: DataFrame, features: Sequence[str], key: str = "id", seed: int | None = None) -> DataFrame:
    """(Variable, attribution, z-scored value) without ids, rows permuted by a hash."""
    values = melt(df, features, [key]).withColumnRenamed("name", "Variable")
    joined = phi.join(values, [key, "Variable"])
    stats = joined.groupBy("Variable").agg(F.avg("value").alias("__m"), F.stddev_samp("value").alias("__s"))
    z = F.try_divide(F.col("value") - F.col("__m"), F.col("__s"))
    # at most one row per listed feature
    out = joined.join(F.broadcast(stats), "Variable").select(key, "Variable", "attribution", z.alias("value"))
    if seed is not None:
        out = out.orderBy(F.xxhash64(F.lit(seed), key, "Variable"))
    return out.drop(key)


def shap_summary(shap: DataFrame, descriptions: DataFrame, dummy_coded: bool = False) -> DataFrame:
    """Mean absolute attribution per variable, with display names."""
    mean = shap.groupBy("Variable").agg(F.avg(F.abs("attribution")).alias("attribution"))
    named = attach_metadata(mean, descriptions)
    return named.select("Variable", prettify_variables("Variable", "Pretty", dummy_coded).alias("Pretty"), "attribution")


def shap_points(shap: DataFrame, limit: float = 3.0) -> DataFrame:
    """Points to show: variables that are zero everywhere are left out, far values are NULL."""
    used = shap.groupBy("Variable").agg(F.max((F.col("attribution") != 0).cast("int")).alias("__used"))
    kept = shap.join(used.filter("__used = 1").select("Variable"), "Variable", "left_semi")
    return kept.withColumn("value", F.when(F.abs("value") <= limit, F.col("value")))


def permutation_importance(
    score: Score, df: DataFrame, features: Sequence[str], label: str, key: str, seed: int = 1
) -> DataFrame:
    """Growth of the squared error when one column is shuffled, per variable.

    Rows are put in a hash order and each variable is taken from the row a fixed number of
    places further, a different number per variable. That is a permutation without fixed
    points, and one equi-join on the place serves all variables.
    """
    rows = df.select(key, F.col(label).cast("double").alias("__y"), *[F.col(f).cast("double").alias(f) for f in features])
    rows = reliable_checkpoint(hash_ranks(rows, key, seed))
    names = F.explode(F.array(*[F.lit(f) for f in features])).alias("Variable")
    wide = rows.select("*", names)
    step = 1 + F.pmod(F.xxhash64(F.lit(seed), "Variable"), F.greatest(F.col("size") - 1, F.lit(1)))
    wide = wide.withColumn("__at", F.pmod(F.col("rank") + step - 1, F.col("size")) + 1)
    source = rows.select(F.col("rank").alias("__at"), F.struct(*features).alias("__w"))
    swapped = [F.when(F.col("Variable") == f, F.col(f"__w.{f}")).otherwise(F.col(f)).alias(f) for f in features]
    shuffled = wide.join(source, "__at").select("Variable", "__y", *swapped)
    both = shuffled.unionByName(rows.select(F.lit("").alias("Variable"), "__y", *features))
    error = F.pow(F.col("score") - F.col("__y"), 2)
    losses = [F.avg(F.when(F.col("Variable") == f, error)).alias(f) for f in features]
    one = score(both).agg(F.avg(F.when(F.col("Variable") == "", error)).alias("__base"), *losses)
    long = one.unpivot(["__base"], list(features), "Variable", "loss")
    return long.select("Variable", (F.col("loss") - F.col("__base")).alias("Importance"))
