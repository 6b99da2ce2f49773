"""Exact, reproducible splits, samples and class balance by seeded hash ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorflow.functions.metadata import SPLIT_SHARES
from donorflow.operators.neighbors import nearest_neighbors
from donorflow.operators.ordered import exact_quantiles, hash_ranks, uniform
from donorflow.operators.series import trim_after_last_deferral



def split_three_way(
    df: DataFrame, key: str, seed: int = 42, shares: Sequence[tuple[str, float]] = SPLIT_SHARES, name: str = "label"
) -> DataFrame:
    """Label subjects with exact class sizes; the last class takes what rounding leaves."""
    ranked = hash_ranks(df.select(key).distinct(), key, seed)
    label, upto = None, F.lit(0)
    for part, share in shares[:-1]:
        upto = upto + F.floor(F.lit(share) * F.col("size"))
        test = F.col("rank") <= upto
        label = F.when(test, part) if label is None else label.when(test, part)
    return df.join(ranked.select(key, label.otherwise(shares[-1][0]).alias(name)), key)


def split_mode(df: DataFrame, mode: str, label: str = "label") -> DataFrame:
    """initial: train against validate. final: train and validate against test."""
    if mode == "initial":
        split = F.when(F.col(label) == "train", "train").when(F.col(label) == "validate", "test")
    else:
        split = F.when(F.col(label).isin("train", "validate"), "train").when(F.col(label) == "test", "test")
    return df.withColumn("split", split).filter(F.col("split").isNotNull())


def length_strata(df: DataFrame, key: str) -> DataFrame:
    """Subjects with their series length and its quartile class."""
    lengths = df.groupBy(key).agg(F.count(F.lit(1)).alias("length"))
    cuts = exact_quantiles(lengths, "length", {"a": 0.25, "b": 0.5, "c": 0.75}).first()
    above = [(F.col("length") > cuts[n]).cast("int") for n in ("a", "b", "c")]
    return lengths.withColumn("stratum", above[0] + above[1] + above[2])


def split_two_way(df: DataFrame, key: str, p: float, seed: int) -> DataFrame:
    """Subject-level split, ceil(p n) of each series-length class in train."""
    ranked = hash_ranks(length_strata(df, key), key, seed, "stratum")
    split = F.when(F.col("rank") <= F.ceil(F.lit(p) * F.col("size")), "train").otherwise("test")
    return df.join(ranked.select(key, split.alias("split")), key)


def kfold_by_donor(df: DataFrame, key: str, k: int, seed: int, name: str = "fold") -> DataFrame:
    """Fold 0..k-1 per subject, balanced on series length."""
    ranked = hash_ranks(length_strata(df, key), key, seed, "stratum")
    fold = ((F.col("rank") + F.col("stratum")) % k).cast("int")
    return df.join(ranked.select(key, fold.alias(name)), key)


def sample_donors(
    donations: DataFrame, donors: DataFrame, amount: float, seed: int, key: str = "KEY_DONOR"
) -> tuple[DataFrame, DataFrame]:
    """A number (above 1) or a share of subjects; their donations follow."""
    if amount == 1.0:
        return donations, donors
    ranked = hash_ranks(donors.select(key).distinct(), key, seed)
    limit = F.lit(int(amount)) if amount > 1 else F.floor(F.lit(amount) * F.col("size"))
    chosen = ranked.filter(F.col("rank") <= limit).select(key)
    return donations.join(chosen, key, "left_semi"), donors.join(chosen, key, "left_semi")


def stratified_sample(
    df: DataFrame, by_sex: bool, size: float, seed: int, key: str = "donor", sex: str = "sex", label: str = "label",
    shares: Sequence[tuple[str, float]] = SPLIT_SHARES,
) -> DataFrame:
    """Sample subjects and keep the train / validate / test proportions.

    A size up to 1 is a share of every stratum. A larger one is a number of subjects (per
    sex when stratified) whose per-label targets add up to it exactly, as far as a stratum
    has that many.
    """
    strata = [label, sex] if by_sex else [label]
    subjects = df.select(key, label, *([sex] if by_sex else [])).distinct()
    ranked = hash_ranks(subjects, key, seed, strata)
    if size <= 1.0:
        limit: Column = F.floor(F.lit(float(size)) * F.col("size"))
    else:
        targets = {name: int(share * size) for name, share in shares[:-1]}
        targets[shares[-1][0]] = int(size) - sum(targets.values())
        limit = None
        for name, n in targets.items():
            test = F.col(label) == name
            limit = F.when(test, n) if limit is None else limit.when(test, n)
    chosen = ranked.filter(F.col("rank") <= limit).select(key)
    return df.join(chosen, key, "left_semi")


def balance_classes(df: DataFrame, target: float, seed: int, key: str = "donor", flag: str = "Hb_deferral") -> DataFrame:
    """Drop subjects of one class until the target share of ever-deferred ones is met."""
    ever = df.groupBy(key).agg(F.max(F.coalesce(F.col(flag), F.lit(False)).cast("int")).alias("ever"))
    if target == 0.0:
        return df.join(ever.filter("ever = 0").select(key), key, "left_semi")
    sizes = ever.agg(
        F.coalesce(F.sum("ever"), F.lit(0)).alias("some"), F.coalesce(F.sum(1 - F.col("ever")), F.lit(0)).alias("none")
    ).first()
    ratio = (1 - target) / target
    limits = {1: sizes["some"], 0: int(sizes["some"] * ratio)}
    if limits[0] > sizes["none"]:
        limits = {1: int(sizes["none"] / ratio), 0: sizes["none"]}
    ranked = hash_ranks(ever, key, seed, "ever")
    limit = F.when(F.col("ever") == 1, limits[1]).otherwise(limits[0])
    return df.join(ranked.filter(F.col("rank") <= limit).select(key), key, "left_semi")


def enrich(
    df: DataFrame, target: float, seed: int, key: str = "donor", flag: str = "Hb_deferral",
    order: Sequence[str] = ("date", "don_id"),
) -> DataFrame:
    """Trim series after the last deferral, then balance."""
    return balance_classes(trim_after_last_deferral(df, key, flag, order), target, seed, key, flag)


def upsample_minority(df: DataFrame, label: str, seed: int, key: str) -> DataFrame:
    """Repeat minority rows until both classes are equal in size.

    Every minority row appears floor(N/P) times; a hash-ranked remainder once more.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    if len(counts) < 2:
        return df
    small = min(counts, key=lambda c: (counts[c], str(c)))
    times, rest = divmod(max(counts.values()), counts[small])
    minor = hash_ranks(df.filter(F.col(label) == F.lit(small)), key, seed)
    copies = F.lit(times) + F.when(F.col("rank") <= rest, 1).otherwise(0)
    repeated = minor.withColumn("__copy", F.explode(F.sequence(F.lit(1), copies))).select(*df.columns)
    return df.filter(F.col(label) != F.lit(small)).unionByName(repeated)


def smote(
    df: DataFrame, features: Sequence[str], label: str, key: str, k: int = 5, seed: int = 1, near: DataFrame | None = None
) -> DataFrame:
    """Synthetic minority rows until both classes are equal in size.

    Returns label, features and a flag. Each minority row with all features gives floor or ceil
    of the wanted copies; a copy lies at a random place between the row and one of its k nearest
    ones, which are exact (``near``: those of ``nearest_neighbors``, if they are known already).
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    small = min(counts, key=lambda c: (counts[c], str(c)))
    if near is None:
        near = nearest_neighbors(df.filter(F.col(label) == F.lit(small)), features, key, k)
    ready = near.filter(F.size("near") > 0)
    base = ready.count()
    real = df.select(label, *[F.col(f).cast("double").alias(f) for f in features], F.lit(False).alias("synthetic"))
    if not base:
        return real
    times, rest = divmod(max(counts.values()) - counts[small], base)
    copies = F.lit(times) + F.when(F.col("rank") <= rest, 1).otherwise(0)
    made = hash_ranks(ready, "key", seed).filter(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    which = F.floor(uniform(seed, F.lit("which"), "key", "copy") * F.size("near")).cast("int")
    made = made.withColumns({"y": F.get("near", which)["y"], "u": uniform(seed, F.lit("share"), "key", "copy")})
    mixed = [(F.col("x")[i] + F.col("u") * (F.col("y")[i] - F.col("x")[i])).alias(f) for i, f in enumerate(features)]
    return real.unionByName(made.select(F.lit(small).alias(label), *mixed, F.lit(True).alias("synthetic")))


def class_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Case weight 1 - share of the row's class.

    Class sizes are counted before the shuffle and joined; Spark broadcasts them when they are small.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    total = df.agg(F.count(F.lit(1)).alias("__all")).scalar()
    counts = counts.select(F.col(label).alias("__label"), (1 - F.col("__n") / total).alias(name))
    return df.join(counts, F.col(label).eqNullSafe(F.col("__label"))).select(*df.columns, name)


def permute_rows(df: DataFrame, seed: int, keys: Sequence[str]) -> DataFrame:
    """Rows in the order of a seeded hash; for sinks."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys)
