"""Joins between events, subjects and descriptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorflow.operators.ordered import HotKeys, RunMax, RunSum, Whole, attach, hot_keys


def common_donor_reduce(donations: DataFrame, donors: DataFrame, key: str = "donor") -> tuple[DataFrame, DataFrame]:
    """Both tables reduced to the keys they share."""
    facts = donations.join(donors.select(key), key, "left_semi")
    return facts, donors.join(donations.select(key), key, "left_semi")


def duplicate_keys(dim: DataFrame, key: str) -> DataFrame:
    return dim.groupBy(key).count().filter("count > 1").select(key)


def donation_donor_join(donations: DataFrame, donors: DataFrame, key: str = "donor", check: bool = True) -> DataFrame:
    """Inner join that must keep the number of events, so the dimension key is unique."""
    if check and duplicate_keys(donors, key).limit(1).count():
        raise ValueError(f"duplicate {key} in the donor table")
    return donations.join(donors, key)


def semi_join_sample(donations: DataFrame, sampled: DataFrame, key: str = "donor") -> DataFrame:
    return donations.join(sampled.select(key), key, "left_semi")


def in_list_filter(df: DataFrame, ids: DataFrame, key: str = "donor") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def anti_join_last_event(dim: DataFrame, facts: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows of ``dim`` without a partner in ``facts`` on the (dim, fact) column pairs."""
    right = facts.select(*[F.col(f).alias(d) for d, f in keys]).distinct()
    return dim.join(right, [d for d, _ in keys], "left_anti")


def donor_specific_extract(donors: DataFrame, features: DataFrame, first_only: bool) -> DataFrame:
    """Ferritin columns of subjects that survived preprocessing.

    In the full mode all three columns must be known, and the last ferritin must not come
    from the last event, which is the one to predict.
    """
    if first_only:
        dim = donors.select("donor", "FERRITIN_FIRST").filter(F.col("FERRITIN_FIRST").isNotNull())
    else:
        names = ["FERRITIN_FIRST", "FERRITIN_LAST", "FERRITIN_LAST_DATE"]
        dim = donors.select("donor", *names).dropna(subset=names)
        last = features.groupBy("donor").agg(F.max("dateonly").alias("dateonly"))
        dim = anti_join_last_event(dim, last, [("donor", "donor"), ("FERRITIN_LAST_DATE", "dateonly")])
    return dim.join(features.select("donor"), "donor", "left_semi")


def attach_donor_variables(df: DataFrame, dim: DataFrame, key: str = "donor") -> DataFrame:
    """Inner join of subject-level columns; Spark broadcasts them when they are small."""
    return df.join(dim, key)


def attach_metadata(df: DataFrame, descriptions: DataFrame, on: str = "Variable") -> DataFrame:
    """Left join of variable descriptions; Spark broadcasts them when they are small."""
    return df.join(descriptions, on, "left")


def composite_key_join(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b, list(keys))


def full_outer_append(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full join on all shared columns: rows of both, merged where they agree."""
    shared = [c for c in a.columns if c in b.columns]
    right = b.withColumnsRenamed({c: f"__{c}" for c in shared})
    match = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in shared]
    condition = match[0]
    for m in match[1:]:
        condition = condition & m
    joined = a.join(right, condition, "full_outer")
    merged = [F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) for c in shared]
    rest = [c for c in a.columns if c not in shared] + [c for c in b.columns if c not in shared]
    return joined.select(*merged, *rest)


def next_event_after(facts: DataFrame, ref: DataFrame, donor: str = "donor", day: str = "dateonly", at: str = "ref") -> DataFrame:
    """First event strictly after each subject's reference date, ties kept."""
    later = facts.join(ref.select(donor, at), donor).filter(F.col(day) > F.col(at))
    nearest = later.groupBy(donor).agg(F.min(day).alias(day))
    return facts.join(nearest, [donor, day], "left_semi")


def asof_previous_full_blood(
    df: DataFrame, condition: Column, donor: str = "donor", day: str = "dateonly", name: str = "days"
) -> DataFrame:
    """Days since the latest matching event strictly before the day of the row.

    Days are collapsed first, so events of one day do not see each other.
    """
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    days = df.groupBy(donor, day).agg(F.max(F.when(condition, number)).alias("__hit"))
    hot = hot_keys(df, donor)
    seen = attach(days, donor, [day], hot, __previous=RunMax("__hit", current=False))
    seen = seen.withColumn(name, number - F.col("__previous")).select(donor, day, name)
    return df.join(seen, [donor, day])


def calendar_range_count(
    df: DataFrame, flag: str, donor: str = "donor", day: str = "dateonly", months: int = 24, name: str = "n"
) -> DataFrame:
    """Flagged events in (day - months, day), both ends open, by calendar months.

    Three frames of one window: everything from the bound on, less the day itself and the
    bound itself; one exchange and one sort. Hot subjects go by ``_between_borders``.
    """
    hit = F.sum(F.when(F.col(flag), 1).otherwise(0))
    back = f"INTERVAL {months} MONTH PRECEDING"

    def frame(low: str, high: str) -> Column:
        return F.expr(f"sum(CASE WHEN `{flag}` THEN 1 ELSE 0 END) OVER (PARTITION BY `{donor}` ORDER BY `{day}` RANGE BETWEEN {low} AND {high})")

    parts = hot_keys(df, donor).split(df, donor)
    number = F.coalesce(frame(back, "CURRENT ROW"), F.lit(0)) - frame("CURRENT ROW", "CURRENT ROW") - F.coalesce(frame(back, back), F.lit(0))
    out = parts[0][0].withColumn(name, F.when(F.col(day).isNotNull(), number).cast("long")).filter(F.col(donor).isNotNull() & F.col(day).isNotNull())
    for big, own in parts[1:]:
        out = out.unionByName(_between_borders(big, own, hit, donor, day, months, name))
    return out


def _between_borders(big: DataFrame, hot: HotKeys, hits: Column, donor: str, day: str, months: int, name: str) -> DataFrame:
    """The same for subjects that are cut: each day asks for the flagged total up to its own bound with one row more."""
    days = big.groupBy(donor, day).agg(hits.alias("__n"))
    bound = F.add_months(F.col(day), -months)
    real = days.select(donor, F.col(day).alias("__at"), F.col(day).alias("__x"), F.lit(0).alias("__kind"), "__n")
    ask = days.select(donor, F.col(day).alias("__at"), bound.alias("__x"), F.lit(1).alias("__kind"), (F.col("__n") * 0).alias("__n"))
    run = attach(real.unionByName(ask), donor, ["__x", "__kind", "__at"], hot, __c=RunSum("__n"))
    before = F.max(F.when(F.col("__kind") == 0, F.col("__c") - F.col("__n")))
    upto = F.max(F.when(F.col("__kind") == 1, F.col("__c")))
    counts = run.groupBy(donor, F.col("__at").alias(day)).agg((before - upto).cast("long").alias(name))
    return big.join(counts, [donor, day])


def last_ferritin_before_last(df: DataFrame, ref: str, donor: str = "donor", day: str = "dateonly") -> DataFrame:
    """Rows whose reference date lies before the subject's last event."""
    return attach(df, donor, __last=Whole(F.max(day))).filter(F.col(ref) < F.col("__last")).drop("__last")


def frame_diff(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """TRUE where the two tables differ, NULL equal to NULL, for every shared column."""
    shared = [c for c in a.columns if c in b.columns and c != by]
    right = b.select(by, *[F.col(c).alias(f"__{c}") for c in shared])
    joined = a.join(right, by)
    return joined.select(by, *[(~F.col(c).eqNullSafe(F.col(f"__{c}"))).alias(c) for c in shared])



def frame_merge_common(a: DataFrame, b: DataFrame, by: str, keys: DataFrame | None = None) -> DataFrame:
    """Join on ``by``; a shared column appears once when equal everywhere, else as .x and .y.

    Which columns differ is one aggregate over the join; one row comes to the driver.
    """
    if keys is not None:
        a = a.join(keys.select(by), by, "left_semi")
    shared = [c for c in a.columns if c in b.columns and c != by]
    left = a.select(by, *[F.col(c).alias(f"{c}__x") for c in shared])
    right = b.select(by, *[F.col(c).alias(f"{c}__y") for c in shared])
    joined = left.join(right, by)
    tests = [F.max(~F.col(f"{c}__x").eqNullSafe(F.col(f"{c}__y"))).alias(c) for c in shared]
    differs = joined.agg(*tests).first() if shared else {}
    out = [F.col(by)]
    for c in shared:
        if differs[c]:
            out += [F.col(f"{c}__x").alias(f"{c}.x"), F.col(f"{c}__y").alias(f"{c}.y")]
        else:
            out.append(F.col(f"{c}__x").alias(c))
    return joined.select(*out)


def result_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    left = before.select(*keys, F.col(value).alias("value_x"))
    right = after.select(*keys, F.col(value).alias("value_y"))
    return left.join(right, list(keys)).withColumn("diff", F.abs(F.col("value_x") - F.col("value_y")))
