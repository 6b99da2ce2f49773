"""Exclusion rules, row by row or per subject."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorflow.functions.expr import column
from donorflow.functions.metadata import YEAR_SECONDS
from donorflow.operators.ordered import Lag, Whole, attach

DAY_SECONDS = 86_400


def keep(df: DataFrame, condition: Column) -> DataFrame:
    """Keep rows unless the condition is known to be false."""
    return df.filter(F.coalesce(condition, F.lit(True)))


# Conditions that row rules keep, so that filters and the audit share them.

def differs(date: Any, dob: Any) -> Column:
    return F.coalesce(column(date).cast("date") != column(dob).cast("date"), F.lit(True))


def known(*columns: Any) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & column(c).isNotNull()
    return out


def not_sentinel(date: Any, sentinel: str = "1939-01-01") -> Column:
    return F.coalesce(column(date).cast("date") != F.lit(sentinel).cast("date"), F.lit(True))


def of_age(age: Any, minimum: int = 18) -> Column:
    return F.coalesce(column(age) >= minimum, F.lit(True))


def drop_birth_equals_event(df: DataFrame, date: str = "date", dob: str = "dob") -> DataFrame:
    return df.filter(differs(date, dob))


def drop_null_dates(df: DataFrame, date: str = "date", dob: str = "dob") -> DataFrame:
    return df.filter(known(date, dob))


def drop_sentinel_date(df: DataFrame, date: str = "date", sentinel: str = "1939-01-01") -> DataFrame:
    return df.filter(not_sentinel(date, sentinel))


def drop_minors(df: DataFrame, age: str = "age", minimum: int = 18) -> DataFrame:
    return df.filter(of_age(age, minimum))


def drop_null_hb(df: DataFrame, hb: str = "Hb") -> DataFrame:
    return df.filter(known(hb))


def last_try_of_day(df: DataFrame, donor: str = "donor", date: str = "date", day: str = "dateonly") -> DataFrame:
    """Last attempt of each subject and day (ties stay) with the number of attempts.

    Day totals are combined on the map side and joined back, so neither a busy subject
    nor a busy day has to sit in one task.
    """
    days = df.groupBy(donor, day).agg(F.max(date).alias("__last"), F.count(F.lit(1)).alias("triesOnTheDay"))
    return df.join(days, [donor, day]).filter(F.col(date) == F.col("__last")).drop("__last")


def tries_on_day(df: DataFrame, donor: str = "donor", day: str = "dateonly", name: str = "tries") -> DataFrame:
    days = df.groupBy(donor, day).agg(F.count(F.lit(1)).alias(name))
    return df.join(days, [donor, day])


def restrict_time_window(df: DataFrame, day: str = "dateonly", years: float = 5) -> DataFrame:
    """Rows of the last ``years`` of 365.25 days before the newest day of the table."""
    newest = df.agg(F.max(F.col(day)).cast("timestamp").alias("end")).scalar()
    start = F.unix_timestamp(newest) - int(years * YEAR_SECONDS)
    return df.filter(F.unix_timestamp(F.col(day).cast("timestamp")) >= start)


def active_last_year(df: DataFrame, donor: str = "donor", day: str = "dateonly", end: Any = None) -> DataFrame:
    """Subjects with an event in the last 365.25 days of the window."""
    if end is None:
        end = df.agg(F.max(F.col(day)).alias("end")).scalar()
    last = F.unix_timestamp(column(end).cast("timestamp"))
    at = F.unix_timestamp(F.col(day).cast("timestamp"))
    recent = (at >= last - YEAR_SECONDS) & (at <= last)
    seen = attach(df.withColumn("__recent", recent), donor, __active=Whole(F.max("__recent")))
    return seen.filter("__active").drop("__recent", "__active")


def first_event_flag(df: DataFrame, donor: str = "donor", day: str = "dateonly", hot=None) -> DataFrame:
    first = attach(df, donor, hot=hot, __first=Whole(F.min(day)))
    return first.withColumn("first_event", F.col(day) == F.col("__first")).drop("__first")


def drop_first_hb_null(df: DataFrame, donor: str = "donor", first: str = "first_event", hb: str = "Hb", hot=None) -> DataFrame:
    bad = F.max(F.col(first) & F.col(hb).isNull())
    return attach(df, donor, hot=hot, __bad=Whole(bad)).filter(~F.col("__bad")).drop("__bad")


def first_within_tolerance(
    df: DataFrame, stated: str = "date_first_donation", donor: str = "donor", day: str = "dateonly", max_diff: int = 60
) -> DataFrame:
    """Subjects whose observed first day is 0..max_diff days after the stated one."""
    both = attach(df, donor, __seen=Whole(F.min(day)), __stated=Whole(F.min(stated)))
    gap = F.datediff("__seen", "__stated")
    return both.filter(gap.between(0, max_diff)).drop("__seen", "__stated")


def keep_whole_blood_or_deferral(df: DataFrame, kind: str = "donat_phleb") -> DataFrame:
    return df.filter(F.col(kind).isin("K", "*"))


def drop_lost_first_event(df: DataFrame, donor: str = "donor", first: str = "first_event", hot=None) -> DataFrame:
    """Drop subjects whose first event was removed by an earlier rule."""
    return attach(df, donor, hot=hot, __any=Whole(F.max(first))).filter("__any").drop("__any")


def drop_unknown_interval(
    df: DataFrame, first: str = "first_event", days: str = "days_to_previous_fb", hb: str = "Hb"
) -> DataFrame:
    return df.filter(F.col(first) | known(days, hb))


def min_history(df: DataFrame, hlen: int, donor: str = "donor", exactly: bool = False) -> DataFrame:
    """Series of at least ``hlen`` events; at most ``-hlen`` when negative; or exactly."""
    length = F.col("__length")
    test = length == abs(hlen) if exactly else (length <= -hlen if hlen < 0 else length >= hlen)
    return attach(df, donor, __length=Whole(F.count(F.lit(1)))).filter(test).drop("__length")


def drop_single_event_donors(df: DataFrame, donor: str = "donor") -> DataFrame:
    return min_history(df, 2, donor)


def last_event_per_donor(df: DataFrame, donor: str = "donor", day: str = "dateonly") -> DataFrame:
    """Rows on the subject's last day, ties kept."""
    return attach(df, donor, __last=Whole(F.max(day))).filter(F.col(day) == F.col("__last")).drop("__last")


def drop_zero_count(df: DataFrame, counts: Sequence[str]) -> DataFrame:
    """Rows whose lifetime count, summed over the columns, is not zero."""
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in counts), F.lit(0))
    return df.filter(total != 0)


def drop_too_soon(
    df: DataFrame, days: str = "days_to_previous_fb", sex: str = "sex", male: int = 62, female: int = 92
) -> DataFrame:
    """Rows with an interval of at least the regular one; an unknown interval is dropped."""
    soon = ((F.col(days) < male) & (F.col(sex) == "male")) | ((F.col(days) < female) & (F.col(sex) == "female"))
    return df.filter(~soon)


def drop_suspicious_last(
    df: DataFrame, order: Sequence[str], donor: str = "donor", flag: str = "Hb_deferral",
    volume: str = "volume_drawn", max_volume: int = 100,
) -> DataFrame:
    """Drop the last row when the one before was low but had a full volume drawn."""
    odd = F.col(flag) & (F.col(volume) > max_volume)
    place = F.struct(*order)
    marked = attach(
        df.withColumn("__odd", odd), donor, order,
        __before=Lag("__odd"), __end=Whole(F.max(place)),
    )
    drop = (place == F.col("__end")) & F.coalesce(F.col("__before"), F.lit(False))
    return marked.filter(~drop).drop("__odd", "__before", "__end")


def bad_id_filter(df: DataFrame, identifier: str, pattern: str = r"^Y\d{14}.$") -> DataFrame:
    return df.filter(F.col(identifier).rlike(pattern))


def generic_filter(
    df: DataFrame, equals: Mapping[str, Any] | None = None, ranges: Mapping[str, tuple] | None = None
) -> DataFrame:
    """Equality and open-interval predicates, each optional."""
    for name, value in (equals or {}).items():
        df = df.filter(F.col(name) == F.lit(value))
    for name, (low, high) in (ranges or {}).items():
        df = df.filter((F.col(name) > F.lit(low)) & (F.col(name) < F.lit(high)))
    return df
