"""Per-subject time-series features."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorflow.functions.expr import column
from donorflow.functions.metadata import YEAR_SECONDS
from donorflow.operators.ordered import (
    HotKeys, Lag, RunMax, RunSum, SpanSum, Total, Whole, attach, hot_keys, row_ranks,
)

ORDER = ("date", "don_id")


def event_sequence_id(df: DataFrame, order: Sequence[str] = ORDER, name: str = "seq") -> DataFrame:
    """1..n over the whole table in time order, exact and distributed."""
    return row_ranks(df, order, name=name)


def full_blood(kind: Any = "donat_phleb", status: Any = "status", volume: Any = "volume_drawn") -> Column:
    """A full-blood event: normal whole blood, or enough volume drawn. NULL when unknown."""
    kind, status, volume = column(kind), column(status), column(volume)
    enough = volume > 100
    return (
        ((kind == "K") & (status == "-")) | ((kind == "K") & (status != "-") & enough) | ((kind == "H") & enough)
    )


def days_to_previous_fb(
    df: DataFrame, condition: Column | None = None, donor: str = "donor", day: str = "dateonly",
    order: Sequence[str] = ORDER, hot: HotKeys | None = None, name: str = "days_to_previous_fb",
) -> DataFrame:
    """Days since the last full-blood event of an earlier row; NULL when there is none."""
    hit = F.when(full_blood() if condition is None else condition, F.col(day))
    seen = attach(df, donor, order, hot, __previous=RunMax(hit, current=False))
    return seen.withColumn(name, F.datediff(F.col(day), F.col("__previous"))).drop("__previous")


def previous_deferral(df: DataFrame, flag: str = "Hb_deferral", donor: str = "donor", order: Sequence[str] = ORDER,
                      name: str = "previous_Hb_def") -> DataFrame:
    return attach(df, donor, order, **{name: Lag(flag)})


def first_hb(df: DataFrame, hb: str = "Hb", donor: str = "donor", order: Sequence[str] = ORDER,
             name: str = "Hb_first") -> DataFrame:
    return attach(df, donor, **{name: Whole(F.min_by(F.col(hb), F.struct(*order)))})


def lag_specs(hb: str = "Hb", day: str = "dateonly", n: int = 5) -> dict[str, Any]:
    """Lags 1..n of the value (lag 1 defaults to 0) and of the day."""
    specs: dict[str, Any] = {}
    for i in range(1, n + 1):
        suffix = "" if i == 1 else str(i)
        specs[f"previous_{hb}{suffix}"] = Lag(hb, i, 0.0 if i == 1 else None)
        specs[f"__day{i}"] = Lag(day, i)
    return specs


def _gaps(df: DataFrame, hb: str, day: str, n: int) -> DataFrame:
    names = {f"days_to_previous_{hb}{'' if i == 1 else i}": F.datediff(F.col(day), F.col(f"__day{i}")) for i in range(1, n + 1)}
    return df.withColumns(names).drop(*[f"__day{i}" for i in range(1, n + 1)])


def hb_lags(df: DataFrame, hb: str = "Hb", n: int = 5, donor: str = "donor", order: Sequence[str] = ORDER) -> DataFrame:
    specs = {k: v for k, v in lag_specs(hb, order[0], n).items() if not k.startswith("__")}
    return attach(df, donor, order, **specs)


def day_gaps(df: DataFrame, n: int = 5, hb: str = "Hb", day: str = "dateonly", donor: str = "donor",
             order: Sequence[str] = ORDER) -> DataFrame:
    specs = {k: v for k, v in lag_specs(hb, day, n).items() if k.startswith("__")}
    return _gaps(attach(df, donor, order, **specs), hb, day, n)


def fill_forward(df: DataFrame, value: str, donor: str = "donor", order: Sequence[str] = ORDER, name: str | None = None) -> DataFrame:
    """Carry the last non-NULL value forward.

    The running maximum of (position, value) over non-NULL rows is the last of them.
    """
    place = F.struct(*[F.col(o) for o in order])
    hit = F.when(F.col(value).isNotNull(), F.struct(place.alias("p"), F.col(value).alias("v")))
    filled = attach(df, donor, order, __last=RunMax(hit))
    return filled.withColumn(name or value, F.col("__last.v")).drop("__last")


def consecutive_deferrals(
    df: DataFrame, flag: str = "Hb_deferral", donor: str = "donor", order: Sequence[str] = ORDER,
    hot: HotKeys | None = None, name: str = "consecutive_deferrals",
) -> DataFrame:
    """Length of the run of deferrals that ends just before the row.

    Deferrals so far minus deferrals so far at the last accepted row; both only grow, so
    two running values give it without a loop.
    """
    hot = hot_keys(df, donor) if hot is None else hot
    ones = F.when(F.col(flag), 1).otherwise(0).cast("long")
    counted = attach(df, donor, order, hot, __before=RunSum(ones, current=False))
    accepted = F.when(~F.col(flag), F.col("__before"))
    run = attach(counted, donor, order, hot, __at=RunMax(accepted, current=False))
    length = F.col("__before") - F.coalesce(F.col("__at"), F.lit(0))
    return run.withColumn(name, length.cast("int")).drop("__before", "__at")


def recent_events(
    df: DataFrame, weight: Column, years: float, name: str, clock: str = "clock", donor: str = "donor",
    hot: HotKeys | None = None,
) -> DataFrame:
    """Weight of the other events within ``years`` of 365.25 days, equal times included."""
    own = weight.cast("long")
    span = int(years * YEAR_SECONDS)
    seen = attach(df, donor, [clock], hot, __sum=SpanSum(own, clock, span))
    return seen.withColumn(name, (F.col("__sum") - own).cast("int")).drop("__sum")


def recent_donations(df: DataFrame, years: float = 5, kind: str = "donat_phleb", name: str = "recent_donations", **kw: Any) -> DataFrame:
    return recent_events(df, F.when(F.col(kind) == "K", 1).otherwise(0), years, name, **kw)


def recent_deferrals(df: DataFrame, years: float = 2, flag: str = "Hb_deferral", name: str = "recent_deferrals", **kw: Any) -> DataFrame:
    return recent_events(df, F.when(F.col(flag), 1).otherwise(0), years, name, **kw)


def lifetime_count(df: DataFrame, donor: str = "donor", name: str = "nb_donat_progesa") -> DataFrame:
    return attach(df, donor, **{name: Whole(F.count(F.lit(1)))}).withColumn(name, F.col(name).cast("int"))


def running_index(df: DataFrame, donor: str = "donor", order: Sequence[str] = ORDER, name: str = "i") -> DataFrame:
    return attach(df, donor, order, **{name: RunSum(F.lit(1).cast("long"))})


def refresh_first_event(df: DataFrame, donor: str = "donor", day: str = "dateonly") -> DataFrame:
    """Recompute the first-event flag after rows were filtered."""
    seen = attach(df, donor, __first=Whole(F.min(day)))
    return seen.withColumn("first_event", F.col(day) == F.col("__first")).drop("__first")


def lag_covariates(df: DataFrame, columns: Sequence[str], donor: str = "donor", order: Sequence[str] = ORDER) -> DataFrame:
    """Replace each column by its previous value within the subject."""
    lagged = attach(df, donor, order, **{f"__lag_{c}": Lag(c) for c in columns})
    return lagged.withColumns({c: F.col(f"__lag_{c}") for c in columns}).drop(*[f"__lag_{c}" for c in columns])


def holdout_last_event(df: DataFrame, donor: str = "donor", order: Sequence[str] = ORDER) -> DataFrame:
    """split = test for the last event of each subject, train for the rest."""
    place = F.struct(*order)
    seen = attach(df, donor, __end=Whole(F.max(place)))
    split = F.when(place == F.col("__end"), "test").otherwise("train")
    return seen.withColumn("split", split).drop("__end")


def first_measurements(df: DataFrame, columns: Sequence[str], donor: str = "donor", order: Sequence[str] = ORDER) -> DataFrame:
    """Covariates of each subject's first row: one map-side combined aggregate."""
    first = df.groupBy(donor).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("__z"))
    return first.select(donor, *[F.col(f"__z.{c}").alias(c) for c in columns])


def donor_constants(df: DataFrame, columns: Sequence[str], donor: str = "donor") -> DataFrame:
    return df.select(donor, *columns).distinct()


def dense_donor_index(df: DataFrame, donor: str = "donor", name: str = "idx") -> DataFrame:
    """Subjects numbered 1..D in sorted order, joined back to the rows."""
    ids = row_ranks(df.select(donor).distinct(), donor, name=name)
    return df.join(ids, donor)


def trim_after_last_deferral(
    df: DataFrame, donor: str = "donor", flag: str = "Hb_deferral", order: Sequence[str] = ORDER
) -> DataFrame:
    """Series that end with their last deferral.

    Drops single events and subjects whose only deferral is their first event; subjects
    never deferred keep all rows.
    """
    place = F.struct(*order)
    seen = attach(
        df, donor,
        __n=Whole(F.count(F.lit(1))),
        __hits=Whole(F.sum(F.when(F.col(flag), 1).otherwise(0))),
        __first=Whole(F.min_by(F.col(flag), place)),
        __cut=Whole(F.max(F.when(F.col(flag), place))),
    )
    only_first = (F.col("__hits") == 1) & F.col("__first")
    inside = F.col("__cut").isNull() | (place <= F.col("__cut"))
    return seen.filter((F.col("__n") > 1) & ~only_first & inside).drop("__n", "__hits", "__first", "__cut")


def totals(df: DataFrame, donor: str, **columns: Any) -> DataFrame:
    return attach(df, donor, **{name: Total(value) for name, value in columns.items()})
