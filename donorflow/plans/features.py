"""Raw donation and donor tables to an audited feature table.

Exclusion rules do not filter one after the other. Each row is tagged with the number of
the first rule it fails, and later rules look only at rows still untagged. The audit and
the features read the same tags, and every window shares one exchange on the subject.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from donorflow.functions import expr
from donorflow.functions.metadata import YEAR_SECONDS
from donorflow.operators import joins, rules, series
from donorflow.operators.ordered import HotKeys, Lag, RunMax, RunSum, SpanSum, Whole, attach, hot_keys
from donorflow.session import reliable_checkpoint

# Raw column names and the names used from here on.
DONATION_NAMES = {
    "KEY_DONAT_INDEX_DON": "don_id", "KEY_DONOR": "donor", "KEY_DONAT_INDEX_DATE": "date",
    "DONAT_PHLEB_START": "phleb_start", "DONAT_STATUS": "status", "KEY_DONAT_PHLEB": "donat_phleb",
    "DONAT_VOL_DRAWN": "volume_drawn", "DONAT_RESULT_CODE": "Hb",
}
DONOR_NAMES = {
    "KEY_DONOR": "donor", "KEY_DONOR_SEX": "sex", "KEY_DONOR_DOB": "dob",
    "DONOR_DATE_FIRST_DONATION": "date_first_donation", "DONOR_NB_DONAT_PROGESA": "nb_donat_progesa",
    "DONOR_NB_DONAT_OUTSIDE": "nb_donat_outside",
}
FEATURE_COLUMNS = [
    "don_id", "donor", "Hb", "dateonly", "previous_Hb_def", "days_to_previous_fb", "donat_phleb", "sex", "age",
    "Hb_deferral", "nb_donat_progesa", "nb_donat_outside", "first_event", "previous_Hb", "year", "warm_season",
    "Hb_first", "hour", "consecutive_deferrals", "recent_donations", "previous_Hb2", "previous_Hb3",
    "previous_Hb4", "previous_Hb5", "days_to_previous_Hb", "days_to_previous_Hb2", "days_to_previous_Hb3",
    "days_to_previous_Hb4", "days_to_previous_Hb5", "recent_deferrals",
]
# Exclusion rules in the order in which they apply.
REASONS = [
    (1, "birth date equals event date"),
    (2, "event date or birth date unknown"),
    (3, "placeholder event date"),
    (4, "younger than 18"),
    (5, "Hb unknown"),
    (6, "not the last try of the day"),
    (7, "before the time window"),
    (8, "first Hb unknown"),
    (9, "neither whole blood nor deferral"),
    (10, "first event lost"),
    (11, "interval unknown"),
    (12, "no event in the last year"),
]


@dataclass(frozen=True)
class Settings:
    """Cutoffs in g/L, the unit of the input, and optional behavior."""

    male: float = 135.0
    female: float = 125.0
    unit: str = "gperl"
    southern: bool = False
    restrict: bool = False
    chunk_rows: int | None = None
    keep_tagged: bool = True  # hold the tagged rows for the two passes that read them


def read_events(donations: DataFrame, donors: DataFrame, settings: Settings, check: bool = True) -> DataFrame:
    """Rename, parse, convert and join the raw tables; unparsable dates become NULL."""
    events = expr.rename_map(donations, DONATION_NAMES)
    subjects = expr.rename_map(donors, DONOR_NAMES)
    if "don_id" not in events.columns:
        # no event id in this format: equal times are ordered by the row's own values
        events = events.withColumn("don_id", F.xxhash64(*[F.col(c).cast("string") for c in sorted(events.columns)]))
    counted = "nb_donat_progesa" in subjects.columns
    events = events.select(
        "donor", "don_id",
        expr.parse_event_ts("date", "phleb_start").alias("date"),
        "status", "donat_phleb",
        F.col("volume_drawn").cast("int").alias("volume_drawn"),
        expr.convert_hb_unit(F.col("Hb").cast("double"), settings.unit, "gperl").alias("Hb"),
    )
    outside = F.col("nb_donat_outside") if "nb_donat_outside" in subjects.columns else F.lit(0)
    subjects = subjects.select(
        "donor",
        expr.recode("sex", {"F": "female", "M": "male"}).alias("sex"),
        expr.parse_day("dob").alias("dob"),
        (F.col("nb_donat_progesa") if counted else F.lit(None)).cast("int").alias("nb_donat_progesa"),
        outside.cast("int").alias("nb_donat_outside"),
        *[c for c in ("label",) if c in subjects.columns],
    )
    joined = joins.donation_donor_join(events, subjects, check=check)
    return add_event_columns(joined, settings)


def add_event_columns(joined: DataFrame, settings: Settings) -> DataFrame:
    return joined.withColumns({
        "dateonly": F.col("date").cast("date"),
        "clock": F.unix_timestamp(F.col("date").cast("timestamp")),
        "age": expr.age_at_event("dob", "date"),
        "Hb_deferral": expr.hb_deferral("Hb", "sex", settings.male, settings.female),
    })


def _first_failed(*rules_in_order: tuple[int, Column]) -> Column:
    """Number of the first rule that is not kept; NULL when all are."""
    out = F.lit(None).cast("int")
    for number, kept in reversed(rules_in_order):
        out = F.when(~F.coalesce(kept, F.lit(True)), number).otherwise(out)
    return out


def _row_step() -> Column:
    """First failed rule among those that look at one row."""
    return _first_failed(
        (1, rules.differs("date", "dob")),
        (2, rules.known("date", "dob")),
        (3, rules.not_sentinel("date")),
        (4, rules.of_age("age")),
        (5, rules.known("Hb")),
    )


def window_end(events: DataFrame) -> Column:
    """Newest day of the table, in seconds.

    The newest day survives the last-try rule, so it is known before any shuffle.
    """
    newest = events.filter(_row_step().isNull()).agg(F.max("dateonly").cast("timestamp").alias("end"))
    return F.unix_timestamp(newest.scalar())


def tag_exclusions(
    events: DataFrame, settings: Settings, hot: HotKeys | None = None, end: Column | None = None
) -> DataFrame:
    """Add ``step`` (first failed rule or NULL), ``first_event`` and ``days_to_previous_fb``."""
    if hot is None:
        hot = hot_keys(events, "donor", settings.chunk_rows)
    rows = events.withColumn("__row_step", _row_step())
    alive = F.col("__row_step").isNull()
    in_window = F.lit(True)
    if settings.restrict:
        end = window_end(events) if end is None else end
        at = F.unix_timestamp(F.col("dateonly").cast("timestamp"))
        in_window = at >= end - 5 * YEAR_SECONDS
    days = attach(
        rows, "donor", hot=hot,
        __first=Whole(F.min(F.when(alive & in_window, F.col("dateonly")))),
        __last_try=Whole(F.max(F.when(alive, F.col("date"))), ("dateonly",)),
    )
    day_step = F.coalesce(
        F.col("__row_step"), _first_failed((6, F.col("date") == F.col("__last_try")), (7, in_window))
    )
    days = days.withColumns({"__day_step": day_step, "first_event": F.col("dateonly") == F.col("__first")})
    alive = F.col("__day_step").isNull()
    wanted = F.col("donat_phleb").isin("K", "*")
    full = F.when(alive & series.full_blood(), F.col("dateonly"))
    seen = attach(
        days, "donor", ["clock", "don_id"], hot,
        __previous=RunMax(full, current=False),
        __has_first=Whole(F.max(F.when(alive & wanted, F.col("first_event")))),
    )
    seen = seen.withColumn("days_to_previous_fb", F.datediff("dateonly", "__previous"))
    later = _first_failed(
        (9, wanted & F.col("donat_phleb").isNotNull()),
        (10, F.coalesce("__has_first", F.lit(False))),
        (11, F.col("first_event") | F.col("days_to_previous_fb").isNotNull()),
    )
    later = F.when(F.col("donat_phleb").isNull(), 9).otherwise(later)
    tagged = seen.withColumn("step", F.coalesce("__day_step", later))
    if settings.restrict:
        recent = F.col("step").isNull() & (F.unix_timestamp(F.col("dateonly").cast("timestamp")) >= end - YEAR_SECONDS)
        tagged = attach(tagged, "donor", hot=hot, __recent=Whole(F.max(recent)))
        tagged = tagged.withColumn("step", F.coalesce("step", F.when(~F.col("__recent"), 12)))
    return tagged.select(*events.columns, "first_event", "days_to_previous_fb", "step")


def exclusion_audit(tagged: DataFrame, donor: str = "donor") -> DataFrame:
    """Rows and subjects before each rule, and how many it dropped.

    A subject is gone at the last step of its rows, so subjects are counted once by that
    step; the totals before each rule are suffix sums over the dozen rules.
    """
    kept = REASONS[-1][0] + 1
    steps = tagged.select(donor, F.coalesce("step", F.lit(kept)).alias("step"))
    numbers = range(1, kept + 1)
    per_donor = steps.groupBy(donor).agg(
        F.max("step").alias("gone"), *[F.sum((F.col("step") == i).cast("long")).alias(f"n{i}") for i in numbers]
    )
    small = per_donor.groupBy("gone").agg(F.count(F.lit(1)).alias("donors"), *[F.sum(f"n{i}").alias(f"n{i}") for i in numbers])
    names = dict(REASONS) | {kept: "kept"}
    per_step = F.explode(F.array(*[
        F.struct(
            F.lit(i).alias("step"), F.lit(names[i]).alias("reason"), F.col(f"n{i}").alias("rows"),
            F.when(F.col("gone") == i, F.col("donors")).otherwise(0).alias("donors"),
        ) for i in numbers
    ]))
    table = small.select(per_step.alias("s")).select("s.*").groupBy("step", "reason").agg(F.sum("rows").alias("rows"), F.sum("donors").alias("donors"))
    # one row per rule: a dozen rows at most
    after = Window.partitionBy(F.lit(0)).orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    table = table.withColumns({"rows_before": F.sum("rows").over(after), "donors_before": F.sum("donors").over(after)})
    return table.filter(F.col("step") < kept).select(
        "step", "reason", F.col("rows").alias("rows_dropped"), "rows_before",
        F.col("donors").alias("donors_dropped"), "donors_before",
    )


def mean_hour_of(tagged: DataFrame) -> Column:
    """Mean hour of the kept rows that are not at midnight."""
    hours = tagged.filter(F.col("step").isNull()).select(expr.hour_numeric("date").alias("hour"))
    return hours.filter(F.col("hour") != 0).agg(F.avg("hour").alias("hour")).scalar()


def derive_features(
    tagged: DataFrame, settings: Settings, hot: HotKeys | None = None, mean_hour: Column | None = None
) -> DataFrame:
    """Lags, run lengths and sliding counts of the rows that no rule dropped."""
    mean_hour = mean_hour_of(tagged) if mean_hour is None else mean_hour
    kept = tagged.filter(F.col("step").isNull()).withColumn("hour", expr.hour_numeric("date"))
    if hot is None:
        hot = hot_keys(kept, "donor", settings.chunk_rows)
    order = ["clock", "don_id"]
    low = F.when(F.col("Hb_deferral"), 1).otherwise(0).cast("long")
    whole = F.when(F.col("donat_phleb") == "K", 1).otherwise(0).cast("long")
    wide = attach(
        kept, "donor", order, hot,
        **series.lag_specs(),
        previous_Hb_def=Lag("Hb_deferral"),
        Hb_first=Whole(F.min_by("Hb", F.struct(*order))),
        __series=Whole(F.count(F.lit(1))),
        __before=RunSum(low, current=False),
        __donations=SpanSum(whole, "clock", 5 * YEAR_SECONDS),
        __deferrals=SpanSum(low, "clock", 2 * YEAR_SECONDS),
    )
    accepted = F.when(~F.col("Hb_deferral"), F.col("__before"))
    wide = attach(wide, "donor", order, hot, __at=RunMax(accepted, current=False))
    gaps = {
        f"days_to_previous_Hb{'' if i == 1 else i}": F.datediff("dateonly", f"__day{i}") for i in range(1, 6)
    }
    label = [c for c in ("label",) if c in tagged.columns]
    return wide.withColumns({
        **gaps,
        "consecutive_deferrals": (F.col("__before") - F.coalesce("__at", F.lit(0))).cast("int"),
        "recent_donations": (F.col("__donations") - whole).cast("int"),
        "recent_deferrals": (F.col("__deferrals") - low).cast("int"),
        "nb_donat_progesa": F.coalesce("nb_donat_progesa", F.col("__series").cast("int")),
        "year": F.year("dateonly"),
        "warm_season": expr.warm_season(F.month("dateonly"), settings.southern),
        "hour": F.when(F.col("hour") == 0, mean_hour).otherwise(F.col("hour")),
    }).select(*FEATURE_COLUMNS, *label)


def _tagged_parts(
    donations: DataFrame, donors: DataFrame, settings: Settings, check: bool
) -> list[tuple[DataFrame, HotKeys]]:
    """Tagged rows of ordinary subjects and, apart from them, of hot ones.

    Hot subjects are found on the raw key column alone. The parts stay apart through the
    whole chain, so that no step has to look for hot rows again.
    """
    events = read_events(donations, donors, settings, check)
    key = "KEY_DONOR" if "KEY_DONOR" in donations.columns else "donor"
    hot = hot_keys(donations, key, settings.chunk_rows)
    end = window_end(events) if settings.restrict else None
    return [(tag_exclusions(part, settings, own, end), own) for part, own in hot.split(events, "donor")]


def whole_series_features(
    donations: DataFrame, donors: DataFrame, settings: Settings = Settings(), check: bool = True
) -> DataFrame:
    """Raw tables to the feature table."""
    parts = _tagged_parts(donations, donors, settings, check)
    if settings.keep_tagged:
        # the mean hour and the features both read them
        parts = [(reliable_checkpoint(tagged.filter(F.col("step").isNull())), own) for tagged, own in parts]
    mean_hour = mean_hour_of(_stack([tagged for tagged, _ in parts]))
    return _stack([derive_features(tagged, settings, own, mean_hour) for tagged, own in parts])


def audit(donations: DataFrame, donors: DataFrame, settings: Settings = Settings(), check: bool = True) -> DataFrame:
    return exclusion_audit(_stack([tagged for tagged, _ in _tagged_parts(donations, donors, settings, check)]))


def _stack(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def additional_preprocess(features: DataFrame, variables: Sequence[str], counts: Sequence[str] = ()) -> DataFrame:
    """Last event of subjects with more than one, labeled, reduced to the variables."""
    place = attach(features, "donor", __n=Whole(F.count(F.lit(1))), __last=Whole(F.max("dateonly")))
    last = place.filter((F.col("__n") > 1) & (F.col("dateonly") == F.col("__last")))
    last = last.withColumn("Hb_deferral", expr.label_deferral("Hb_deferral"))
    if counts:
        last = rules.drop_zero_count(last, counts)
    return last.select(*variables)
