"""Column expressions: parsing, units, calendar fields, labels, text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorflow.functions.metadata import DISPLAY_OVERRIDES, MMOL_PER_GRAM, SURVEY_CODES


def column(value: Any) -> Column:
    return F.col(value) if isinstance(value, str) else value


def rename_map(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename ``{old: new}``; names that are absent are ignored."""
    return df.withColumnsRenamed(dict(mapping))


# grams per litre of one unit
_IN_GRAMS = {
    "gperl": lambda c: c,
    "gperdl": lambda c: c * 10.0,
    "mmolperl": lambda c: c / MMOL_PER_GRAM,
}
_FROM_GRAMS = {
    "gperl": lambda c: c,
    "gperdl": lambda c: c / 10.0,
    "mmolperl": lambda c: c * MMOL_PER_GRAM,
}


def convert_hb_unit(value: Any, source: str, target: str) -> Column:
    """Hemoglobin between g/L, g/dL and mmol/L (via g/L)."""
    if source not in _IN_GRAMS or target not in _FROM_GRAMS:
        raise ValueError(f"unsupported hemoglobin units: {source} to {target}")
    value = column(value)
    return value if source == target else _FROM_GRAMS[target](_IN_GRAMS[source](value))


def to_mmol(value: Any) -> Column:
    return convert_hb_unit(value, "gperl", "mmolperl")


def parse_event_ts(date: Any, hhmm: Any) -> Column:
    """``yyyyMMdd`` plus ``HHmm``; a missing time is midnight, a bad date is NULL."""
    minutes = F.lpad(F.coalesce(column(hhmm).cast("string"), F.lit("0")), 4, "0")
    return F.try_to_timestamp(F.concat(column(date), F.lit(" "), minutes), F.lit("yyyyMMdd HHmm"))


def parse_day(value: Any, pattern: str = "yyyyMMdd") -> Column:
    return F.try_to_timestamp(column(value).cast("string"), F.lit(pattern)).cast("date")



def age_at_event(dob: Any, ts: Any) -> Column:
    """Completed calendar years; a Feb-29 birthday is not reached on Feb-28."""
    dob, ts = column(dob), column(ts)
    day = F.month(ts) * 100 + F.dayofmonth(ts)
    birthday = F.month(dob) * 100 + F.dayofmonth(dob)
    return (F.year(ts) - F.year(dob) - F.when(day < birthday, 1).otherwise(0)).cast("int")


def date_parts(ts: Any) -> dict[str, Column]:
    """Year, Month, Day, Hour and the week counted from 1 January."""
    ts = column(ts)
    return {
        "Year": F.year(ts),
        "Month": F.month(ts),
        "Day": F.dayofmonth(ts),
        "Hour": F.hour(ts),
        "Week": (F.floor((F.dayofyear(ts) - 1) / 7) + 1).cast("int"),
    }


def hour_numeric(ts: Any) -> Column:
    ts = column(ts)
    return F.hour(ts) + F.minute(ts) / 60.0


def warm_season(month: Any, southern: bool = False) -> Column:
    inside = column(month).between(4, 9)
    return (~inside if southern else inside).cast("double")


def hb_deferral(hb: Any, sex: Any, male: float, female: float) -> Column:
    """Hb strictly below the cutoff of the sex; unknown Hb is not a deferral."""
    hb, sex = column(hb), column(sex)
    low = ((sex == "male") & (hb < male)) | ((sex == "female") & (hb < female))
    return F.when(low, True).otherwise(False)


def recode(value: Any, mapping: Mapping[str, Any], otherwise: Any = None) -> Column:
    """Replace values by ``mapping``; the rest become ``otherwise``."""
    value, out = column(value), None
    for old, new in mapping.items():
        out = F.when(value == old, F.lit(new)) if out is None else out.when(value == old, F.lit(new))
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def label_deferral(flag: Any) -> Column:
    return F.when(column(flag), F.lit("Deferred")).otherwise(F.lit("Accepted"))


def bool_to_int(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Logical columns (or the named ones) to 0/1 integers."""
    names = columns or [f.name for f in df.schema.fields if f.dataType.typeName() == "boolean"]
    return df.withColumns({n: F.col(n).cast("int") for n in names}) if names else df


def ordinal_encode(df: DataFrame) -> DataFrame:
    """Survey answers to ordered codes; the supplement count is 0 when not used."""
    out = {name: recode(name, codes) for name, codes in SURVEY_CODES.items() if name in df.columns}
    if "smoking_status" in df.columns:
        out["smoking_status"] = F.when(F.col("smoking_status") == "no", 0).when(
            F.col("smoking_status").isNotNull(), 1
        )
    frame = df.withColumns(out)
    if {"iron_supp", "iron_comp_c"} <= set(df.columns):
        used = F.when(~F.col("iron_supp"), 0).when(F.col("iron_supp"), F.col("iron_comp_c"))
        frame = frame.withColumn("iron_supplement", used).drop("iron_supp", "iron_comp_c")
    return frame


def log_interval(value: Any) -> Column:
    return F.log(column(value))


def pretty_names(df: DataFrame, descriptions: Sequence[tuple]) -> DataFrame:
    """Rename columns to their display names."""
    return df.withColumnsRenamed({d[0]: d[1] for d in descriptions if d[0] in df.columns})


def prettify_variables(variable: Any, pretty: Any, dummy_coded: bool) -> Column:
    """Display names with the fixed overrides applied."""
    names = {(dummy if dummy_coded else plain): shown for plain, dummy, shown in DISPLAY_OVERRIDES}
    return recode(variable, names, otherwise=column(pretty))


def split_id(value: Any) -> dict[str, Column]:
    """``data-sex-model`` into its three parts."""
    parts = F.split(column(value), "-", 3)
    return {"data": F.get(parts, 0), "sex": F.get(parts, 1), "model": F.get(parts, 2)}


def extract_name_month(value: Any) -> dict[str, Column]:
    """``E12`` into the name ``E`` and the month 12; NULL where the shape differs."""
    value, shape = column(value), r"([a-zA-Z]+)([0-9]+)"
    found = value.rlike(shape)
    return {
        "name": F.when(found, F.regexp_extract(value, shape, 1)),
        "month": F.when(found, F.regexp_extract(value, shape, 2)).cast("int"),
    }


def confusion_class(observed: Any, predicted: Any) -> Column:
    obs, pred = column(observed), column(predicted)
    return (
        F.when((obs == 1) & (pred == 1), "True positive")
        .when((obs == 1) & (pred == 0), "False negative")
        .when((obs == 0) & (pred == 1), "False positive")
        .when((obs == 0) & (pred == 0), "True negative")
    )
