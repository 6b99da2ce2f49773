"""Descriptive tables and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorflow.operators.ordered import RunSum, attach, exact_quantiles
from donorflow.operators.ordering import last_row_by_desc_date
from donorflow.operators.shape import melt


def _ones(flag: str | Column) -> Column:
    flag = F.col(flag) if isinstance(flag, str) else flag
    return F.when(flag, 1).otherwise(0).cast("long")


def donor_max_deferral(df: DataFrame, donor: str = "donor", flag: str = "Hb_deferral") -> DataFrame:
    """One row: subjects and events, how many deferred, and both rates in percent."""
    per = df.groupBy(donor).agg(F.count(F.lit(1)).alias("n"), F.sum(_ones(flag)).alias("hits"))
    total = per.agg(
        F.count(F.lit(1)).alias("donors"),
        F.coalesce(F.sum(_ones(F.col("hits") > 0)), F.lit(0)).alias("deferred_donors"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("donations"),
        F.coalesce(F.sum("hits"), F.lit(0)).alias("deferred_donations"),
    )
    return total.withColumns({
        "donor_rate": F.try_divide(F.lit(100.0) * F.col("deferred_donors"), F.col("donors")),
        "donation_rate": F.try_divide(F.lit(100.0) * F.col("deferred_donations"), F.col("donations")),
    })


def data_counts(
    df: DataFrame, by: Sequence[str], donor: str = "donor", flag: str = "Hb_deferral", day: str = "dateonly"
) -> DataFrame:
    """Donations, donors, deferrals, deferred donors and deferred last donations per group.

    Every (group, donor) collapses first, with the deferrals of its newest day found by a
    maximum over (day, deferrals of the day); groups then only add up small rows.
    """
    days = df.groupBy(*by, donor, day).agg(F.count(F.lit(1)).alias("n"), F.sum(_ones(flag)).alias("hits"))
    donors = days.groupBy(*by, donor).agg(
        F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.max_by("hits", day).alias("last_hits")
    )
    return donors.groupBy(*by).agg(
        F.sum("n").alias("donations"),
        F.count(F.lit(1)).alias("donors"),
        F.sum("hits").alias("deferrals"),
        F.sum(_ones(F.col("hits") > 0)).alias("deferred_donors"),
        F.sum("last_hits").alias("deferred_last_donations"),
    )


# Lower ends of the age classes; the last class ends below 75.
AGE_BREAKS = [18, 25, 30, 35, 40, 45, 50, 55, 60, 65, 70, 75]


def age_class(age: str | Column, breaks: Sequence[int] = AGE_BREAKS) -> Column:
    """Class label such as [18,25); NULL outside the breaks."""
    age = F.col(age) if isinstance(age, str) else age
    out = None
    for low, high in zip(breaks, breaks[1:]):
        test, name = (age >= low) & (age < high), F.lit(f"[{low},{high})")
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def data_counts_by_age(df: DataFrame, by: Sequence[str], age: str = "age", **names: str) -> DataFrame:
    """As ``data_counts`` per age class; a donor counts in every class it has events in."""
    return data_counts(df.withColumn("age_class", age_class(age)), [*by, "age_class"], **names)


def deferral_rate_by_age(sizes: DataFrame) -> DataFrame:
    rate = F.lit(100.0) * F.col("deferred_last_donations") / F.col("donors")
    return sizes.withColumn("deferral_rate", rate)


def series_length_hist(df: DataFrame, donor: str = "donor", cap: int = 20) -> DataFrame:
    """Subjects per series length, longer ones pooled."""
    lengths = df.groupBy(donor).agg(F.count(F.lit(1)).alias("n"))
    shown = F.when(F.col("n") <= cap, F.col("n").cast("string")).otherwise("Longer")
    return lengths.groupBy(shown.alias("Length")).agg(F.count(F.lit(1)).alias("Count"))


def suppressed_histogram(df: DataFrame, columns: Sequence[str], bins: int = 30, min_n: int = 5) -> DataFrame:
    """Counts in equal bins over each column's own range; counts under ``min_n`` become 0.

    Complete rows only. Bins are right-closed and the outer edges reach 0.1 percent of the
    range further, so the extremes fall inside.
    """
    complete = df.select(*columns).dropna()
    one = complete.agg(*[f(F.col(c).cast("double")).alias(f"{p}_{c}") for c in columns for p, f in (("lo", F.min), ("hi", F.max))])
    edges = F.broadcast(one.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(f"lo_{c}").alias("lo"), F.col(f"hi_{c}").alias("hi")) for c in columns
    ])).alias("e")).select("e.*"))
    long = melt(complete, columns).join(edges, "name")
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.ceil((F.col("value") - F.col("lo")) / width)
    number = F.when(width > 0, F.least(F.greatest(place, F.lit(1)), F.lit(bins))).otherwise(F.lit(1))
    counts = long.groupBy("name", number.cast("int").alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    span = F.col("hi") - F.col("lo")
    low_edge = F.when(F.col("bin") == 1, F.col("lo") - span / 1000).otherwise(F.col("lo") + (F.col("bin") - 1) * span / bins)
    high_edge = F.when(F.col("bin") == bins, F.col("hi") + span / 1000).otherwise(F.col("lo") + F.col("bin") * span / bins)
    shown = F.when(F.col("n") < min_n, 0).otherwise(F.col("n")).cast("long")
    return counts.select("name", "bin", low_edge.alias("low"), high_edge.alias("high"), shown.alias("n"))


def variable_summary(
    df: DataFrame, numeric: Sequence[str], logical: Sequence[str] = (), factors: Sequence[str] = ()
) -> DataFrame:
    """Moments, quartiles and NULLs of numeric columns; value counts of the others."""
    long = melt(df, numeric)
    stats = long.groupBy("name").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.sum(_ones(F.col("value").isNull())).alias("nulls"),
    )
    quarts = exact_quantiles(long, "value", {"median": 0.5, "q1": 0.25, "q3": 0.75}, "name")
    out = stats.join(quarts, "name", "left").withColumn("type", F.lit("numeric"))
    for kind, names in (("boolean", logical), ("factor", factors)):
        if names:
            text = df.select(*[F.col(c).cast("string").alias(c) for c in names]).unpivot([], list(names), "name", "value")
            counts = text.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
            nulls = F.when(F.col("value").isNull(), F.col("n")).otherwise(0).cast("long")
            out = out.unionByName(counts.withColumns({"nulls": nulls, "type": F.lit(kind)}), allowMissingColumns=True)
    return out


def crosstab(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Two-way counts with a stated list of columns."""
    cells = [F.sum(_ones(F.col(column) == F.lit(v))).alias(str(v).lower()) for v in values]
    return df.groupBy(row).agg(*cells)


def deferral_by_career(df: DataFrame, group: str, count: str, flag: str = "Hb_deferral") -> DataFrame:
    sums = df.groupBy(group, count).agg(F.sum(_ones(flag)).alias("deferred"), F.sum(_ones(~F.col(flag))).alias("accepted"))
    return sums.withColumn("rate", F.col("deferred") / (F.col("accepted") + F.col("deferred")))


def career_stats(df: DataFrame, by: Sequence[str], count: str) -> DataFrame:
    """n, max, min, mean and exact median of a count per group."""
    stats = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.max(count).alias("max"), F.min(count).alias("min"), F.avg(count).alias("mean")
    )
    return stats.join(exact_quantiles(df, count, {"median": 0.5}, by), list(by))


def one_deferral(df: DataFrame, dim: DataFrame, label: str | None = "label", donor: str = "donor", flag: str = "Hb_deferral") -> DataFrame:
    """Ever deferred, and the partition label, per subject with subject-level columns."""
    extra = [F.max(label).alias(label)] if label else []
    ever = df.groupBy(donor).agg(F.max(_ones(flag)).cast("int").alias("one_deferral"), *extra)
    return dim.join(ever, donor)


def label_balance(df: DataFrame, flag: str = "Hb_deferral", donor: str = "donor", order: Sequence[str] = ("date", "don_id")) -> DataFrame:
    return last_row_by_desc_date(df.select(donor, flag, *order), donor, order).groupBy(flag).agg(F.count(F.lit(1)).alias("n"))


def positives_report(df: DataFrame, donor: str = "donor", flag: str = "Hb_deferral") -> DataFrame:
    ever = df.filter(F.col(flag)).select(donor).distinct()
    return ever.agg(F.count(F.lit(1)).alias("donors"))


def class_presence_check(df: DataFrame, label: str = "Hb_deferral") -> DataFrame:
    counts = df.agg(F.coalesce(F.sum(_ones(label)), F.lit(0)).alias("deferred"),
                    F.coalesce(F.sum(_ones(~F.col(label))), F.lit(0)).alias("accepted"))
    return counts.withColumn("ok", (F.col("deferred") > 0) & (F.col("accepted") > 0))


def constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Names of columns without variation."""
    one = df.agg(*[F.stddev_samp(F.col(c).cast("double")).alias(c) for c in columns])
    return one.unpivot([], list(columns), "name", "sd").filter(F.col("sd") == 0).select("name")


def cost_ratios(
    df: DataFrame, start: str, end: str, donor: str = "donor", day: str = "dateonly", kind: str = "donat_phleb",
    flag: str = "Hb_deferral", sex: str = "sex", order: Sequence[str] = ("clock", "don_id"),
) -> DataFrame:
    """Shares of returning donors and of deferrals by sex, and the deferral prevalence.

    A returning donation is any whole blood donation but the subject's first.
    """
    whole = F.col(kind) == "K"
    seen = attach(df, donor, order, __nth=RunSum(_ones(whole)))
    inside = F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    back = inside & whole & (F.col("__nth") > 1)
    low = inside & (F.col(kind) == "*") & F.col(flag)

    def n(test: Column) -> Column:
        return F.sum(_ones(test))

    counts = seen.agg(
        n(inside & whole).alias("all"), n(back).alias("back"), n(back & (F.col(sex) == "male")).alias("mback"),
        n(back & (F.col(sex) == "female")).alias("fback"), n(low).alias("low"),
        n(low & (F.col(sex) == "male")).alias("mlow"), n(low & (F.col(sex) == "female")).alias("flow"),
    )
    def ratio(a, b):
        return F.try_divide(F.col(a), F.col(b))
    return counts.select(
        ratio("mback", "back").alias("mr"), ratio("fback", "back").alias("fr"), ratio("mlow", "low").alias("mdr"),
        ratio("flow", "low").alias("fdr"), F.try_divide(F.col("low"), F.col("low") + F.col("all")).alias("d"),
    )


def model_pair_totals(long: DataFrame, ids: Sequence[str] = ("data", "model")) -> DataFrame:
    """Both sex-specific models together: a6 adds up minus one, E6 and q6 add up."""
    def total(name: str) -> Column:
        return F.sum(F.when(F.col("variable") == name, F.col("value")))
    return long.groupBy(*ids).agg((total("a6") - 1).alias("a6"), total("E6").alias("E6"), total("q6").alias("q6"))


def r_squared(df: DataFrame, observed: str, predicted: str) -> DataFrame:
    return df.agg(F.pow(F.corr(observed, predicted), 2).alias("r2"))


def mean_sd_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """"mean (sd)" per column, both rounded to two places."""
    stats = melt(df, columns).groupBy("name").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    text = F.concat(F.round("m", 2).cast("string"), F.lit(" ("), F.round("s", 2).cast("string"), F.lit(")"))
    return stats.select("name", text.alias("text"))


def med_iq_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """"median (q1, q3)" per column from exact quartiles."""
    q = exact_quantiles(melt(df, columns), "value", {"m": 0.5, "lo": 0.25, "hi": 0.75}, "name")
    text = F.concat(F.col("m").cast("string"), F.lit(" ("), F.col("lo").cast("string"), F.lit(", "), F.col("hi").cast("string"), F.lit(")"))
    return q.select("name", text.alias("text"))
