"""Evaluation of scores: sweeps, areas, intervals, errors, calibration.

Everything starts from counts per distinct score (a map-side combined aggregate) and
cumulative counts in score order, which never sit in one task (see ``ordered``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from donorflow.functions.cost import cost_columns
from donorflow.functions.expr import to_mmol
from donorflow.operators.ordered import RunSum, Total, exact_quantiles, running, uniform
from donorflow.operators.resampling import resampled_areas, resampled_cells
from donorflow.session import reliable_checkpoint

Z95 = 1.959963984540054  # normal quantile of 0.975


def join_groups(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add the columns of a one-row-per-group table; without groups that is a single row.

    The single row becomes one scalar subquery, not a join.
    """
    if by:
        return a.join(b, list(by))
    row = b.select(F.struct(*[F.col(c) for c in b.columns]).alias("row")).scalar()
    return a.withColumn("__row", row).select(*a.columns, *[F.col("__row")[c].alias(c) for c in b.columns])


def score_counts(df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Positives and negatives per distinct score."""
    one = F.col(weight) if weight else F.lit(1).cast("long")
    positive = F.sum(F.when(F.col(label).cast("int") == 1, one).otherwise(one * 0))
    negative = F.sum(F.when(F.col(label).cast("int") == 0, one).otherwise(one * 0))
    known = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    return known.groupBy(*by, F.col(score).alias("threshold")).agg(positive.alias("pos"), negative.alias("neg"))


def sweep_counts(
    counts: DataFrame, by: Sequence[str] = (), direction: str = ">=", chunk_rows: int | None = None
) -> DataFrame:
    """tp, fp, tn, fn when everything at least (or at most) the threshold is positive."""
    place = -F.col("threshold") if direction == ">=" else F.col("threshold")
    ordered = counts.withColumn("__place", place)
    cum = running(ordered, "__place", by, chunk_rows, tp=RunSum("pos"), fp=RunSum("neg"), P=Total("pos"), N=Total("neg"))
    return cum.withColumns({"fn": F.col("P") - F.col("tp"), "tn": F.col("N") - F.col("fp")}).drop("__place")


def threshold_sweep(
    df: DataFrame, score: str = "score", label: str = "label", by: Sequence[str] = (), direction: str = ">=",
    chunk_rows: int | None = None,
) -> DataFrame:
    return sweep_counts(score_counts(df, score, label, by), by, direction, chunk_rows)


def _f1(tp, fp, fn) -> Column:
    return F.try_divide(2.0 * F.col(tp), 2 * F.col(tp) + F.col(fp) + F.col(fn))


def _best(sweep: DataFrame, goal: Column, by: Sequence[str], extra: Mapping[str, Column]) -> DataFrame:
    """Thresholds that reach the best value; the median of them where several do."""
    scored = sweep.withColumns({"__goal": goal, **extra}).filter(F.col("__goal").isNotNull())
    if by:
        top = scored.groupBy(*by).agg(F.max("__goal").alias("__top"))
        tied = scored.join(top, list(by)).filter(F.col("__goal") == F.col("__top"))
    else:
        tied = scored.filter(F.col("__goal") == scored.agg(F.max("__goal").alias("top")).scalar())
    middle = exact_quantiles(tied, "threshold", {"optimal": 0.5}, by)
    first = tied.groupBy(*by).agg(F.max("__goal").alias("goal"), *[F.max_by(n, "threshold").alias(n) for n in extra])
    return join_groups(middle, first, by).withColumnRenamed("optimal", "threshold")


def optimal_f1_cut(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Threshold of the largest F1, with sensitivity and specificity at it."""
    extra = {"sensitivity": F.try_divide(F.col("tp"), F.col("P")), "specificity": F.try_divide(F.col("tn"), F.col("N"))}
    return _best(sweep, _f1("tp", "fp", "fn"), by, extra).withColumnRenamed("goal", "f1")


def optimal_youden_cut(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Threshold of the largest sensitivity plus specificity."""
    goal = F.try_divide(F.col("tp"), F.col("P")) + F.try_divide(F.col("tn"), F.col("N"))
    return _best(sweep, goal, by, {}).withColumnRenamed("goal", "sum_sens_spec")


def apply_threshold(df: DataFrame, score: str, threshold: float | Column, name: str = "score_predicted_label") -> DataFrame:
    value = F.lit(threshold) if not isinstance(threshold, Column) else threshold
    return df.withColumn("f1_threshold", value).withColumn(name, (F.col(score) >= F.col("f1_threshold")).cast("int"))


def confusion_matrix(df: DataFrame, observed: str, predicted: str) -> DataFrame:
    """The four cells in long form, with zeros where a cell is empty."""
    cells = [(o, p) for o in (0, 1) for p in (0, 1)]
    one = df.agg(*[
        F.coalesce(F.sum(((F.col(observed).cast("int") == o) & (F.col(predicted).cast("int") == p)).cast("long")), F.lit(0)).alias(f"c{o}{p}")
        for o, p in cells
    ])
    rows = [F.struct(F.lit(o).alias("observed"), F.lit(p).alias("predicted"), F.col(f"c{o}{p}").alias("n")) for o, p in cells]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _cells(predicted: Column, label: str) -> dict[str, Column]:
    obs = F.col(label).cast("int") == 1
    return {
        "tp": F.sum((predicted & obs).cast("long")), "fp": F.sum((predicted & ~obs).cast("long")),
        "fn": F.sum((~predicted & obs).cast("long")), "tn": F.sum((~predicted & ~obs).cast("long")),
    }


def cells_at(df: DataFrame, score: str, label: str, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in _cells(F.col(score) >= threshold, label).items()])


def _rates(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    return cells.select(
        *by, F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("TPR"),
        F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")).alias("FPR"),
    )


def tpr_fpr(df: DataFrame, score: str, label: str, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    return _rates(cells_at(df, score, label, threshold, by), by)


def rates_from_labels(frames: Sequence[DataFrame], label: str, predicted: str) -> DataFrame:
    """TPR and FPR of stored labels, several frames pooled."""
    pooled = frames[0].select(label, predicted)
    for f in frames[1:]:
        pooled = pooled.unionByName(f.select(label, predicted))
    return _rates(pooled.agg(*[c.alias(n) for n, c in _cells(F.col(predicted).cast("int") == 1, label).items()]), ())


def score_direction(df: DataFrame, score: str = "score", label: str = "label") -> str:
    """``>=`` when deferred rows have the larger median score (or an equal one), else ``<=``.

    For callers that do not know which way a score points; pass the result to the sweep.
    """
    middle = exact_quantiles(df.withColumn("__y", F.col(label).cast("int")), score, {"median": 0.5}, "__y")
    found = {r["__y"]: r["median"] for r in middle.filter(F.col("__y").isin(0, 1)).collect()}
    if len(found) < 2:
        return ">="
    return ">=" if found[0] <= found[1] else "<="


def roc_curve(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return sweep.select(
        *by, "threshold", F.try_divide(F.col("fp"), F.col("N")).alias("fpr"), F.try_divide(F.col("tp"), F.col("P")).alias("tpr")
    )


def _area_sums() -> list[Column]:
    """Sums from which the ROC area and its variance follow, ties counting one half."""
    below = (F.col("N") - F.col("fp") + 0.5 * F.col("neg")) / F.col("N")
    above = (F.col("tp") - 0.5 * F.col("pos")) / F.col("P")
    return [
        F.max("P").alias("P"), F.max("N").alias("N"),
        F.sum(F.col("pos") * below).alias("x1"), F.sum(F.col("pos") * below * below).alias("x2"),
        F.sum(F.col("neg") * above).alias("y1"), F.sum(F.col("neg") * above * above).alias("y2"),
    ]


def _defined(sweep: DataFrame) -> DataFrame:
    return sweep.filter((F.col("P") > 0) & (F.col("N") > 0))


def _placement(sweep: DataFrame, by: Sequence[str]) -> DataFrame:
    return _defined(sweep).groupBy(*by).agg(*_area_sums())


def auroc(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve; larger scores mean deferral."""
    return _placement(sweep, by).select(*by, (F.col("x1") / F.col("P")).alias("auroc"))


def auroc_ci(sweep: DataFrame, by: Sequence[str] = (), z: float = Z95) -> DataFrame:
    """Area with the DeLong interval, clipped to [0, 1]."""
    p = _placement(sweep, by)
    area = F.col("x1") / F.col("P")
    v1 = F.try_divide(F.col("x2") - F.col("x1") * F.col("x1") / F.col("P"), F.col("P") - 1)
    v2 = F.try_divide(F.col("y2") - F.col("y1") * F.col("y1") / F.col("N"), F.col("N") - 1)
    se = F.sqrt(F.greatest(v1 / F.col("P") + v2 / F.col("N"), F.lit(0.0)))
    return p.select(
        *by, F.greatest(area - z * se, F.lit(0.0)).alias("low"), area.alias("value"), F.least(area + z * se, F.lit(1.0)).alias("high")
    )


def pr_curve(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Recall and precision per threshold, and the prevalence a random score reaches."""
    return sweep.select(
        *by, "threshold", F.try_divide(F.col("tp"), F.col("P")).alias("recall"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide(F.col("P"), F.col("P") + F.col("N")).alias("baseline"),
    )


def _pr_area() -> Column:
    """Area of one segment of the precision-recall curve, times the number of positives.

    Between two operating points false positives grow linearly with true positives, so
    precision is a ratio of linear functions and its integral has a closed form. The
    earlier point of a segment is the current one minus the counts at its own score, so
    no neighbor row is needed.
    """
    gain, false0, true0 = F.col("pos"), F.col("fp") - F.col("neg"), F.col("tp") - F.col("pos")
    slope = 1.0 + F.col("neg") / F.col("pos")
    start = (true0 + false0).cast("double")
    straight = gain / slope
    bend = (true0 - start / slope) / slope * F.log((start + slope * gain) / start)
    return F.when(gain <= 0, 0.0).when(start <= 0, straight).otherwise(straight + bend)


def aupr(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the precision-recall curve with Davis-Goadrich interpolation."""
    return _defined(sweep).groupBy(*by).agg((F.sum(_pr_area()) / F.max("P")).alias("aupr"))


def f1_score(df: DataFrame, score: str, label: str, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    return cells_at(df, score, label, threshold, by).select(*by, _f1("tp", "fp", "fn").alias("f1"))


def mae_rmse(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE and RMSE in g/L and in mmol/L."""
    gap = F.col(actual) - F.col(predicted)
    one = df.groupBy(*by).agg(F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"))
    return one.withColumns({"mae_mmol": to_mmol("mae"), "rmse_mmol": to_mmol("rmse")})


def calibration_bins(df: DataFrame, score: str, label: str, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Observed rate and count in (0,.1], (.1,.2] ...; empty bins stay, with NULL rate."""
    place = F.ceil(F.col(score) * bins).cast("int")
    inside = df.filter((F.col(score) > 0) & (F.col(score) <= 1))
    counts = inside.groupBy(*by, place.alias("bin")).agg(
        F.avg(F.col(label).cast("double")).alias("rate"), F.count(F.lit(1)).alias("count")
    )
    numbers = F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin")
    frame = df.select(*by).distinct().select(*by, numbers) if by else df.sparkSession.range(1).select(numbers)
    return frame.join(counts, [*by, "bin"], "left").fillna(0, ["count"])


def dummy_classifiers(df: DataFrame, kind: str, label: str, seed: int = 1, key: str = "id", name: str = "score") -> DataFrame:
    """Scores that ignore the features.

    The prior and the most frequent class come from one small aggregate; the two random
    kinds draw from a seeded hash of the key.
    """
    share = df.agg(F.avg(F.col(label).cast("double")).alias("p")).scalar()
    if kind == "prior":
        score = share
    elif kind == "most_frequent":
        score = F.when(share >= 0.5, 1.0).otherwise(0.0)
    elif kind == "deferred":
        score = F.lit(1.0)
    elif kind == "uniform":
        score = uniform(seed, key)
    elif kind == "stratified":
        score = F.when(uniform(seed, key) < share, 1.0).otherwise(0.0)
    else:
        raise ValueError(f"unknown dummy classifier: {kind}")
    return df.withColumn(name, score)


# bootstrap


def _interval(value: Column, mean: Column, sd: Column, low: Column, high: Column, method: str) -> tuple[Column, Column]:
    if method == "norm":
        return 2 * value - mean - Z95 * sd, 2 * value - mean + Z95 * sd
    if method == "basic":
        return 2 * value - high, 2 * value - low
    if method == "perc":
        return low, high
    raise ValueError(f"unknown interval: {method}")


def intervals(replicates: DataFrame, full: DataFrame, names: Sequence[str], by: Sequence[str], method: str = "norm") -> DataFrame:
    """(by, variable, value, low, high) from one row per replicate and one per group.

    A statistic that is undefined in the data or in a replicate has NULL bounds. The
    number of replicates is a parameter, so the percentiles per group are bounded.
    """
    keys = list(by) or ["__all"]
    if not by:
        replicates, full = (d.withColumn("__all", F.lit(0)) for d in (replicates, full))
    long = replicates.unpivot([*keys, "replicate"], list(names), "variable", "__t")
    stats = long.groupBy(*keys, "variable").agg(
        F.avg("__t").alias("__mean"), F.stddev_samp("__t").alias("__sd"), F.count(F.lit(1)).alias("__n"),
        F.count("__t").alias("__known"), F.percentile("__t", 0.025).alias("__lo"), F.percentile("__t", 0.975).alias("__hi"),
    )
    point = full.unpivot(keys, list(names), "variable", "value")
    joined = point.join(stats, [*keys, "variable"])
    low, high = _interval(*[F.col(c) for c in ("value", "__mean", "__sd", "__lo", "__hi")], method)
    ok = F.col("__known") == F.col("__n")
    return joined.select(*by, "variable", "value", F.when(ok, low).alias("low"), F.when(ok, high).alias("high"))


def curve_areas(sweep: DataFrame, by: Sequence[str]) -> DataFrame:
    """AUPR and AUROC per group in one aggregate."""
    one = _defined(sweep).groupBy(*by).agg(*_area_sums(), F.sum(_pr_area()).alias("__pr"))
    return one.select(*by, (F.col("__pr") / F.col("P")).alias("AUPR"), (F.col("x1") / F.col("P")).alias("AUROC"))


def bootstrap_ci(
    df: DataFrame, statistic: str, score: str = "score", label: str = "label", by: Sequence[str] = (),
    threshold: float = 0.5, replicates: int = 2000, method: str = "norm", seed: int = 1,
) -> DataFrame:
    """Interval for ``f1``, ``aupr`` or ``auroc``, stratified by label; see ``resampling`` for the replicates."""
    if statistic == "f1":
        cells = cells_at(df, score, label, threshold, by)
        drawn = resampled_cells(cells, [("tp", "fn"), ("fp", "tn")], replicates, seed, by)
        t = drawn.select(*by, "replicate", _f1("tp", "fp", "fn").alias("F1"))
        return intervals(t, cells.select(*by, _f1("tp", "fp", "fn").alias("F1")), ["F1"], by, method)
    name = statistic.upper()
    counts = reliable_checkpoint(score_counts(df, score, label, by))
    t = resampled_areas(counts, replicates, seed, by, True).select(*by, "replicate", name)
    return intervals(t, curve_areas(sweep_counts(counts, by), by).select(*by, name), [name], by, method)


def cost_by_threshold(
    df: DataFrame, thresholds: Sequence[float], score: str = "score", label: str = "label", by: Sequence[str] = (),
    sex: str | Column = "both", p: Mapping[str, float] | None = None,
) -> DataFrame:
    """TPR, FPR, q, a and E for both new intervals at every threshold of a grid.

    Each row is placed once: counts per number of thresholds it reaches, then suffix sums
    over the grid, which has as many rows as thresholds.
    """
    grid = sorted(float(t) for t in thresholds)
    values = F.array(*[F.lit(t) for t in grid])
    reached = F.size(F.filter(values, lambda t: t <= F.col(score)))
    scores = score_counts(df, score, label, by).withColumnRenamed("threshold", score)
    placed = scores.groupBy(*by, reached.alias("reached")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # at most one cell per threshold and group from here on
    one = placed.groupBy(*by).agg(
        F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.collect_list(F.struct("reached", "pos", "neg")).alias("cells")
    )
    table = one.select(*by, "P", "N", "cells", F.posexplode(values).alias("i", "probability"))

    def at_least(name: str) -> Column:
        cells = F.filter("cells", lambda c: c["reached"] > F.col("i"))
        return F.aggregate(cells, F.lit(0).cast("long"), lambda total, c: total + c[name])

    table = table.select(
        *by, "probability", F.try_divide(at_least("pos"), F.col("P")).alias("TPR"), F.try_divide(at_least("neg"), F.col("N")).alias("FPR")
    )
    return cost_columns(table, "TPR", "FPR", "TPR", "FPR", sex, p)


def optimal_cost_threshold(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Thresholds with the lowest E6 and E12, the smallest threshold among equals."""
    def at(cost: str) -> Column:
        return F.min_by("probability", F.struct(cost, "probability"))
    known = table.filter(F.col("E6").isNotNull() & F.col("E12").isNotNull())
    return known.groupBy(*by).agg(
        at("E6").alias("threshold6"), at("E12").alias("threshold12"), F.min("E6").alias("E6"), F.min("E12").alias("E12")
    )


COST_MEASURES = ["E6", "E12", "a6", "a12", "q6", "q12", "TPR6", "TPR12", "FPR6", "FPR12", "F1", "AUPR", "AUROC"]


def cost_with_ci(
    df: DataFrame, identifier: str, thresholds: Sequence[float], score: str = "score", label: str = "label",
    p: Mapping[str, float] | None = None, replicates: int = 2000, method: str = "norm", seed: int = 1,
    f1_threshold: float = 0.5,
) -> DataFrame:
    """Long table (Id, variable, type, value): two thresholds, thirteen measures, bounds.

    ``identifier`` holds data-sex-model names. Rates at the two chosen thresholds and at the
    F1 threshold and the areas of a replicate come from the same weights: rows are drawn from
    all rows of a name, so class sizes vary.
    """
    by = [identifier]
    sex = F.get(F.split(F.col(identifier), "-", 3), 1)
    best = optimal_cost_threshold(cost_by_threshold(df, thresholds, score, label, by, sex, p), by)
    best = reliable_checkpoint(best)  # several joins below read it
    counts = score_counts(df, score, label, by).join(best.select(identifier, "threshold6", "threshold12"), identifier)
    counts = reliable_checkpoint(counts)
    cuts = {"6": F.col("threshold") >= F.col("threshold6"), "12": F.col("threshold") >= F.col("threshold12"), "1": F.col("threshold") >= F.lit(f1_threshold)}

    def measures(frame: DataFrame, *keep: str) -> DataFrame:
        wide = frame.select(
            *keep, *[F.try_divide(F.col(f"{side}_{n}"), F.col(of)).alias(f"{rate}{n}") for n in ("6", "12") for side, of, rate in (("tp", "P", "TPR"), ("fp", "N", "FPR"))],
            F.try_divide(2.0 * F.col("tp_1"), F.col("tp_1") + F.col("fp_1") + F.col("P")).alias("F1"),
        )
        return cost_columns(wide, "TPR6", "FPR6", "TPR12", "FPR12", sex, p)

    replicate_table = measures(resampled_areas(counts, replicates, seed, by, False, cuts), identifier, "replicate", "AUPR", "AUROC")
    whole = counts.groupBy(identifier).agg(
        F.sum("pos").alias("P"), F.sum("neg").alias("N"),
        *[F.sum(F.when(c, F.col(of)).otherwise(0)).alias(f"{side}_{n}") for n, c in cuts.items() for side, of in (("tp", "pos"), ("fp", "neg"))])
    point = measures(whole, identifier).join(curve_areas(sweep_counts(counts.select(identifier, "threshold", "pos", "neg"), by), by), identifier, "left")
    cis = intervals(replicate_table, point, COST_MEASURES, by, method)
    long = cis.unpivot([identifier, "variable"], ["value", "low", "high"], "type", "__v")
    cuts = best.unpivot([identifier], ["threshold6", "threshold12"], "variable", "__v").withColumn("type", F.lit("value"))
    return cuts.unionByName(long).withColumnRenamed("__v", "value")


def evaluation_summary(
    predictions: DataFrame, threshold: float, by: Sequence[str] = ("Id",), score: str = "score",
    label: str = "original_label", replicates: int = 2000, seed: int = 1, values: tuple[str, str] | None = None,
) -> DataFrame:
    """One row per group: errors, AUROC, AUPR and F1, each with its interval."""
    by = list(by)
    sweep = threshold_sweep(predictions, score, label, by)
    out = auroc_ci(sweep, by).select(
        *by, F.col("value").alias("AUROC value"), F.col("low").alias("AUROC low"), F.col("high").alias("AUROC high")
    )
    for name, statistic in (("AUPR", "aupr"), ("F1", "f1")):
        ci = bootstrap_ci(predictions, statistic, score, label, by, threshold, replicates, seed=seed)
        out = out.join(ci.select(*by, *[F.col(c).alias(f"{name} {c}") for c in ("value", "low", "high")]), by, "left")
    if values:
        errors = mae_rmse(predictions, values[0], values[1], by)
    else:
        errors = predictions.select(*by).distinct().select(*by, *[F.lit(None).cast("double").alias(c) for c in ("mae", "rmse", "mae_mmol", "rmse_mmol")])
    names = {"mae": "MAE (g / L)", "rmse": "RMSE (g / L)", "mae_mmol": "MAE (mmol / L)", "rmse_mmol": "RMSE (mmol / L)"}
    return out.join(errors.withColumnsRenamed(names), by, "left")


def prediction_table(predictions: DataFrame, seed: int = 1, identifiers: Sequence[str] = ("donor", "don_id", "id")) -> DataFrame:
    """Predictions without identifiers, in an order that a seeded hash of them decides."""
    present = [c for c in identifiers if c in predictions.columns]
    if not present:
        raise ValueError(f"one of {', '.join(identifiers)} must identify the rows to permute")
    shuffled = predictions.orderBy(F.xxhash64(F.lit(seed), *present))
    return shuffled.select(*[f"`{c}`" for c in predictions.columns if c not in present])
