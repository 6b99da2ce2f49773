"""Mixed models from per-subject sums, and what follows from posterior draws."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from donorflow.operators.numbered import TASK_ROWS, looked_up, numbered, spread
from donorflow.operators.ordered import RunSum, Total, attach, gaussian, running
from donorflow.operators.scaling import Design, Scale, gram, unscaled
from donorflow.operators.shape import union_results
from donorflow.session import reliable_checkpoint

SHAPE = RATE = 0.01  # inverse gamma prior on every standard deviation


def _draw_sd(rng: np.random.Generator, squares: float, n: int) -> float:
    """One draw of a standard deviation given a sum of n squares, on a log grid."""
    centre = math.log(math.sqrt(max(squares, 1e-12) / max(n, 1)))
    width = 8.0 / math.sqrt(2.0 * max(n, 1))
    grid = np.linspace(centre - width, centre + width, 801)
    sd = np.exp(grid)
    # the last + grid turns the density of the sd into that of its logarithm
    logp = -n * grid - squares / (2 * sd**2) - (SHAPE + 1) * grid - RATE / sd + grid
    p = np.exp(logp - logp.max())
    return float(np.exp(rng.choice(grid, p=p / p.sum())))


def _draw_normal(rng: np.random.Generator, precision: np.ndarray, pull: np.ndarray) -> np.ndarray:
    """A draw of N(precision^-1 pull, precision^-1)."""
    chol = np.linalg.cholesky(precision)
    mean = np.linalg.solve(precision, pull)
    return mean + np.linalg.solve(chol.T, rng.standard_normal(len(pull)))


def _dot(columns: Sequence[str], weights: Sequence[float]) -> Column:
    return sum((F.col(c) * float(w) for c, w in zip(columns, weights)), F.lit(0.0))


def _weighted(weights: np.ndarray) -> Column:
    """Weighted sum of the array column v."""
    products = F.zip_with(F.col("v"), F.lit([float(w) for w in weights]), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def mixed_model(
    design: Design, iterations: int = 200, warmup: int = 100, seed: int = 1, dynamic: bool = False,
    chains: int = 1, donor: str = "donor",
) -> DataFrame:
    """Posterior draws (chain, parameter, draw, value) of a random-intercept model.

    y = x beta + b[donor] + eps; with ``dynamic`` the first event of a subject follows
    y = Z ups + theta b[donor] + eeta. Donor constants add C phi to both equations.
    Coefficients have N(0, 1) priors.

    Each subject is reduced once to a few sums, kept in memory. A Gibbs sweep is one
    aggregate over subjects: the effect b is a function of the sums, the parameters and a
    seeded hash, so nothing is carried between sweeps and a lost executor costs nothing.
    """
    spark = design.rows.sparkSession
    rows = design.rows.filter(F.col("split") == "train")
    constants, z = [], []
    if design.constants is not None:
        constants = [c for c in design.constants.columns if c != donor]
        rows = rows.join(design.constants, donor)
    x = [*design.variables, *constants]
    names = [f"__x{i}" for i in range(len(x))]
    shared = slice(len(design.variables), len(x))  # coefficients that the first event shares
    later = rows.filter(~F.col("is_first")) if dynamic else rows
    later = later.select(donor, "y", *[F.col(c).cast("double").alias(n) for c, n in zip(x, names)])
    xx, n_rows = gram(later, [*names, "y"])
    yy, xy, xx = xx[-1, -1], xx[:-1, -1], xx[:-1, :-1]
    stats = later.groupBy(donor).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("sy"), *[F.sum(c).alias(f"s{c}") for c in names]
    )
    sums = [f"s{c}" for c in names]
    own: list[str] = []  # per-subject values: first y, z, constants
    cnames = [f"__c{i}" for i in range(len(constants))]
    if dynamic:
        z = [c for c in design.first.columns if c not in (donor, "y")]
        znames = [f"__z{i}" for i in range(len(z))]
        first = design.first.join(design.constants, donor) if constants else design.first
        own = ["y1", *znames, *cnames]
        first = first.select(donor, *[F.col(c).cast("double").alias(n) for c, n in zip(["y", *z, *constants], own)])
        stats = first.join(stats, donor, "left").fillna(0.0)
    elif constants:
        own = cnames
        stats = stats.join(design.constants.select(donor, *[F.col(c).cast("double").alias(n) for c, n in zip(constants, own)]), donor)
    zi, ci = slice(1, 1 + len(z)), slice(len(own) - len(constants), len(own))
    full, first_n = gram(stats, own) if own else (None, 0)
    # n, sum y, sums of x [, first y, z, c], 1: every quantity of a sweep is a weighted sum of these
    parts = ["n", "sy", *sums, *own]
    stats = stats.select(donor, F.array(*[F.col(c) for c in parts], F.lit(1.0)).alias("v")).persist()
    donors = stats.count()
    place = {name: i for i, name in enumerate([*parts, "one"])}
    at_own = [place[c] for c in own]

    out = []
    for chain in range(chains):
        rng = np.random.default_rng([seed, chain])
        beta, sb, se = np.zeros(len(x)), 1.0, 1.0
        ups, theta, sh = np.zeros(len(z)), 1.0, 1.0
        for sweep in range(iterations):
            # weights travel as array literals, so that all sweeps share one compiled plan
            precision, pull = np.zeros(len(place)), np.zeros(len(place))
            precision[place["n"]], precision[place["one"]] = 1 / se**2, 1 / sb**2
            pull[place["sy"]] = 1 / se**2
            pull[[place[c] for c in sums]] = -beta / se**2
            if dynamic:
                precision[place["one"]] += theta**2 / sh**2
                pull[at_own] = theta / sh**2 * np.concatenate([[1.0], -ups, -beta[shared]])
            noise = gaussian(seed, F.lit([chain, sweep]), donor)
            effect = stats.select("v", _weighted(precision).alias("__p"), _weighted(pull).alias("__m"), noise.alias("__e"))
            effect = effect.select("v", (F.col("__m") / F.col("__p") + F.col("__e") / F.sqrt("__p")).alias("b"))
            b = F.col("b")

            def total(name: str) -> Column:
                return F.sum(b * F.get("v", F.lit(place[name])))

            aggs = [F.sum(b * b).alias("bb"), F.sum(b * b * F.get("v", F.lit(0))).alias("nbb"), total("sy").alias("by")]
            aggs += [total(c).alias(f"b{c}") for c in [*sums, *own]]
            one = effect.agg(*aggs).first()
            bb, bx, b_own = one["bb"], np.array([one[f"b{s}"] for s in sums]), np.array([one[f"b{c}"] for c in own])
            left, right = xx / se**2 + np.eye(len(x)), (xy - bx) / se**2
            if dynamic and constants:
                left[shared, shared] += full[ci, ci] / sh**2
                right[shared] += (full[ci, 0] - full[ci, zi] @ ups - theta * b_own[ci]) / sh**2
            beta = _draw_normal(rng, left, right)
            residual = yy - 2 * beta @ xy + beta @ xx @ beta - 2 * (one["by"] - beta @ bx) + one["nbb"]
            se = _draw_sd(rng, residual, n_rows)
            if constants:
                # constants and effects trade off; drawing phi again with their sum held mixes well
                old, cc = beta[shared].copy(), full[ci, ci]
                held = b_own[ci] + cc @ old
                left, right = cc / sb**2 + np.eye(len(old)), held / sb**2
                if dynamic:
                    left = left + (1 - theta) ** 2 * cc / sh**2
                    right = right + (1 - theta) * (full[ci, 0] - full[ci, zi] @ ups - theta * held) / sh**2
                beta[shared] = _draw_normal(rng, left, right)
                moved = old - beta[shared]
                bb = bb + 2 * moved @ b_own[ci] + moved @ cc @ moved
                b_own = b_own + full[:, ci] @ moved
            sb = _draw_sd(rng, bb, donors)
            if dynamic:
                # the first event without its constants, regressed on z and the effect
                weights = np.concatenate([[1.0], np.zeros(len(z)), -beta[shared]])
                moments = full @ weights
                bz, target = b_own[zi], np.append(moments[zi], b_own @ weights)
                inner = np.block([[full[zi, zi], bz[:, None]], [bz[None, :], np.array([[bb]])]])
                both = _draw_normal(rng, inner / sh**2 + np.eye(len(z) + 1), target / sh**2)
                ups, theta = both[:-1], float(both[-1])
                sh = _draw_sd(rng, weights @ moments - 2 * both @ target + both @ inner @ both, first_n)
            if sweep >= warmup:
                draw = sweep - warmup + 1
                kinds = ["beta"] * len(design.variables) + ["phi"] * len(constants)
                values = {f"{kind}[{c}]": v for kind, c, v in zip(kinds, x, beta)}
                values |= {"sigma_b": sb, "sigma_eps": se}
                if dynamic:
                    values |= {f"ups[{c}]": v for c, v in zip(z, ups)} | {"theta": theta, "sigma_eeta": sh}
                out += [(chain + 1, name, draw, float(v)) for name, v in values.items()]
    stats.unpersist()
    return spark.createDataFrame(out, "chain int, parameter string, draw int, value double")


def dynamic_mixed_model(design: Design, **options: Any) -> DataFrame:
    return mixed_model(design, dynamic=True, **options)


def model_list_reshape(draws: DataFrame, parameters: Sequence[str], keys: Sequence[str] = ("draw",)) -> DataFrame:
    """One row per draw, one column per parameter, with a stated list of parameters."""
    wanted = draws.filter(F.col("parameter").isin(list(parameters)))
    cells = [F.max(F.when(F.col("parameter") == p, F.col("value"))).alias(p) for p in parameters]
    return wanted.groupBy(*keys).agg(*cells)


def donor_effect_posterior(
    rows: DataFrame, beta: Mapping[str, float], sigma_b: float, sigma_eps: float, donor: str = "donor",
    order: Sequence[str] = ("dateonly", "don_id"), y: str = "y",
    first: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Mean and variance of the subject effect before each event, in closed form.

    Only earlier events count, so the two sums run to the row before. ``first`` (keys
    ``ups``, ``theta``, ``sigma_eeta``) makes the first event follow its own equation.
    """
    residual = F.col(y) - _dot(list(beta), list(beta.values()))
    loading, target = F.lit(1.0 / sigma_eps), residual / sigma_eps
    if first is not None:
        ups = first["ups"]
        first_target = (F.col(y) - _dot(list(ups), list(ups.values()))) / first["sigma_eeta"]
        loading = F.when(F.col("is_first"), first["theta"] / first["sigma_eeta"]).otherwise(loading)
        target = F.when(F.col("is_first"), first_target).otherwise(target)
    terms = rows.withColumns({"__xx": loading * loading, "__xy": loading * target})
    seen = attach(terms, donor, order, __sxx=RunSum("__xx", current=False), __sxy=RunSum("__xy", current=False))
    variance = 1.0 / (F.col("__sxx") + sigma_b**-2)
    return seen.withColumns({"effect_mean": variance * F.col("__sxy"), "effect_var": variance}).drop("__xx", "__xy", "__sxx", "__sxy")


def _with_draws(
    rows: DataFrame, draws: DataFrame, wanted: Mapping[str, tuple[str, str]], noises: Mapping[str, str], n: int, seed: int, key: str,
) -> DataFrame:
    """Each row ``n`` times (column draw), with a random draw of each wanted parameter and standard normal noises.

    ``wanted``: column name to (parameter, tag of the choice); ``noises``: column name to tag. Draws are
    numbered by value within their parameter. A repeated row chooses a number by a seeded hash and
    looks up the draw of that number (``looked_up``), so neither the draws nor their number is
    bounded. Rows are dealt over tasks by the draws they make.
    """
    ranked = reliable_checkpoint(running(draws.select("parameter", "value"), ["value"], ["parameter"], number=RunSum(F.lit(1).cast("long"))))
    parameters = sorted({p for p, _ in wanted.values()})
    sizes = ranked.agg(*[F.count(F.when(F.col("parameter") == p, 1)).alias(f"n{i}") for i, p in enumerate(parameters)]).first()
    rows = reliable_checkpoint(rows)
    rows = spread(rows, rows.count() * n, TASK_ROWS)
    places = {f"__of{name}": ([tag], []) for name, (_, tag) in wanted.items()}
    frame = numbered(rows, key, n, "draw", seed, places, {name: [tag] for name, tag in noises.items()})
    counts = {p: sizes[f"n{i}"] for i, p in enumerate(parameters)}
    together = sum(counts[p] for p, _ in wanted.values())
    for name, (parameter, _) in wanted.items():
        size = counts[parameter]
        frame = frame.withColumn("__chosen", F.floor(F.col(f"__of{name}") * size) + 1 if size else F.raise_error(F.lit(f"no draws of {parameter}")).cast("long"))
        one = ranked.filter(F.col("parameter") == parameter).select("number", F.col("value").alias(name))
        frame = looked_up(frame, "__chosen", one, "number", [name], together).drop("__chosen")
    return frame.drop(*places)


def posterior_predictive(
    last: DataFrame, draws: DataFrame, variables: Sequence[str], n: int = 1000, seed: int = 1, donor: str = "donor",
    z_variables: Sequence[str] = (), constants: Sequence[str] = (),
) -> DataFrame:
    """(donor, draw, y): draws of each subject's last event.

    ``last`` has the predictors, the constants, ``effect_mean`` and ``effect_var``. Parameters are drawn
    independently from their posterior draws, a table of (parameter, value).
    """
    groups = {"beta": variables, "ups": z_variables, "phi": constants}
    wanted = {f"__{g}_{v}": (f"{g}[{v}]", f"{g}{v}") for g, names in groups.items() for v in names} | {"__eps": ("sigma_eps", "eps")}
    if z_variables:
        wanted |= {"__theta": ("theta", "theta"), "__eeta": ("sigma_eeta", "eeta")}
    used = [donor, *[v for names in groups.values() for v in names], "effect_mean", "effect_var", *(["is_first"] if z_variables else [])]
    frame = _with_draws(last.select(*dict.fromkeys(used)), draws, wanted, {"__effect": "effect", "__noise": "noise"}, n, seed, donor)

    def total(group: str) -> Column:
        return sum((F.col(v) * F.col(f"__{group}_{v}") for v in groups[group]), F.lit(0.0))

    effect = F.col("effect_mean") + F.sqrt("effect_var") * F.col("__effect")
    noise = F.col("__noise")
    y = total("beta") + effect + F.col("__eps") * noise
    if z_variables:
        y = F.when(F.col("is_first"), total("ups") + F.col("__theta") * effect + F.col("__eeta") * noise).otherwise(y)
    return frame.select(donor, "draw", (y + total("phi")).alias("y"))


def delta_predictive(
    rows: DataFrame, draws: DataFrame, variables: Sequence[str], cutoff: float, n: int = 1000, seed: int = 1,
    key: str = "donor", effect: str = "u",
) -> DataFrame:
    """Change-model prediction: (x beta + u)(1 - delta) + delta * lagged Hb + noise.

    Returns the mean and the share of draws below the (scaled) cutoff per row.
    """
    wanted = {f"__beta_{v}": (f"beta[{v}]", v) for v in variables} | {"__delta": ("delta", "delta"), "__eps": ("sigma_eps", "eps")}
    used = rows.select(*dict.fromkeys([key, *variables, effect, "Hb_lag"]))
    frame = _with_draws(used, draws, wanted, {"__noise": "noise"}, n, seed, key)
    fit = sum((F.col(v) * F.col(f"__beta_{v}") for v in variables), F.col(effect))
    noise = F.col("__eps") * F.col("__noise")
    drawn = frame.withColumn("__y", fit * (1 - F.col("__delta")) + F.col("__delta") * F.col("Hb_lag") + noise)
    return drawn.groupBy(key).agg(F.avg("__y").alias("mean"), F.avg((F.col("__y") < cutoff).cast("double")).alias("p"))


def deferral_probability(pred: DataFrame, cutoff: float | Column, scale: Scale | None = None, y: str = "y",
                         by: Sequence[str] = ("donor",), name: str = "Hb") -> DataFrame:
    """Share of predictive draws below the cutoff, given in the original unit."""
    limit = cutoff if isinstance(cutoff, Column) else F.lit(float(cutoff))
    if scale is not None:
        mean, sd = scale.means[name], scale.sds[name]
        limit = (limit - mean) / (scale.factor * sd) if sd > 0 else limit - mean
    return pred.groupBy(*by).agg(F.avg((F.col(y) < limit).cast("double")).alias("score"))


def prediction_frame(
    pred: DataFrame, actual: DataFrame, cutoff: Column | float, scale: Scale, metric: str = "mean",
    threshold: float = 0.5, key: str = "donor", name: str = "Hb",
) -> DataFrame:
    """Point prediction, spread, score and labels per subject.

    ``actual`` has ``original_value`` and the columns the cutoff needs. The quantile (5 percent,
    type 7) comes from the places of a subject's draws in their order, two of which are kept.
    """
    cutoff = cutoff if isinstance(cutoff, Column) else F.lit(float(cutoff))
    mean, sd = scale.means[name], scale.sds[name]
    original = unscaled("y", mean, sd, scale.factor)
    drawn = pred.join(actual.select(key, cutoff.alias("cutoff"), "original_value"), key)
    out = drawn.groupBy(key).agg(
        F.first("original_value").alias("original_value"), F.first("cutoff").alias("cutoff"), F.avg("y").alias("__m"),
        F.stddev_samp("y").alias("sds"), F.avg((original < F.col("cutoff")).cast("double")).alias("score"), F.count("y").alias("__n"),
    )
    if metric != "mean":
        places = pred.filter(F.col("y").isNotNull()).select(key, "y", F.row_number().over(Window.partitionBy(key).orderBy("y")).alias("__i"))
        spot = (F.col("__n") - 1) * 0.05
        low = F.floor(spot) + 1
        at = places.join(out.select(key, "__n"), key).filter(F.col("__i").between(low, low + 1))
        ends = at.groupBy(key).agg(F.min("y").alias("__low"), F.max("y").alias("__high"), F.first(spot - F.floor(spot)).alias("__part"))
        out = out.join(ends, key, "left").withColumn("__m", F.col("__low") + (F.col("__high") - F.col("__low")) * F.col("__part"))
    value = unscaled("__m", mean, sd, scale.factor)
    return out.select(
        key, "original_value", (F.col("original_value") < F.col("cutoff")).cast("int").alias("original_label"), "score", "sds",
        value.alias("predicted_value"), (value < F.col("cutoff")).cast("int").alias("predicted_label"),
        F.lit(threshold).alias("f1_threshold"), (F.col("score") >= threshold).cast("int").alias("score_predicted_label"),
    )


def posterior_effects(draws: DataFrame, level: float = 0.95, by: Sequence[str] = ("parameter",), key: str = "draw",
                      chunk_rows: int | None = None) -> DataFrame:
    """Mean and highest-density interval per parameter.

    The interval is the narrowest one that spans ceil(level n) steps of the sorted draws.
    Ranks are exact and distributed; each draw meets the one that many ranks later.
    """
    by = list(by)
    one = F.lit(1).cast("long")
    ranked = running(draws.select(*by, key, "value"), ["value", key], by, chunk_rows, i=RunSum(one), n=Total(one))
    sizes = draws.groupBy(*by).agg(F.avg("value").alias("mean"))
    step = F.ceil(F.lit(level) * F.col("n"))
    start = ranked.select(*by, "i", F.col("value").alias("low"), (F.col("i") + step).alias("j"))
    ends = ranked.select(*by, F.col("i").alias("j"), F.col("value").alias("high"))
    spans = start.join(ends, [*by, "j"])
    widths = spans.groupBy(*by, (F.col("high") - F.col("low")).alias("width")).agg(
        F.min("i").alias("a"), F.max("i").alias("b"), F.count(F.lit(1)).alias("c")
    )
    best = widths.groupBy(*by).agg(F.min_by(F.struct("a", "b", "c"), "width").alias("w"))
    run = F.col("w.b") - F.col("w.a") + 1 == F.col("w.c")
    chosen = best.select(*by, F.when(run, F.floor((F.col("w.a") + F.col("w.b")) / 2)).otherwise(F.col("w.b")).alias("i"))
    found = spans.join(chosen, [*by, "i"]).select(*by, "low", "high")
    return sizes.select(*by, "mean").join(found, by, "left")


def parameter_cis(draws: DataFrame, digits: int = 3, by: Sequence[str] = ("parameter",)) -> DataFrame:
    """95 percent interval of the mean per parameter (Student quantile by expansion)."""
    z = 1.959963984540054
    one = draws.groupBy(*by).agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count(F.lit(1)).alias("n"))
    v = F.col("n") - 1
    t = z + (z**3 + z) / (4 * v) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v * v)
    half = t * F.col("s") / F.sqrt("n")
    return one.select(
        *by, F.round("m", digits).alias("mean"), F.round(F.col("m") - half, digits).alias("low"),
        F.round(F.col("m") + half, digits).alias("high"),
    )


def combine_posteriors(folds: Mapping[str, DataFrame], level: float = 0.95) -> DataFrame:
    """Effects of the stacked draws of several folds."""
    stacked = union_results(folds, "fold").withColumn("draw", F.concat_ws("-", "fold", F.col("draw").cast("string")))
    return posterior_effects(stacked, level)


def rhat(draws: DataFrame) -> DataFrame:
    """Split-chain potential scale reduction per parameter."""
    sizes = draws.groupBy("parameter", "chain").agg(F.max("draw").alias("last"))
    halves = draws.join(sizes, ["parameter", "chain"])
    half = F.when(F.col("draw") <= F.floor(F.col("last") / 2), 1).otherwise(2)
    per = halves.groupBy("parameter", "chain", half.alias("half")).agg(
        F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count(F.lit(1)).alias("n")
    )
    one = per.groupBy("parameter").agg(F.avg("v").alias("w"), F.var_samp("m").alias("bm"), F.avg("n").alias("n"))
    spread = (F.col("n") - 1) / F.col("n") * F.col("w") + F.col("bm")
    return one.select("parameter", F.sqrt(F.try_divide(spread, F.col("w"))).alias("rhat"))


def effect_size_by_sex(male: DataFrame, female: DataFrame, importance: DataFrame, variables: DataFrame) -> DataFrame:
    """Effects of both sexes and importances on one list of variables (Pretty, place)."""
    effects = union_results({"male": male, "female": female}, "sex").withColumn("method", F.lit("Regression coefficient"))
    known = F.col("Importance").isNotNull()
    shown = importance.select(
        "Pretty", F.col("Importance").alias("mean"), F.when(known, F.lit(0.0)).alias("low"), F.col("Importance").alias("high"),
        F.lit("both").alias("sex"), F.lit("Importance").alias("method"),
    )
    stacked = effects.select("Pretty", "mean", "low", "high", "sex", "method").unionByName(shown)
    return variables.join(stacked, "Pretty", "left")


def last_rows(df: DataFrame, donor: str, order: Sequence[str]) -> DataFrame:
    """Rows in last place of each subject's order."""
    from donorflow.operators.series import holdout_last_event

    return holdout_last_event(df.drop("split"), donor, order).filter(F.col("split") == "test")
