"""Run chosen models for both sexes, one sex, or each sex on its own."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorflow.operators import describe, explain, metrics, models, posterior
from donorflow.operators.sampling import split_mode
from donorflow.operators.shape import union_results
from donorflow.plans.features import additional_preprocess
from donorflow.session import reliable_checkpoint, side_by_side

SEXES = {"pooled": ["both"], "stratified": ["male", "female"], "male": ["male"], "female": ["female"]}

Fit = Callable[[DataFrame, Sequence[str], int], models.Classifier]

# The classifiers a run can name. Each takes (train, features, seed).
CLASSIFIERS: dict[str, Fit] = {
    "bl": lambda train, features, seed: models.logistic_baseline(train),
    "dt": lambda train, features, seed: models.decision_tree(train, features, seed=seed),
    "rf": lambda train, features, seed: models.random_forest(train, features, seed=seed),
    "svm": lambda train, features, seed: models.svm_rbf(train, features, seed=seed),
}


class DrawnModel:
    """A mixed model that comes as a table of posterior draws (parameter, draw, value) beside fitted models.

    ``score`` is the share of predictive draws below the scaled cutoff. Rows may bring the mean
    and variance of their subject's effect; without them only the fixed part is known.
    """

    def __init__(self, draws: DataFrame, variables: Sequence[str], cutoff: float, n: int = 1000, seed: int = 1, key: str = "donor"):
        self.draws, self.features, self.cutoff, self.n, self.seed, self.key = draws, list(variables), cutoff, n, seed, key

    def predict(self, df: DataFrame) -> DataFrame:
        known = df.withColumns({c: F.lit(0.0) for c in ("effect_mean", "effect_var") if c not in df.columns})
        last = known.select(self.key, "effect_mean", "effect_var", *[F.col(v).cast("double").alias(v) for v in self.features])
        drawn = posterior.posterior_predictive(last, self.draws, self.features, self.n, self.seed, self.key)
        scores = posterior.deferral_probability(drawn, self.cutoff, by=[self.key])
        return df.drop("score").join(scores, self.key, "left")


@dataclass
class Fitted:
    """One model of a run on one sex, what it was fitted on and judged on, and how long the fit took."""

    name: str
    sex: str
    model: Any
    train: DataFrame
    test: DataFrame
    series: DataFrame
    threshold: float
    seconds: float

    @property
    def identifier(self) -> str:
        return f"{self.name}-{self.sex}"


def fit_models(
    features: DataFrame, names: Sequence[str], sexes: str, variables: Sequence[str], mode: str = "initial", seed: int = 42,
    classifiers: Mapping[str, Fit] | None = None, upsample: Callable[[DataFrame], DataFrame] | None = None,
) -> list[Fitted]:
    """Every chosen model for both sexes, one sex or each. The threshold is the one with the best F1 on the training rows."""
    available = {**CLASSIFIERS, **(classifiers or {})}
    keep = list(dict.fromkeys(["don_id", "donor", "sex", "label", "Hb", "Hb_deferral", *variables]))
    last = reliable_checkpoint(split_mode(additional_preprocess(features, [c for c in keep if c in features.columns]), mode))
    parts = {}
    for sex in SEXES[sexes]:
        rows = last if sex == "both" else last.filter(F.col("sex") == sex)
        series = features if sex == "both" else features.filter(F.col("sex") == sex)
        train, test = rows.filter(F.col("split") == "train"), rows.filter(F.col("split") == "test")
        parts[sex] = (upsample(train) if upsample else train, train, test, series)

    def fit(task: tuple[str, str]) -> Fitted:
        sex, name = task
        fitted_on, train, test, series = parts[sex]
        begun = time.monotonic()
        model = available[name](fitted_on, variables, seed)
        sweep = metrics.threshold_sweep(models.numeric_label(model.predict(train)), "score", "label_index")
        best: Any = metrics.optimal_f1_cut(sweep).first()
        return Fitted(name, sex, model, train, test, series, best["threshold"], time.monotonic() - begun)

    return side_by_side(features.sparkSession, fit, [(sex, name) for sex in SEXES[sexes] for name in names])


def model_by_sex_driver(
    features: DataFrame, names: Sequence[str], sexes: str, variables: Sequence[str], mode: str = "initial", seed: int = 42,
    classifiers: Mapping[str, Fit] | None = None, upsample: Callable[[DataFrame], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Predictions and table sizes of every model and sex, tagged ``Id = model-sex``."""
    done = fit_models(features, names, sexes, variables, mode, seed, classifiers, upsample)
    return {
        "prediction": union_results({f.identifier: models.predictions(f.model, f.test, f.name, f.threshold) for f in done}),
        "sizes": union_results({f.identifier: describe.data_counts(f.series, ["label"]) for f in done}),
    }


def result_tables(done: Sequence[Fitted], variables: Sequence[str], replicates: int = 2000, nsim: int = 100, seed: int = 42) -> dict[str, dict[str, DataFrame]]:
    """All nine result tables of a run, {kind: {Id: frame}}, for ``result_sink``.

    Attributions by sampling and importances by permutation are for classifiers; models that
    come as draws give effect sizes instead.
    """
    kinds = ("summary", "prediction", "sizes", "variable_summary", "histogram", "shap-value", "variable-importance", "effect-size", "timing")
    if not done:
        return {k: {} for k in kinds}
    spark = done[0].series.sparkSession

    def numeric(f: Fitted) -> DataFrame:
        return f.test.withColumns({v: F.col(v).cast("double") for v in variables})

    def described(f: Fitted) -> dict[str, DataFrame]:
        found = {
            "sizes": describe.data_counts(f.series, ["label"]),
            "variable_summary": describe.variable_summary(numeric(f), list(variables)),
            "histogram": describe.suppressed_histogram(numeric(f), list(variables)),
        }
        return {k: reliable_checkpoint(df) for k, df in found.items()}

    def judged(f: Fitted) -> dict[str, DataFrame]:
        predicted = reliable_checkpoint(models.predictions(f.model, f.test, f.name, f.threshold))
        scores = predicted.select(F.lit(f.name).alias("Model"), "original_label", "score")
        return {"prediction": predicted, "summary": metrics.evaluation_summary(scores, f.threshold, ["Model"], replicates=replicates, seed=seed)}

    def explained(f: Fitted) -> dict[str, DataFrame]:
        if isinstance(f.model, DrawnModel):
            return {"effect-size": posterior.posterior_effects(f.model.draws)}
        # read twice below, for the moments of the values and for the rows
        phi = reliable_checkpoint(explain.shap_sampling(f.model.predict, numeric(f), list(variables), "don_id", nsim=nsim, seed=seed))
        rows = models.numeric_label(numeric(f))
        return {
            "shap-value": explain.shap_long(phi, numeric(f), list(variables), "don_id", seed),
            "variable-importance": explain.permutation_importance(f.model.predict, rows, list(variables), "label_index", "don_id", seed),
        }

    # models of the same rows share their description
    first = {(id(f.series), id(f.test)): f for f in reversed(done)}
    calls = [(explained, f) for f in done] + [(judged, f) for f in done] + [(described, f) for f in first.values()]
    made = dict(zip(((call, id(f)) for call, f in calls), side_by_side(spark, lambda c: c[0](c[1]), calls)))
    out: dict[str, dict[str, DataFrame]] = {k: {} for k in kinds}
    for f in done:
        same = first[id(f.series), id(f.test)]
        tables = {**made[judged, id(f)], **made[described, id(same)], **made[explained, id(f)]}
        tables["timing"] = spark.range(1).select(F.lit("fit").alias("stage"), F.lit(float(f.seconds)).alias("seconds"))
        for kind, df in tables.items():
            out[kind][f.identifier] = df
    return out
