"""Classifiers on Spark ML, tuning, out-of-fold predictions and stored models."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from typing import Any

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from donorflow.operators import pruning
from donorflow.operators.forests import forest_score
from donorflow.operators.joins import attach_metadata
from donorflow.operators.ordered import hash_ranks
from donorflow.operators.ordering import nearest_value
from donorflow.operators.sampling import kfold_by_donor
from donorflow.operators.scaling import Scale, column_scale, scaled
from donorflow.operators.shape import axis, union_results
from donorflow.session import reliable_checkpoint, side_by_side

LABEL = "Hb_deferral"


def numeric_label(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Deferred / TRUE / 1 to 1.0, everything else to 0.0."""
    kind = dict(df.dtypes)[label]
    value = (F.col(label) == "Deferred") if kind == "string" else F.col(label).cast("double")
    return df.withColumn("label_index", value.cast("double"))


def _numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


class Classifier:
    """A fitted model and the columns it needs; ``predict`` adds ``score``."""

    def __init__(self, model: Any, features: Sequence[str], score: Callable[[DataFrame], DataFrame]):
        self.model, self.features, self._score = model, list(features), score

    def predict(self, df: DataFrame) -> DataFrame:
        return self._score(df)


def _tree_score(model: PipelineModel, features: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    def score(df: DataFrame) -> DataFrame:
        keep = df.columns
        out = model.transform(_numbers(df, features))
        return out.withColumn("score", vector_to_array("probability")[1]).select(*[c for c in keep if c != "score"], "score")
    return score


def _fit_pipeline(train: DataFrame, features: Sequence[str], estimator: Any) -> Classifier:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    model = Pipeline(stages=[assembler, estimator]).fit(_numbers(train, features))
    return Classifier(model, features, _tree_score(model, features))


def logistic_baseline(train: DataFrame, x: str = "previous_Hb", label: str = LABEL) -> Classifier:
    """Deferral from the previous Hb: unregularized binomial regression."""
    glm = GeneralizedLinearRegression(family="binomial", link="logit", labelCol="label_index", maxIter=50, tol=1e-10)
    assembler = VectorAssembler(inputCols=[x], outputCol="features")
    model = Pipeline(stages=[assembler, glm]).fit(_numbers(numeric_label(train, label), [x]))
    fitted = model.stages[-1]
    slope, intercept = float(fitted.coefficients[0]), float(fitted.intercept)

    def score(df: DataFrame) -> DataFrame:
        return df.withColumn("score", 1.0 / (1.0 + F.exp(-(F.lit(intercept) + slope * F.col(x).cast("double")))))

    out = Classifier(model, [x], score)
    out.slope, out.intercept = slope, intercept
    return out


def baseline_lookup(model: Classifier, df: DataFrame, threshold: float, low: int = 100, high: int = 200) -> DataFrame:
    """The previous Hb in low..high whose probability is nearest the threshold."""
    grid = axis(df.sparkSession, model.features[0], float(low), float(high), high - low + 1)
    return nearest_value(model.predict(grid), "score", threshold, model.features[0])


def decision_tree(train: DataFrame, features: Sequence[str], label: str = LABEL, seed: int = 1, **options: Any) -> Classifier:
    options = {"maxDepth": 5, "impurity": "gini", **options}
    return _fit_pipeline(numeric_label(train, label), features, DecisionTreeClassifier(labelCol="label_index", seed=seed, **options))


COMPLEXITIES = tuple(np.linspace(0.0001, 0.04, 10))


def folded_balance(df: DataFrame, label: str, key: str, row: str, folds: int, seed: int) -> tuple[DataFrame, dict[tuple[int, float], int]]:
    """Rows with ``fold`` (by subject) and their place among those of their fold and class; and the size of each such cell."""
    ranked = hash_ranks(df.select(key).distinct(), key, seed)
    placed = df.join(ranked.select(key, (F.col("rank") % folds).cast("int").alias("fold")), key)
    placed = reliable_checkpoint(hash_ranks(placed, row, seed, ["fold", label], rank="place", size="of"))
    sizes = {(r["fold"], r[label]): r["n"] for r in placed.groupBy("fold", label).agg(F.count(F.lit(1)).alias("n")).collect()}
    return placed.drop("of"), sizes


def balanced_without(placed: DataFrame, sizes: Mapping[tuple[int, float], int], fold: int, label: str) -> DataFrame:
    """Training rows of a fold, the smaller class repeated until both are equal in number.

    Copies are made after the folds, so no row and no copy of it is on both sides. Each row of
    the smaller class comes floor(N / P) times, and the first N mod P of them once more.
    """
    train = placed.filter(F.col("fold") != fold)
    totals: dict[float, int] = {}
    for (f, c), n in sizes.items():
        totals[c] = totals.get(c, 0) + (n if f != fold else 0)
    if len(totals) < 2 or not all(totals.values()):
        return train
    small = min(totals, key=lambda c: (totals[c], c))
    times, rest = divmod(max(totals.values()), totals[small])
    before, upto = F.lit(0), 0
    for f in sorted({f for f, _ in sizes} - {fold}):
        before = F.when(F.col("fold") == f, F.lit(upto)).otherwise(before)
        upto += sizes.get((f, small), 0)
    copies = F.when(F.col(label) == small, F.lit(times) + (before + F.col("place") <= rest).cast("int")).otherwise(1)
    return train.withColumn("__copy", F.explode(F.sequence(F.lit(1), copies))).drop("__copy")


def pruned_tree(
    train: DataFrame, features: Sequence[str], label: str = LABEL, key: str = "donor", row: str = "don_id",
    values: Sequence[float] = COMPLEXITIES, folds: int = 4, repeats: int = 5, seed: int = 1, depth: int = 6,
) -> tuple[Classifier, list[dict[str, float]]]:
    """A gini tree whose complexity is chosen by repeated cross-validation on AUROC; (model, table of complexities).

    Training rows are balanced by copies inside each fold. Each fit gives the scores of all
    complexities from its leaf counts (see ``pruning``); of equal areas the simplest tree wins.
    """
    values = sorted(float(v) for v in values)
    frame = numeric_label(train, label).filter(F.col("label_index").isNotNull())
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    data = assembler.transform(_numbers(frame, features)).select(key, row, "features", "label_index")
    estimator = DecisionTreeClassifier(labelCol="label_index", seed=seed, maxDepth=depth, impurity="gini", leafCol="leaf")

    def scores(rows: DataFrame) -> tuple[Any, Any, np.ndarray]:
        model = estimator.fit(rows)
        root = pruning.branches(model)
        return model, root, pruning.pruned_scores(root, pruning.counted(root, model.transform(rows)), values)

    areas = []
    for r in range(repeats):
        placed, sizes = folded_balance(data, "label_index", key, row, folds, seed + r)
        for fold in range(folds):
            model, root, table = scores(balanced_without(placed, sizes, fold, "label_index"))
            held = pruning.counted(root, model.transform(placed.filter(F.col("fold") == fold)))
            counts = np.array([held[i] for i in range(len(held))])
            areas.append([pruning.ranked_area(t, counts[:, 1], counts[:, 0]) for t in table])
    mean = np.nanmean(np.array(areas), axis=0)
    best = max(i for i, m in enumerate(mean) if m >= np.nanmax(mean) - 1e-12)
    placed, sizes = folded_balance(data, "label_index", key, row, 1, seed)
    model, root, table = scores(balanced_without(placed, sizes, -1, "label_index"))
    shares = F.array(*[F.lit(float(x)) for x in table[best]])  # one number a leaf

    def score(df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns if c != "score"]
        out = model.transform(assembler.transform(_numbers(df, features)))
        return out.withColumn("score", F.get(shares, F.col("leaf").cast("int"))).select(*keep, "score")

    return Classifier(model, features, score), [{"complexity": v, "auroc": float(m), "chosen": float(i == best)} for i, (v, m) in enumerate(zip(values, mean, strict=True))]


ROWS_OF_TREES = 2_000_000  # rows times trees from which a fit is dealt over more tasks
TASKS_A_CORE = 2  # at most, since each task of a fit sends the counts of all its nodes


def _dealt(rows: DataFrame, used: Sequence[str], trees: int) -> DataFrame:
    """Rows dealt over tasks by rows times trees, with the used columns: their bytes alone would put a forest into one task.

    Fewer rows stay as they are, since a forest's draws depend on the order of its rows.
    """
    work = math.ceil(rows.count() * trees / ROWS_OF_TREES)
    if work <= 1:
        return rows
    most = max(24, TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism)
    return rows.select(*dict.fromkeys([*used, "label_index"])).repartition(min(work, most))


def random_forest(
    train: DataFrame, features: Sequence[str], label: str = LABEL, seed: int = 1, trees: int = 500, mtry: int | str = "sqrt",
    min_node: int = 1, split_rule: str = "gini", weight: str | None = None, depth: int = 10, bins: int = 32,
) -> Classifier:
    """Probability forest; split rules other than gini map to entropy. Rows are dealt over tasks by the trees they go through."""
    forest = RandomForestClassifier(
        labelCol="label_index", seed=seed, numTrees=trees, featureSubsetStrategy=str(mtry), minInstancesPerNode=min_node,
        impurity="gini" if split_rule == "gini" else "entropy", maxDepth=depth, maxBins=bins,
    )
    if weight:
        forest = forest.setWeightCol(weight)
    fitted = _fit_pipeline(_dealt(numeric_label(train, label), [label, *features, *([weight] if weight else [])], trees), features, forest)
    fast = forest_score(fitted.model.stages[-1], features)
    return Classifier(fitted.model, features, fast) if fast else fitted


def weighted_forest(train: DataFrame, features: Sequence[str], weight: str = "weight", **options: Any) -> Classifier:
    return random_forest(train, features, weight=weight, **options)


def fourier_columns(df: DataFrame, features: Sequence[str], scale: Scale, sigma: float, size: int, seed: int) -> DataFrame:
    """Random Fourier features of the radial kernel exp(-sigma |x - y|^2), as column maths."""
    rng = np.random.default_rng(seed)
    w = rng.normal(scale=np.sqrt(2 * sigma), size=(size, len(features)))
    shift = rng.uniform(0, 2 * np.pi, size)
    x = F.array(*[scaled(F.col(f).cast("double"), scale.means[f], scale.sds[f], scale.factor) for f in features])
    frame = df.withColumn("__x", x)
    weights = F.from_json(F.lit(str([list(map(float, r)) for r in np.column_stack([w, shift])])), "array<array<double>>")

    def wave(r):
        inner = F.aggregate(F.zip_with(F.col("__x"), F.slice(r, 1, len(features)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return F.cos(inner + F.get(r, F.lit(len(features)))) * float(np.sqrt(2.0 / size))

    return frame.withColumn("features", array_to_vector(F.transform(weights, wave))).drop("__x")


def svm_rbf(
    train: DataFrame, features: Sequence[str], label: str = LABEL, sigma: float = 0.1, C: float = 1.0, size: int = 64,
    seed: int = 1, iterations: int = 50,
) -> Classifier:
    """Radial SVM on centered, scaled features; the score is the decision value."""
    scale = column_scale(train, features, factor=1.0)
    frame = fourier_columns(numeric_label(train, label), features, scale, sigma, size, seed)
    rows = frame.count()
    svc = LinearSVC(labelCol="label_index", maxIter=iterations, regParam=1.0 / (C * max(rows, 1)), standardization=False)
    model = svc.fit(frame.select("features", "label_index"))

    def score(df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns if c != "score"]
        out = model.transform(fourier_columns(df, features, scale, sigma, size, seed))
        return out.withColumn("score", vector_to_array("rawPrediction")[1]).select(*keep, "score")

    return Classifier(model, features, score)


def grid_search_cv(
    train: DataFrame, features: Sequence[str], estimator: Any, grid: Mapping[str, Sequence[Any]], label: str = LABEL,
    key: str = "donor", folds: int = 10, repeats: int = 10, seed: int = 1, parallelism: int = 4, row: str = "don_id",
) -> tuple[DataFrame, dict[str, Any]]:
    """Repeated cross-validation on AUROC over a parameter grid, folds by subject.

    Inside each fold the training rows of the smaller class are repeated until both classes
    are equal; the rows that are scored stay as they are. Returns (table of parameters and
    mean AUROC, best parameters).
    """
    frame = numeric_label(train, label).filter(F.col("label_index").isNotNull())
    data = VectorAssembler(inputCols=list(features), outputCol="features").transform(_numbers(frame, features))
    data = reliable_checkpoint(data.select(key, row, "features", "label_index"))  # every repeat reads it
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    maps = builder.build()
    estimator.setLabelCol("label_index")
    evaluator = BinaryClassificationEvaluator(labelCol="label_index", rawPredictionCol="rawPrediction", metricName="areaUnderROC")

    def area(scored: DataFrame) -> float:
        if not isinstance(estimator, DecisionTreeClassifier):
            return evaluator.evaluate(scored)
        # a tree has few scores: one aggregate instead of the sort of all rows that the evaluator makes
        hits = [F.count(F.when(F.col("label_index") == c, 1)).alias(n) for n, c in (("pos", 1.0), ("neg", 0.0))]
        cells = scored.groupBy(F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("s")).agg(*hits).collect()
        if any(r["s"] is None for r in cells) or not (sum(r["pos"] for r in cells) and sum(r["neg"] for r in cells)):
            return evaluator.evaluate(scored)
        return pruning.ranked_area(*(np.array([r[n] for r in cells], dtype=float) for n in ("s", "pos", "neg")))

    sums = np.zeros(len(maps))
    spark = train.sparkSession
    for r in range(repeats):
        placed, sizes = folded_balance(data, "label_index", key, row, folds, seed + r)

        def areas(fold: int) -> list[float]:
            rows = balanced_without(placed, sizes, fold, "label_index").select("features", "label_index").persist()
            held = placed.filter(F.col("fold") == fold)
            found = [area(estimator.copy(m).fit(rows).transform(held)) for m in maps]
            rows.unpersist()
            return found

        for found in side_by_side(spark, areas, range(folds), parallelism):
            sums += np.array(found)
    rows = [{**{p.name: str(v) for p, v in m.items()}, "auroc": float(s / repeats / folds)} for m, s in zip(maps, sums)]
    best = maps[int(np.argmax(sums))]
    return train.sparkSession.createDataFrame(rows), {p.name: v for p, v in best.items()}


def kfold_fit(
    df: DataFrame, fit: Callable[[DataFrame], Classifier], k: int = 4, seed: int = 1, key: str = "donor",
) -> DataFrame:
    """Out-of-fold predictions: one Spark fit per fold of subjects, stacked."""
    folded = reliable_checkpoint(kfold_by_donor(df, key, k, seed))
    parts = {}
    for fold in range(k):
        model = fit(folded.filter(F.col("fold") != fold))
        parts[str(fold)] = model.predict(folded.filter(F.col("fold") == fold))
    return union_results(parts, "fold_id")


def fold_errors(oof: DataFrame, actual: str, predicted: str, fold: str = "fold") -> DataFrame:
    """Errors averaged over folds."""
    from donorflow.operators.metrics import mae_rmse

    per = mae_rmse(oof, actual, predicted, [fold])
    return per.agg(*[F.avg(c).alias(c) for c in ("mae", "rmse", "mae_mmol", "rmse_mmol")])


def predictions(model: Classifier, df: DataFrame, name: str, threshold: float, key: str = "donor", label: str = LABEL,
                value: str = "Hb") -> DataFrame:
    """The common prediction schema."""
    scored = model.predict(numeric_label(df, label))
    sex = F.col("sex") if "sex" in df.columns else F.lit("both")
    hit = (F.col("score") >= threshold).cast("int")
    return scored.select(
        F.col(key).cast("string").alias("id"), F.lit(name).alias("model"), sex.alias("sex"),
        F.col("label_index").cast("int").alias("original_label"), hit.alias("predicted_label"), "score",
        F.lit(float(threshold)).alias("f1_threshold"), hit.alias("score_predicted_label"),
        (F.col(value) if value in df.columns else F.lit(None)).cast("double").alias("original_value"),
        F.lit(None).cast("double").alias("predicted_value"),
    )



def save_model(model: Classifier, folder: str, name: str, sex: str) -> str:
    """Store a pipeline as {folder}/{name}-{sex}; it holds no rows of the training data."""
    path = f"{folder}/{name}-{sex}"
    model.model.write().overwrite().save(path)
    return path


def append_prefitted(df: DataFrame, stored: Mapping[tuple[str, str], str], wanted: Sequence[tuple[str, str]],
                     features: Sequence[str]) -> DataFrame:
    """Score a new table with stored (model, sex) pipelines, after checking coverage."""
    missing = sorted(set(wanted) - set(stored))
    if missing:
        raise ValueError(f"no stored model for: {', '.join('-'.join(m) for m in missing)}")
    parts = {}
    for name, sex in wanted:
        model = PipelineModel.load(stored[(name, sex)])
        rows = df if sex == "both" else df.filter(F.col("sex") == sex)
        parts[f"{name}-{sex}"] = _tree_score(model, features)(rows)
    return union_results(parts)
