"""Scaling, designs, fits and predictions."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from donorflow.catalog.bindings import DONATIONS, DRAWS, FEATURES, JOINED, query, r6

from donorflow.operators import models, ordered, posterior, sampling, scaling
from donorflow.operators.scaling import Scale
from donorflow.plans.driver import DrawnModel, fit_models, result_tables
from donorflow.plans.features import Settings, additional_preprocess, whole_series_features
from donorflow.operators.shape import union_results
from donorflow.session import reliable_checkpoint, workspace
from donorflow.sources.delimited import load_results, result_sink

ORDER = ("dateonly", "don_id")
VARIABLES = ["previous_Hb", "days_to_previous_fb", "age", "previous_Hb_def", "warm_season", "consecutive_deferrals", "recent_donations", "recent_deferrals"]
DESIGN = ["days_to_previous_fb", "age", "previous_Hb_def", "warm_season", "recent_donations"]


def features(t):
    """The feature table, written for the several passes a design or a fit makes."""
    return reliable_checkpoint(whole_series_features(t.raw_donations(), t.raw_donors(), Settings(), check=False))


def known(df):
    """Rows that have every model variable."""
    return df.filter(~F.col("first_event"))


@query("standardize_2sd", f"""WITH {DONATIONS}, s AS (SELECT avg(Hb) AS m, stddev_samp(Hb) AS s, avg(volume_drawn) AS vm, stddev_samp(volume_drawn) AS vs FROM donations)
SELECT don_id, round((Hb - m) / (2 * s), 6) AS Hb, round((volume_drawn - vm) / (2 * vs), 6) AS volume_drawn, 0.0::DOUBLE AS fixed FROM donations, s""")
def _(t):
    out, _ = scaling.standardize_2sd(t.donations().withColumn("fixed", F.lit(500.0)), ["Hb", "volume_drawn", "fixed"])
    return out.select("don_id", r6("Hb").alias("Hb"), r6("volume_drawn").alias("volume_drawn"), "fixed")


@query("standardize_with_train", f"""WITH {JOINED}, s AS (SELECT avg(Hb) AS m, stddev_samp(Hb) AS s FROM joined WHERE label = 'train') SELECT don_id, round((Hb - m) / (2 * s), 6) AS Hb FROM joined, s WHERE label = 'test'""")
def _(t):
    j = t.joined()
    scale = scaling.column_scale(j.filter("label = 'train'"), ["Hb"])
    return scaling.standardize_with_train(j.filter("label = 'test'"), scale).select("don_id", r6("Hb").alias("Hb"))


@query("denormalize", f"WITH {DONATIONS} SELECT don_id, round(Hb, 6) AS Hb FROM donations")
def _(t):
    out, scale = scaling.standardize_2sd(t.donations(), ["Hb"])
    return scaling.denormalize(out, scale, ["Hb"]).select("don_id", r6("Hb").alias("Hb"))


def _scaled_sql(name, factor=2):
    return f"round(({name} - avg(CASE WHEN split = 'train' THEN {name} END) OVER ()) / ({factor} * stddev_samp(CASE WHEN split = 'train' THEN {name} END) OVER ()), 6)"


_SPLIT = "CASE WHEN row_number() OVER (PARTITION BY donor ORDER BY dateonly DESC, don_id DESC) = 1 THEN 'test' ELSE 'train' END AS split"
_LMM = f"""WITH {FEATURES}, d AS (SELECT *, {_SPLIT}, count(*) OVER (PARTITION BY donor) AS cnt FROM features WHERE NOT first_event), k AS (SELECT * FROM d WHERE cnt >= 2)"""


@query("lmm_design", f"""{_LMM} SELECT don_id, split, {_scaled_sql('Hb')} AS y, {_scaled_sql('days_to_previous_fb')} AS days, {_scaled_sql('age')} AS age,
  CAST(CAST(previous_Hb_def AS INTEGER) AS DOUBLE) AS def, {_scaled_sql('warm_season')} AS warm, {_scaled_sql('recent_donations')} AS recent FROM k""")
def _(t):
    d = scaling.lmm_design(features(t), DESIGN)
    return d.rows.select("don_id", "split", r6("y").alias("y"), r6("days_to_previous_fb").alias("days"), r6("age").alias("age"),
                         F.col("previous_Hb_def").alias("def"), r6("warm_season").alias("warm"), r6("recent_donations").alias("recent"))


@query("dlmm_design", f"""WITH {FEATURES}, d AS (SELECT *, {_SPLIT}, count(*) OVER (PARTITION BY donor) AS cnt, row_number() OVER (PARTITION BY donor ORDER BY dateonly, don_id) AS i FROM features), k AS (SELECT * FROM d WHERE cnt >= 3)
SELECT don_id, split, i = 1 AS is_first, {_scaled_sql('Hb')} AS y, coalesce({_scaled_sql('days_to_previous_fb')}, 0) AS days, {_scaled_sql('previous_Hb')} AS previous,
  coalesce(CAST(CAST(previous_Hb_def AS INTEGER) AS DOUBLE), 0) AS def, {_scaled_sql('hour + age')} AS z FROM k""")
def _(t):
    f = features(t).withColumn("z", F.col("hour") + F.col("age"))
    d = scaling.dlmm_design(f, ["days_to_previous_fb", "previous_Hb", "previous_Hb_def"], z_variables=["z", "age"])
    return d.rows.select("don_id", "split", "is_first", r6("y").alias("y"), r6("days_to_previous_fb").alias("days"), r6("previous_Hb").alias("previous"),
                         F.col("previous_Hb_def").alias("def"), r6("z").alias("z"))


@query("delta_design", f"""WITH {FEATURES}, d AS (SELECT *, {_SPLIT}, count(*) OVER (PARTITION BY donor) AS cnt FROM features), k AS (SELECT * FROM d WHERE cnt >= 2)
SELECT don_id, split, {_scaled_sql('Hb', 1)} AS y, {_scaled_sql('previous_Hb')} AS "Hb_lag", {_scaled_sql('age')} AS age FROM k""")
def _(t):
    d = scaling.delta_design(features(t), ["age", "warm_season"])
    return d.rows.select("don_id", "split", r6("y").alias("y"), r6("Hb_lag").alias("Hb_lag"), r6("age").alias("age"))


@query("legacy_designs", f"""WITH {FEATURES}, d AS (SELECT *, ln(days_to_previous_fb) AS logdays FROM features WHERE NOT first_event AND days_to_previous_fb > 0 AND previous_Hb_def IS NOT NULL),
e AS (SELECT *, count(*) OVER (PARTITION BY donor) AS cnt, {_SPLIT} FROM d), k AS (SELECT * FROM e WHERE cnt >= 2)
SELECT don_id, split, round((Hb - avg(Hb) OVER ()) / (2 * stddev_samp(Hb) OVER ()), 6) AS y, round((logdays - avg(logdays) OVER ()) / (2 * stddev_samp(logdays) OVER ()), 6) AS days, warm_season AS warm FROM k""")
def _(t):
    d = scaling.legacy_design(features(t), ["days_to_previous_fb", "warm_season"], hlen=2)
    return d.rows.select("don_id", "split", r6("y").alias("y"), r6("days_to_previous_fb").alias("days"), F.col("warm_season").alias("warm"))


@query("thin_qr", f"""WITH {DONATIONS}, x AS (SELECT don_id, (Hb - 150) / 30 AS a, (volume_drawn - 300) / 170.0 AS b FROM donations),
g AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, count(*) - 1 AS n FROM x),
r AS (SELECT sqrt(aa / n) AS r11, ab / n / sqrt(aa / n) AS r12, sqrt(bb / n - pow(ab / n / sqrt(aa / n), 2)) AS r22 FROM g)
SELECT don_id, round(a / r11, 6) AS q_a, round((b - r12 * a / r11) / r22, 6) AS q_b FROM x, r""")
def _(t):
    x = t.donations().select("don_id", ((F.col("Hb") - 150) / 30).alias("a"), ((F.col("volume_drawn") - 300) / 170.0).alias("b"))
    q, _, _ = scaling.thin_qr(x, ["a", "b"])
    return q.select("don_id", r6("q_a").alias("q_a"), r6("q_b").alias("q_b"))


@query("additional_preprocess", f"""WITH {FEATURES}, x AS (SELECT *, count(*) OVER (PARTITION BY donor) AS cnt, max(dateonly) OVER (PARTITION BY donor) AS last FROM features)
SELECT don_id, CASE WHEN Hb_deferral THEN 'Deferred' ELSE 'Accepted' END AS "Hb_deferral", age FROM x WHERE cnt > 1 AND dateonly = last""")
def _(t):
    return additional_preprocess(features(t), ["don_id", "Hb_deferral", "age"])


# classifiers


def last_events(t):
    return additional_preprocess(known(features(t)), ["don_id", "donor", "sex", "label", "Hb", "Hb_deferral", *VARIABLES])


def fitted(t, fit):
    """Train rows fit the model; every other last event gets a score."""
    rows = reliable_checkpoint(last_events(t))
    model = fit(rows.filter("label = 'train'"))
    return models.predictions(model, rows.filter("label <> 'train'"), "model", 0.5)


@query("logistic_baseline")
def _(t):
    return fitted(t, models.logistic_baseline)


@query("baseline_lookup")
def _(t):
    rows = last_events(t)
    return models.baseline_lookup(models.logistic_baseline(rows), rows, 0.25)


@query("decision_tree")
def _(t):
    return fitted(t, lambda train: models.pruned_tree(train, VARIABLES)[0])


@query("random_forest")
def _(t):
    return fitted(t, lambda train: models.random_forest(train, VARIABLES, depth=6))


@query("weighted_forest")
def _(t):
    return fitted(t, lambda train: models.weighted_forest(sampling.class_weights(train, "Hb_deferral"), VARIABLES, depth=6))


@query("svm_rbf")
def _(t):
    return fitted(t, lambda train: models.svm_rbf(train, VARIABLES))


@query("grid_search_cv")
def _(t):
    table, _ = models.grid_search_cv(last_events(t), VARIABLES, DecisionTreeClassifier(seed=1), {"maxDepth": [2, 4]})
    return table


@query("kfold_fit")
def _(t):
    """Scores out of fold, and beside them the errors averaged over the folds."""
    oof = reliable_checkpoint(models.numeric_label(models.kfold_fit(last_events(t), models.logistic_baseline)))
    errors = models.fold_errors(oof, "label_index", "score")
    return oof.select("don_id", "fold", r6("score").alias("score"), *[r6(errors.select(c).scalar()).alias(c) for c in ("mae", "rmse")])


@query("model_by_sex_driver")
def _(t):
    """A whole run for both sexes: all nine result tables, written together and read back, counted by kind and model."""
    rows = known(features(t))
    draws = parameter_draws(t, ["beta[previous_Hb]", "beta[age]", "sigma_eps"])
    names = {
        "rf": lambda train, v, seed: models.random_forest(train, v, seed=seed, trees=100, depth=5),
        "lmm": lambda train, v, seed: DrawnModel(draws, ["previous_Hb", "age"], 60.0, seed=seed),
    }
    done = fit_models(rows, ["bl", "rf", "lmm"], "stratified", VARIABLES, classifiers=names)
    folder = workspace(t.spark, "run")
    result_sink(result_tables(done, VARIABLES), folder)
    counts = {kind: df.groupBy(F.col("Id").alias("model")).agg(F.count(F.lit(1)).alias("rows")) for kind, df in load_results(t.spark, folder).items()}
    return union_results(counts, "kind").select("kind", "model", "rows")


# mixed models


@query("mixed_model")
def _(t):
    design = scaling.lmm_design(features(t), DESIGN)
    return posterior.mixed_model(design, iterations=40, warmup=10, seed=1)


@query("dynamic_mixed_model")
def _(t):
    design = scaling.dlmm_design(features(t), [*DESIGN, "previous_Hb"], z_variables=["age", "warm_season"])
    return posterior.dynamic_mixed_model(design, iterations=40, warmup=10, seed=1)


def simple_rows(t):
    """Scaled rows with fixed scales, so that the closed forms can be checked."""
    return t.joined().select("donor", "don_id", "clock", ((F.col("Hb") - 150) / 30).alias("y"), ((F.col("age") - 30) / 10).alias("x1"), (F.col("volume_drawn") / 600).alias("x2"))


@query("donor_effect_posterior", f"""WITH {JOINED}, x AS (SELECT don_id, donor, clock, (Hb - 150) / 30 AS y, (age - 30) / 10 AS x1, volume_drawn / 600 AS x2, row_number() OVER (PARTITION BY donor ORDER BY clock, don_id) AS i FROM joined),
z AS (SELECT *, CASE WHEN i = 1 THEN 0.7 / 1.1 ELSE 1 / 0.9 END AS xs, CASE WHEN i = 1 THEN (y - 0.3 * x1) / 1.1 ELSE (y - 0.2 * x1 + 0.1 * x2) / 0.9 END AS ys FROM x),
c AS (SELECT don_id, coalesce(sum(xs * xs) OVER w, 0) AS sxx, coalesce(sum(xs * ys) OVER w, 0) AS sxy FROM z WINDOW w AS (PARTITION BY donor ORDER BY clock, don_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT don_id, round(sxy / (sxx + 1 / 0.25), 6) AS effect_mean, round(1 / (sxx + 1 / 0.25), 6) AS effect_var FROM c""")
def _(t):
    rows = ordered.attach(simple_rows(t), "donor", ["clock", "don_id"], i=ordered.RunSum(F.lit(1))).withColumn("is_first", F.col("i") == 1)
    first = {"ups": {"x1": 0.3}, "theta": 0.7, "sigma_eeta": 1.1}
    out = posterior.donor_effect_posterior(rows, {"x1": 0.2, "x2": -0.1}, 0.5, 0.9, order=("clock", "don_id"), first=first)
    return out.select("don_id", r6("effect_mean").alias("effect_mean"), r6("effect_var").alias("effect_var"))


def last_with_effect(t):
    rows = simple_rows(t).withColumn("split", F.lit("train"))
    out = posterior.donor_effect_posterior(rows, {"x1": 0.2, "x2": -0.1}, 0.5, 0.9, order=("clock", "don_id"))
    return posterior.last_rows(out, "donor", ("clock", "don_id"))


def parameter_draws(t, names):
    """Draws of the given tables under model parameter names."""
    d = t.draws(len(names))
    index = F.substring("parameter", 2, 2).cast("int")
    name = F.get(F.array(*[F.lit(n) for n in names]), index)
    return d.select(name.alias("parameter"), "draw", (F.abs("value") + 0.1).alias("value"))


def _gauss(key, tag):
    return f"(sqrt(-2 * ln({_unit('radius|' + tag, key)})) * cos(2 * pi() * {_unit('angle|' + tag, key)}))"


def _unit(tag, key):
    return f"((CAST('0x' || substr(md5('1|{tag}|' || {key} || '|' || draw), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496)"


def _drawn_sql(names, tags):
    """nr: draws numbered by value in their parameter; picked: the last rows with 1000 choices of each parameter."""
    cases = " ".join(f"WHEN 'p{i:02d}' THEN '{n}'" for i, n in enumerate(names))
    joins = " ".join(f"JOIN nr n{i} ON n{i}.parameter = '{n}' AND n{i}.i = k{i}" for i, n in enumerate(names))
    picks = ", ".join(f"1 + CAST(floor({_unit(tags[i], 'donor')} * (SELECT count(*) FROM nr WHERE parameter = '{n}')) AS BIGINT) AS k{i}" for i, n in enumerate(names))
    values = ", ".join(f"n{i}.value AS v{i}" for i in range(len(names)))
    return f"""{JOINED}, {DRAWS}, x AS (SELECT don_id, donor, clock, (Hb - 150) / 30 AS y, (age - 30) / 10 AS x1, volume_drawn / 600 AS x2 FROM joined),
c AS (SELECT *, coalesce(sum(1 / 0.9 / 0.9) OVER w, 0) AS sxx, coalesce(sum((y - 0.2 * x1 + 0.1 * x2) / 0.9 / 0.9) OVER w, 0) AS sxy FROM x WINDOW w AS (PARTITION BY donor ORDER BY clock, don_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
last_rows AS (SELECT donor, y, x1, x2, sxy / (sxx + 4) AS m, 1 / (sxx + 4) AS v FROM c QUALIFY row_number() OVER (PARTITION BY donor ORDER BY clock DESC, don_id DESC) = 1),
nr AS (SELECT CASE parameter {cases} END AS parameter, abs(value) + 0.1 AS value, row_number() OVER (PARTITION BY parameter ORDER BY abs(value)) AS i FROM draws WHERE parameter < 'p{len(names):02d}'),
many AS (SELECT *, unnest(range(1, 1001)) AS draw FROM last_rows), chosen AS (SELECT *, {picks} FROM many),
picked AS (SELECT c.*, {values} FROM chosen c {joins})"""


_PP, _DP = ["beta[x1]", "beta[x2]", "sigma_eps"], ["beta[x1]", "beta[x2]", "sigma_eps", "delta"]


@query("posterior_predictive", f"WITH {_drawn_sql(_PP, ['betax1', 'betax2', 'eps'])} SELECT donor, CAST(draw AS INTEGER) AS draw, round(x1 * v0 + x2 * v1 + m + sqrt(v) * {_gauss('donor', 'effect')} + v2 * {_gauss('donor', 'noise')}, 6) AS y FROM picked")
def _(t):
    pred = posterior.posterior_predictive(last_with_effect(t), parameter_draws(t, _PP), ["x1", "x2"])
    return pred.select("donor", "draw", r6("y").alias("y"))


@query("delta_predictive", f"""WITH {_drawn_sql(_DP, ['x1', 'x2', 'eps', 'delta'])}, z AS (SELECT donor, (x1 * v0 + x2 * v1 + m) * (1 - v3) + v3 * y + v2 * {_gauss('donor', 'noise')} AS z FROM picked)
SELECT donor, round(avg(z), 6) AS mean, avg(CASE WHEN z < -0.4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p FROM z GROUP BY donor""")
def _(t):
    rows = last_with_effect(t).select("donor", "x1", "x2", F.col("effect_mean").alias("u"), F.col("y").alias("Hb_lag"))
    out = posterior.delta_predictive(rows, parameter_draws(t, _DP), ["x1", "x2"], -0.4)
    return out.select("donor", r6("mean").alias("mean"), "p")


@query("deferral_probability", f"WITH {DRAWS} SELECT parameter, round(avg(CASE WHEN value < (131 - 130) / (2 * 25.0) THEN 1.0 ELSE 0.0 END), 6) AS score FROM draws GROUP BY parameter")
def _(t):
    out = posterior.deferral_probability(t.draws(), 131, Scale({"Hb": 130.0}, {"Hb": 25.0}), "value", ["parameter"])
    return out.withColumn("score", r6("score"))


@query("prediction_frame", f"""WITH {DRAWS}, a AS (SELECT parameter, 130 + 50 * arg_min(value, draw) AS original_value FROM draws GROUP BY parameter),
p AS (SELECT d.parameter, max(a.original_value) AS o, avg(value) AS m, stddev_samp(value) AS s, avg(CASE WHEN value * 50 + 130 < 131 THEN 1.0 ELSE 0.0 END) AS score, quantile_cont(value, 0.05) AS q FROM draws d JOIN a ON a.parameter = d.parameter GROUP BY d.parameter)
SELECT 'mean' AS metric, parameter, round(o, 6) AS original_value, CASE WHEN o < 131 THEN 1 ELSE 0 END AS original_label, round(score, 6) AS score, round(s, 6) AS sds, round(m * 50 + 130, 6) AS predicted_value, CASE WHEN m * 50 + 130 < 131 THEN 1 ELSE 0 END AS predicted_label, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS hit FROM p
UNION ALL SELECT 'quantile', parameter, round(o, 6), CASE WHEN o < 131 THEN 1 ELSE 0 END, round(score, 6), round(s, 6), round(q * 50 + 130, 6), CASE WHEN q * 50 + 130 < 131 THEN 1 ELSE 0 END, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END FROM p""")
def _(t):
    d = t.draws()
    actual = d.groupBy("parameter").agg((130 + 50 * F.min_by("value", "draw")).alias("original_value"))
    pred = d.select("parameter", F.col("value").alias("y"))
    scale = Scale({"Hb": 130.0}, {"Hb": 25.0})
    parts = [posterior.prediction_frame(pred, actual, 131.0, scale, m, key="parameter").withColumn("metric", F.lit(m)) for m in ("mean", "quantile")]
    out = parts[0].unionByName(parts[1])
    return out.select("metric", "parameter", r6("original_value").alias("original_value"), "original_label", r6("score").alias("score"), r6("sds").alias("sds"),
                      r6("predicted_value").alias("predicted_value"), "predicted_label", F.col("score_predicted_label").alias("hit"))


@query("model_list_reshape", f"WITH {DRAWS} SELECT draw, max(value) FILTER (parameter = 'p00') AS p00, max(value) FILTER (parameter = 'p07') AS p07 FROM draws GROUP BY draw")
def _(t):
    return posterior.model_list_reshape(t.draws(), ["p00", "p07"])
