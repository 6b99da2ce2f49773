"""Fits, posterior quantities and attributions on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from donorflow.operators import explain, models, numbered, posterior, scaling
from donorflow.operators.scaling import Design, Scale
from donorflow.plans.driver import model_by_sex_driver


@pytest.fixture(scope="module")
def train(spark):
    rng = random.Random(3)
    data = []
    for i in range(600):
        x, z = rng.gauss(140, 12), rng.gauss(0, 1)
        p = 1 / (1 + np.exp(0.15 * (x - 130) - z))
        data.append((i, "male" if i % 2 else "female", ["train", "validate"][i % 5 == 0], x, x, z, bool(rng.random() < p)))
    return spark.createDataFrame(data, "don_id int, sex string, label string, Hb double, previous_Hb double, z double, Hb_deferral boolean").cache()


def test_baseline_solves_the_score_equations(train):
    model = models.logistic_baseline(train)
    out = model.predict(train).select((F.col("score") - F.col("Hb_deferral").cast("int")).alias("r"), "previous_Hb")
    r = out.agg(F.sum("r"), F.sum(F.col("r") * F.col("previous_Hb"))).first()
    assert abs(r[0]) < 1e-3 and abs(r[1]) < 0.2
    found = models.baseline_lookup(model, train, 0.5).first()
    assert abs(found.previous_Hb + model.intercept / model.slope) <= 0.5


@pytest.mark.parametrize("name", ["dt", "rf", "svm"])
def test_classifiers_rank_better_than_chance(train, name):
    fit = {
        "dt": lambda: models.decision_tree(train, ["previous_Hb", "z"]),
        "rf": lambda: models.random_forest(train, ["previous_Hb", "z"], trees=15, depth=4),
        "svm": lambda: models.svm_rbf(train, ["previous_Hb", "z"], size=32, iterations=20),
    }[name]
    from donorflow.operators.metrics import auroc, threshold_sweep

    scored = models.numeric_label(fit().predict(train))
    assert auroc(threshold_sweep(scored, "score", "label_index")).first()[0] > 0.75


def test_stored_model_scores_the_same(train, tmp_path):
    model = models.decision_tree(train, ["previous_Hb", "z"], maxDepth=3)
    path = models.save_model(model, str(tmp_path), "dt", "both")
    a = {r.don_id: r.score for r in model.predict(train).select("don_id", "score").collect()}
    back = models.append_prefitted(train, {("dt", "both"): path}, [("dt", "both")], ["previous_Hb", "z"])
    assert a == {r.don_id: r.score for r in back.select("don_id", "score").collect()}
    with pytest.raises(ValueError, match="no stored model"):
        models.append_prefitted(train, {}, [("rf", "male")], ["z"])


def test_shap_adds_up(train):
    small = train.limit(60).cache()

    def score(df):
        return df.withColumn("score", 2 * F.col("previous_Hb") - 3 * F.col("z") + F.col("previous_Hb") * F.col("z") / 50)

    phi = explain.shap_sampling(score, small, ["previous_Hb", "z"], "don_id", nsim=300, seed=2)
    total = {r.don_id: r.s for r in phi.groupBy("don_id").agg(F.sum("attribution").alias("s")).collect()}
    f = {r.don_id: r.score for r in score(small).select("don_id", "score").collect()}
    mean = np.mean(list(f.values()))
    gap = [total[k] - (f[k] - mean) for k in f]
    assert np.std(gap) < 0.15 * np.std(list(f.values()))
    exact = explain.shap_linear_exact(small, {"previous_Hb": 2.0, "z": -3.0}, "don_id")
    assert abs(exact.agg(F.sum("attribution")).first()[0]) < 1e-6


def test_permutation_importance_finds_the_variable(train):
    def score(df):
        return df.withColumn("score", 1 / (1 + F.exp(0.15 * (F.col("previous_Hb") - 130))))

    out = explain.permutation_importance(score, train, ["previous_Hb", "z"], "Hb_deferral", "don_id")
    got = {r.Variable: r.Importance for r in out.collect()}
    assert got["previous_Hb"] > 0.02 and abs(got["z"]) < 1e-9


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    data, n = [], 0
    for d in range(150):
        b = rng.normal(0, 0.6)
        z = rng.normal()
        for i in range(8):
            x = rng.normal(size=2)
            y = 0.5 * z + 0.8 * b + rng.normal(0, 0.5) if i == 0 else 0.7 * x[0] - 0.3 * x[1] + b + rng.normal(0, 0.4)
            data.append((d, n, float(y), float(x[0]), float(x[1]), float(z), i == 0, "train"))
            n += 1
    return spark.createDataFrame(data, "donor int, don_id int, y double, a double, b double, z double, is_first boolean, split string").cache()


def means(draws):
    return {r.parameter: r.m for r in draws.groupBy("parameter").agg(F.avg("value").alias("m")).collect()}


def test_mixed_model_recovers_parameters(panel):
    design = Design(panel.filter("not is_first"), ["a", "b"], Scale({}, {}))
    m = means(posterior.mixed_model(design, iterations=60, warmup=20))
    assert abs(m["beta[a]"] - 0.7) < 0.06 and abs(m["beta[b]"] + 0.3) < 0.06
    assert abs(m["sigma_b"] - 0.6) < 0.1 and abs(m["sigma_eps"] - 0.4) < 0.04


def test_dynamic_model_recovers_parameters(panel):
    first = panel.filter("is_first").select("donor", "z", "y")
    design = Design(panel, ["a", "b"], Scale({}, {}), None, first)
    m = means(posterior.dynamic_mixed_model(design, iterations=60, warmup=20))
    assert abs(m["beta[a]"] - 0.7) < 0.06 and abs(m["ups[z]"] - 0.5) < 0.12
    assert abs(m["theta"] - 0.8) < 0.25 and abs(m["sigma_eeta"] - 0.5) < 0.12


def test_constants_are_shared_by_both_equations(panel):
    c = panel.select("donor").distinct().withColumn("c", F.when(F.col("donor") % 2 == 0, 1.0).otherwise(-1.0))
    moved = panel.join(c, "donor").withColumn("y", F.col("y") + 0.9 * F.col("c")).drop("c")
    first = moved.filter("is_first").select("donor", "z", "y")
    m = means(posterior.dynamic_mixed_model(Design(moved, ["a", "b"], Scale({}, {}), c, first), iterations=40, warmup=15))
    assert abs(m["phi[c]"] - 0.9) < 0.12 and abs(m["beta[a]"] - 0.7) < 0.06 and abs(m["ups[z]"] - 0.5) < 0.15


def test_effect_posterior_matches_the_loop(panel):
    rows = posterior.donor_effect_posterior(panel, {"a": 0.7, "b": -0.3}, 0.6, 0.4, order=("don_id",))
    data = rows.orderBy("don_id").collect()
    past = {}
    for r in data:
        xy = past.setdefault(r.donor, [])
        s = sum(1 / 0.16 for _ in xy) + 1 / 0.36
        assert abs(r.effect_var - 1 / s) < 1e-12
        assert abs(r.effect_mean - sum(v / 0.16 for v in xy) / s) < 1e-9
        xy.append(r.y - 0.7 * r.a + 0.3 * r.b)


def test_thin_qr_is_orthogonal(panel):
    q, r, inverse = scaling.thin_qr(panel, ["a", "b", "z"])
    g, n = scaling.gram(q, ["q_a", "q_b", "q_z"])
    assert np.allclose(g / (n - 1), np.eye(3), atol=1e-9) and np.allclose(r @ inverse, np.eye(3))


def test_hdi_and_rhat(spark):
    rng = np.random.default_rng(1)
    data = [("p", 1 + i % 2, i // 2 + 1, float(v)) for i, v in enumerate(rng.gamma(2.0, size=400))]
    draws = spark.createDataFrame(data, "parameter string, chain int, draw int, value double").withColumn("draw", F.col("draw") * 2 + F.col("chain"))
    x = np.sort([d[3] for d in data])
    k = int(np.ceil(0.95 * len(x)))
    i = int(np.argmin(x[k:] - x[:-k]))
    for chunk_rows in (None, 50):
        r = posterior.posterior_effects(draws, chunk_rows=chunk_rows).first()
        assert (r.low, r.high) == (x[i], x[i + k])
    assert 0.98 < posterior.rhat(draws).first().rhat < 1.05


def test_predictive_score(spark, panel):
    last = posterior.last_rows(posterior.donor_effect_posterior(panel, {"a": 0.7, "b": -0.3}, 0.6, 0.4, order=("don_id",)), "donor", ("don_id",))
    draws = spark.createDataFrame([("beta[a]", 0.7), ("beta[b]", -0.3), ("sigma_eps", 0.4)], "parameter string, value double")
    pred = posterior.posterior_predictive(last, draws, ["a", "b"], n=400)
    mean = pred.groupBy("donor").agg(F.avg("y").alias("m")).join(last.select("donor", (0.7 * F.col("a") - 0.3 * F.col("b") + F.col("effect_mean")).alias("e")), "donor")
    gap = mean.agg(F.avg(F.abs(F.col("m") - F.col("e")))).first()[0]
    assert gap < 0.05


def test_driver_tags_every_model_and_sex(tables):
    from donorflow.plans.features import Settings, whole_series_features

    features = whole_series_features(tables.raw_donations(), tables.raw_donors(), Settings(), check=False).filter("not first_event").persist()
    out = model_by_sex_driver(features, ["bl"], "stratified", ["previous_Hb", "age"])
    assert {r.Id for r in out["prediction"].select("Id").distinct().collect()} == {"bl-male", "bl-female"}
    assert "donor" not in out["sizes"].columns


def test_nine_tables_of_a_run(spark, tables, tmp_path):
    """Every table of a run is written with all its models, without subjects, and only a finished run can be read."""
    from donorflow.plans.driver import DrawnModel, fit_models, result_tables
    from donorflow.plans.features import Settings, whole_series_features
    from donorflow.sources.delimited import load_results, result_sink

    features = whole_series_features(tables.raw_donations(), tables.raw_donors(), Settings(), check=False).filter("not first_event")
    draws = spark.createDataFrame([(p, i, 0.1 + 0.01 * i) for p in ("beta[age]", "sigma_eps") for i in range(40)], "parameter string, draw int, value double")
    names = {"rf": lambda train, v, seed: models.random_forest(train, v, trees=5, depth=3), "lmm": lambda train, v, seed: DrawnModel(draws, ["age"], 5.0, n=50)}
    done = fit_models(features, ["bl", "rf", "lmm"], "pooled", ["previous_Hb", "age"], classifiers=names)
    folder = str(tmp_path / "run")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        load_results(spark, folder)
    result_sink(result_tables(done, ["previous_Hb", "age"], replicates=20, nsim=3), folder)
    found = load_results(spark, folder)
    assert len(found) == 9
    both, fitted, drawn = {"bl-both", "rf-both", "lmm-both"}, {"bl-both", "rf-both"}, {"lmm-both"}
    want = {k: both for k in ("summary", "prediction", "sizes", "variable_summary", "histogram", "timing")} | {"shap-value": fitted, "variable-importance": fitted, "effect-size": drawn}
    for kind, df in found.items():
        assert {r.Id for r in df.select("Id").distinct().collect()} == want[kind], kind
        assert not {"donor", "don_id", "id"} & set(df.columns)
    scores = found["prediction"].filter("Id = 'lmm-both'").agg(F.min(F.col("score").cast("double")), F.max(F.col("score").cast("double"))).first()
    assert 0 <= scores[0] <= scores[1] <= 1 and scores[1] > 0


def test_numbers_made_in_batches_are_those_of_columns(spark):
    """Whole numbers, texts of two blocks, texts that aren't ASCII and NULL; more numbers than one batch holds."""
    from donorflow.operators import ordered

    keys = spark.createDataFrame([(k,) for k in ("7", "12", "a" * 70, "\u00e9\u4e2d", "", None)], "k string")
    made = numbered.numbered(keys, "k", 40, "i", 5, {"u": (["a"], ["z"]), "v": ([], [])}, {"e": ["b"]})
    gaps = [F.abs(F.col("u") - ordered.uniform(5, F.lit("a"), "k", "i", F.lit("z"))), F.abs(F.col("v") - ordered.uniform(5, "k", "i"))]
    gaps += [F.abs(F.col("e") - ordered.gaussian(5, F.lit("b"), "k", "i"))]
    one = made.agg(F.count(F.lit(1)), F.countDistinct("i"), *[F.max(g) for g in gaps]).first()
    assert tuple(one)[:4] == (240, 40, 0.0, 0.0) and one[4] < 1e-12
    many = numbered.numbered(spark.range(2), "id", numbered.BATCH + 5, "i", 5, {"u": ([], [])})
    assert many.agg(F.count(F.lit(1)), F.max("i"), F.max(F.abs(F.col("u") - ordered.uniform(5, "id", "i")))).first() == (2 * numbered.BATCH + 10, numbered.BATCH + 5, 0.0)


def tasks_of(df):
    return df.rdd.getNumPartitions()


def test_draws_and_simulations_are_dealt_over_tasks(spark, monkeypatch):
    """A few rows that make many draws or scores are no longer one task's work; results stay those of one task."""
    draws = spark.createDataFrame([(p, 0.1 * i) for p in ("beta[a]", "sigma_eps", "delta") for i in range(1, 8)], "parameter string, value double")
    rows = spark.createDataFrame([(i, 0.1 * i, 0.2, 0.3, 0.4) for i in range(40)], "donor int, a double, effect_mean double, effect_var double, Hb_lag double").coalesce(1)

    def score(df):
        return df.withColumn("score", 2 * F.col("a") - F.col("a") * F.col("Hb_lag"))

    def results():
        pred = posterior.posterior_predictive(rows, draws, ["a"], n=50)
        delta = posterior.delta_predictive(rows, draws, ["a"], 0.5, n=50, effect="effect_mean")
        phi = explain.shap_sampling(score, rows, ["a", "Hb_lag"], "donor", nsim=50)
        return pred, {k: {tuple(r)[:2]: tuple(r)[2:] for r in df.collect()} for k, df in (("pred", pred), ("delta", delta), ("phi", phi))}

    one, before = results()
    monkeypatch.setattr(posterior, "TASK_ROWS", 200)
    monkeypatch.setattr(explain, "SIMULATIONS", 200)
    more, after = results()
    assert tasks_of(one) == 1 and tasks_of(more) == 10
    assert before["pred"] == after["pred"] and len(before["pred"]) == 2000
    for key, value in before["phi"].items():
        assert after["phi"][key] == pytest.approx(value, abs=1e-12)


def test_many_draws_and_reference_rows_are_looked_up_without_moving_repeated_rows(spark, monkeypatch, capsys):
    """Above 250,000 draws repeated rows were shuffled once a parameter; NULL draws, page ends and the way by a shuffle agree."""
    many = spark.range(1, 300_001).select(F.explode(F.array(*[F.lit(p) for p in ("beta[a]", "sigma_eps")])).alias("parameter"), (F.when(F.col("id") % 100 != 0, F.col("id") / 1e5)).alias("value"))
    delta = spark.range(1, 3 * (1 << numbered.PAGE_BITS) + 1).select(F.lit("delta").alias("parameter"), (F.col("id") / 1e5).alias("value"))
    draws = many.unionByName(delta).withColumn("value", F.col("value").cast("double"))
    rows = spark.createDataFrame([(i if i else None, 0.1 * i, 0.2, 0.3, 0.4) for i in [*range(30), 29]], "donor int, a double, effect_mean double, effect_var double, Hb_lag double")

    def results():
        pred = posterior.posterior_predictive(rows, draws, ["a"], n=50)
        changed = posterior.delta_predictive(rows, draws, ["a"], 0.5, n=50, effect="effect_mean")
        phi = explain.shap_sampling(lambda df: df.withColumn("score", F.col("a") * F.col("Hb_lag")), rows.filter("donor < 29"), ["a", "Hb_lag"], "donor", nsim=20)
        capsys.readouterr()
        pred.explain()
        changed.explain()
        phi.explain()
        plans = capsys.readouterr().out
        return plans, sorted(map(repr, pred.collect())), {r.donor: (r.mean, r.p) for r in changed.collect()}, {(r.donor, r.Variable): r.attribution for r in phi.collect()}

    plans, drawn, changed, phi = results()
    assert "SortMergeJoin" not in plans and plans.count("BroadcastHashJoin") == 6
    assert len(drawn) == 31 * 50 and 0 < sum("y=None" in r for r in drawn) < 155
    monkeypatch.setattr(numbered, "SENT_VALUES", 0)
    other, shuffled, *more = results()
    assert "SortMergeJoin" in other and drawn == shuffled
    for now, before in zip(more, (changed, phi)):
        assert now.keys() == before.keys()
        for key, value in before.items():
            assert now[key] == pytest.approx(value, abs=1e-12)


def test_draws_of_the_first_parameters_are_those_of_all(spark, tmp_path):
    """The first parameters' draws are made without those of all others; short, empty and missing vectors have what they have."""
    from donorflow.catalog.bindings import Tables

    vectors = [(1, [0.5, -1.5, 2.5]), (2, [0.25]), (3, []), (4, None), (None, [None, 3.0, 4.0]), (1, [0.5, -1.5, 2.5])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    t = Tables(spark, str(tmp_path))
    every = t.draws().filter("parameter < 'p02'")
    assert sorted(map(repr, t.draws(2).collect())) == sorted(map(repr, every.collect())) and every.count() == 7


def test_shap_scores_each_step_once(spark):
    """A simulation of three variables needs four scores (before: six), and their changes add up exactly."""
    rows = spark.createDataFrame([(i, float(i), float(i % 3), float(i * i % 7)) for i in range(12)], "k int, a double, b double, c double")
    seen = []

    def score(df):
        out = df.withColumn("score", F.col("a") * F.col("b") + F.col("c"))
        seen.append(out.count())
        return out

    phi = explain.shap_sampling(score, rows, ["a", "b", "c"], "k", nsim=20, seed=4)
    assert seen == [12 * 20 * 4]
    from donorflow.operators.ordered import uniform

    data = {r.k: (r.a, r.b, r.c) for r in rows.collect()}
    ranked = {r.row: data[r.k] for r in explain.sample_rows(rows, None, 4, "k").collect()}
    grid = rows.select("k", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("sim"))
    turns = grid.select("k", "sim", uniform(4, F.lit("other"), "k", "sim").alias("o"), *[uniform(4, F.lit("turn"), "k", "sim", F.lit(f)).alias(f) for f in "abc"]).collect()
    want = {(k, f): 0.0 for k in data for f in "abc"}
    for r in turns:
        other = ranked[int(r.o * 12) + 1]
        for i, f in enumerate("abc"):
            def value(itself):
                x = [data[r.k][j] if (itself if j == i else r[g] < r[f]) else other[j] for j, g in enumerate("abc")]
                return x[0] * x[1] + x[2]
            want[r.k, f] += (value(True) - value(False)) / 20
    got = {(r.k, r.Variable): r.attribution for r in phi.collect()}
    assert got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("depth", [0, 3, 5, 6])
def test_forest_scores_all_trees_at_once_as_spark_does(train, depth):
    """The same doubles as the model's own, without a plan of vectors; a missing feature is an error in both."""
    fields = ["previous_Hb", "z", "don_id"]
    model = models.random_forest(train, fields, trees=30, depth=depth)
    odd = train.withColumn("z", F.when(F.col("don_id") % 7 == 0, F.lit(float("inf"))).when(F.col("don_id") % 5 == 0, F.col("don_id") - 300.0).otherwise(F.col("z")))
    fast = model.predict(odd)
    assert "vectorassembler" not in fast._jdf.queryExecution().toString().lower()
    slow = models._tree_score(model.model, fields)(odd)
    assert fast.columns == slow.columns
    assert {r.don_id: r.score for r in fast.collect()} == {r.don_id: r.score for r in slow.collect()}
    with pytest.raises(Exception, match="NULL or NaN"):
        model.predict(train.withColumn("z", F.lit(None).cast("double"))).collect()


def test_rows_of_a_forest_are_dealt_over_tasks(spark, monkeypatch):
    """A few megabytes that go through many trees are more than one task, whatever their bytes."""
    train = spark.range(400).selectExpr("id % 3 = 0 AS Hb_deferral", "CAST(id % 17 AS DOUBLE) AS x", "1.0D AS weight").coalesce(1)
    seen, fit = [], models._fit_pipeline
    monkeypatch.setattr(models, "_fit_pipeline", lambda rows, *rest: seen.append(rows.rdd.getNumPartitions()) or fit(rows, *rest))
    models.weighted_forest(train, ["x"], trees=5, depth=2)
    monkeypatch.setattr(models, "ROWS_OF_TREES", 500)
    models.weighted_forest(train, ["x"], trees=5, depth=2)
    models.random_forest(train, ["x"], trees=5, depth=2)
    assert seen == [1, 4, 4]


def test_a_grid_reads_its_rows_once(spark):
    """Repeats and folds start from written rows; the query behind them isn't run again."""
    from pyspark.ml.classification import DecisionTreeClassifier

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    plain = spark.range(200).selectExpr("id AS don_id", "id % 40 AS donor", "id % 3 = 0 AS Hb_deferral", "CAST(id % 7 AS DOUBLE) AS x")
    train = plain.mapInArrow(counted, plain.schema)
    table, best = models.grid_search_cv(train, ["x"], DecisionTreeClassifier(seed=1), {"maxDepth": [1, 2]}, folds=2, repeats=2)
    assert read.value == 200 and table.count() == 2 and best["maxDepth"] in (1, 2)


def test_area_of_a_tree_is_the_evaluators(spark, monkeypatch):
    """Counts per score give what the evaluator makes of all rows, with and without both classes in a fold."""
    from pyspark.ml.classification import DecisionTreeClassifier

    plain = spark.range(120).selectExpr("id AS don_id", "id AS donor", "hash(id) % 4 = 0 AS Hb_deferral", "CAST(hash(id, 1) % 9 AS DOUBLE) + IF(hash(id) % 4 = 0, 2, 0) AS x")
    one = plain.withColumn("Hb_deferral", F.col("Hb_deferral") & (F.col("donor") < 24))
    for train in (plain, one):
        found = [r.auroc for r in models.grid_search_cv(train, ["x"], DecisionTreeClassifier(seed=1), {"maxDepth": [1, 3]}, folds=4, repeats=1)[0].orderBy("maxDepth").collect()]
        with monkeypatch.context() as m:
            m.setattr(models, "DecisionTreeClassifier", type(None))  # leaves all to the evaluator
            want = [r.auroc for r in models.grid_search_cv(train, ["x"], DecisionTreeClassifier(seed=1), {"maxDepth": [1, 3]}, folds=4, repeats=1)[0].orderBy("maxDepth").collect()]
        assert np.allclose(found, want, atol=1e-12)


def test_a_run_describes_rows_once_and_scores_simulations_once(spark, tables, monkeypatch):
    """Models of one sex share the description of its rows; attributions are simulated once, though two tables read them."""
    from donorflow.operators import describe, explain
    from donorflow.plans import driver
    from donorflow.plans.features import Settings, whole_series_features
    from donorflow.sources.delimited import result_sink

    scored = spark.sparkContext.accumulator(0)
    calls, summary = [], describe.variable_summary
    monkeypatch.setattr(describe, "variable_summary", lambda *a, **k: calls.append(1) or summary(*a, **k))

    class Counted:
        features = ["age"]

        def predict(self, df):
            def step(batches):
                for b in batches:
                    scored.add(b.num_rows)
                    yield b

            out = df.withColumn("score", F.col("age").cast("double") / 100)
            return out.mapInArrow(step, out.schema)

    features = whole_series_features(tables.raw_donations(), tables.raw_donors(), Settings(), check=False).filter("not first_event")
    done = driver.fit_models(features, ["a", "b"], "pooled", ["age"], classifiers={n: lambda *_: Counted() for n in "ab"})
    monkeypatch.setattr(explain, "permutation_importance", lambda *a: spark.range(1).selectExpr("'age' AS Variable", "0.0D AS Importance"))
    before = scored.value
    out = driver.result_tables(done, ["age"], replicates=5, nsim=4)
    rows = done[0].test.count()
    for kind in ("shap-value", "sizes"):
        for df in out[kind].values():
            assert df.count() > 0
    # each model: predictions of the test rows, and 4 simulations of them with 2 scores each
    assert rows and scored.value - before == 2 * (rows + rows * 4 * 2) and len(calls) == 1
