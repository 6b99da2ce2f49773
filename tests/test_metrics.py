"""Evaluation against brute force, published figures and invariants."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from donorflow.functions import cost
from donorflow.functions.metadata import COST_CONSTANTS
from donorflow.operators import metrics, resampling


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(1)
    data = []
    for i in range(300):
        label = int(rng.random() < 0.3)
        data.append((i, "ab"[i % 2], round(float(min(1, max(0, rng.gauss(0.4 + 0.2 * label, 0.2)))), 2), label))
    return spark.createDataFrame(data, "id int, g string, score double, label int").cache(), data


def brute(data):
    return [s for *_, s, y in data if y], [s for *_, s, y in data if not y]


@pytest.mark.parametrize("chunk_rows", [None, 9])
def test_sweep_counts(scored, chunk_rows):
    df, data = scored
    got = metrics.threshold_sweep(df, by=["g"], chunk_rows=chunk_rows)
    for r in got.collect():
        mine = [(s, y) for _, g, s, y in data if g == r.g]
        assert r.tp == sum(y for s, y in mine if s >= r.threshold)
        assert r.fp == sum(1 - y for s, y in mine if s >= r.threshold)
        assert r.tp + r.fn == sum(y for _, y in mine) and r.fp + r.tn == sum(1 - y for _, y in mine)


def test_area_and_interval(scored):
    df, data = scored
    pos, neg = brute(data)
    area = np.mean([[(p > n) + 0.5 * (p == n) for n in neg] for p in pos])
    v10 = [np.mean([(p > n) + 0.5 * (p == n) for n in neg]) for p in pos]
    v01 = [np.mean([(p > n) + 0.5 * (p == n) for p in pos]) for n in neg]
    se = math.sqrt(np.var(v10, ddof=1) / len(pos) + np.var(v01, ddof=1) / len(neg))
    sweep = metrics.threshold_sweep(df)
    r = metrics.auroc_ci(sweep).first()
    assert np.allclose([r.low, r.value, r.high], [area - 1.959964 * se, area, area + 1.959964 * se], atol=1e-6)
    assert abs(metrics.auroc(sweep).first()[0] - area) < 1e-12


def test_precision_recall_area_matches_fine_integration(scored):
    df, data = scored
    scores = sorted({s for *_, s, _ in data}, reverse=True)
    P, total, tp0, fp0 = sum(y for *_, y in data), 0.0, 0, 0
    for t in scores:
        tp = sum(y for *_, s, y in data if s >= t)
        fp = sum(1 - y for *_, s, y in data if s >= t)
        if tp > tp0:
            x = np.linspace(1e-9, tp - tp0, 20_001)
            f = (tp0 + x) / (tp0 + x + fp0 + (fp - fp0) / (tp - tp0) * x)
            total += float(np.sum((f[1:] + f[:-1]) / 2 * np.diff(x)))
        tp0, fp0 = tp, fp
    assert abs(metrics.aupr(metrics.threshold_sweep(df)).first()[0] - total / P) < 1e-6


def test_best_f1_cut(scored):
    df, data = scored

    def f1(t):
        tp = sum(y for *_, s, y in data if s >= t)
        return 2 * tp / (sum(s >= t for *_, s, _ in data) + sum(y for *_, y in data))

    best = max(f1(s) for *_, s, _ in data)
    tied = sorted({s for *_, s, _ in data if f1(s) == best})
    r = metrics.optimal_f1_cut(metrics.threshold_sweep(df)).first()
    assert abs(r.f1 - best) < 1e-12 and abs(r.threshold - np.median(tied)) < 1e-12


def test_tied_cuts_give_their_median(spark):
    df = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.5, 1), (0.4, 1), (0.4, 0), (0.4, 0)], "score double, label int")
    sweep = metrics.threshold_sweep(df)
    r = metrics.optimal_youden_cut(sweep).first()
    assert r.threshold == 0.5


def test_one_class_and_constant_scores(spark):
    one = spark.createDataFrame([(0.1, 1), (0.2, 1)], "score double, label int")
    assert metrics.auroc(metrics.threshold_sweep(one)).first() is None or metrics.auroc(metrics.threshold_sweep(one)).first()[0] is None
    flat = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 0)], "score double, label int")
    sweep = metrics.threshold_sweep(flat)
    assert metrics.auroc(sweep).first()[0] == 0.5
    assert abs(metrics.aupr(sweep).first()[0] - 1 / 3) < 1e-12


@pytest.mark.parametrize("statistic", ["f1", "aupr", "auroc"])
def test_bootstrap_contains_the_value(scored, statistic):
    df, _ = scored
    for method in ("norm", "perc"):
        r = metrics.bootstrap_ci(df, statistic, threshold=0.45, replicates=120, method=method, seed=2).first()
        assert r.low < r.value < r.high and r.high - r.low < 0.4


def test_bootstrap_width_is_close_to_delong(scored):
    df, _ = scored
    exact = metrics.auroc_ci(metrics.threshold_sweep(df)).first()
    boot = metrics.bootstrap_ci(df, "auroc", replicates=300, seed=5).first()
    assert abs((boot.high - boot.low) / (exact.high - exact.low) - 1) < 0.25


def test_poisson_weights():
    for mean in (1, 12, 150, 900, 1_000_000):
        x = resampling.weights(np.full(20, mean), np.arange(20) + (1 << 33), 77, 1, 2000)
        assert abs(x.mean() / mean - 1) < 0.02 and abs(x.var() / mean - 1) < 0.05
        assert abs(np.corrcoef(x[:, :1999].ravel(), x[:, 1:].ravel())[0, 1]) < 0.02 and abs(np.corrcoef(x[:-1].ravel(), x[1:].ravel())[0, 1]) < 0.02
    assert (resampling.weights(np.array([0, 3]), np.array([4, 5]), 1, 1, 50)[0] == 0).all()
    least, chance = resampling.poisson_table(1)
    assert least == 0 and abs(chance[0] - np.exp(-1)) < 1e-15 and abs(chance[2] - 2.5 * np.exp(-1)) < 1e-15
    least, chance = resampling.binomial_table(4, 1)
    assert least == 0 and np.allclose(chance[:2], [0.75**4, 0.75**4 + 0.75**3])


@pytest.mark.parametrize("stratified,chunk", [(True, 7), (False, 1000)])
def test_replicates_equal_a_plain_sweep(scored, stratified, chunk):
    """Vectors carried over chunks give what sorting the weighted scores of each replicate gives."""
    df, _ = scored
    counts = metrics.score_counts(df, by=["g"]).collect()
    found = resampling.resampled_areas(df.sparkSession.createDataFrame(counts), 40, 3, ["g"], stratified, {"cut": F.col("threshold") >= 0.5}, chunk)
    got = {(r.g, r.replicate): r for r in found.collect()}
    for g in {r.g for r in counts}:
        own = sorted((r for r in counts if r.g == g), key=lambda r: -r.threshold)
        salt = df.sparkSession.createDataFrame([(g,)], "g string").select(resampling.salt_of(3, ["g"])).first()[0]
        pos, neg = (resampling.weights(np.array([r[c] for r in own]), np.arange(len(own)), salt, i, 40) for i, c in ((1, "pos"), (2, "neg")))
        for k in range(40):
            r = got[g, k + 1]
            p, n = pos[:, k], neg[:, k]
            inside = np.array([x.threshold >= 0.5 for x in own])
            assert (r.P, r.N, r.tp_cut, r.fp_cut) == (p.sum(), n.sum(), p[inside].sum(), n[inside].sum())
            wins = sum(a * (n[i + 1 :].sum() + n[i] / 2) for i, a in enumerate(p))
            assert abs(r.AUROC - wins / p.sum() / n.sum()) < 1e-12
            if stratified:
                p, n = p * sum(x.pos for x in own) / p.sum(), n * sum(x.neg for x in own) / n.sum()
            pr = resampling.area_pieces(p, n, np.cumsum(p), np.cumsum(n)).sum() / p.sum()
            assert abs(r.AUPR - pr) < 1e-12


def test_two_thousand_replicates_of_different_scores(spark):
    """Twenty thousand different scores: vectors only, in bounded pieces."""
    df = spark.range(20_000).select((F.col("id") / 20_000).alias("score"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    r = metrics.bootstrap_ci(df, "auroc", replicates=2000).first()
    exact = metrics.auroc_ci(metrics.threshold_sweep(df)).first()
    assert abs((r.high - r.low) / (exact.high - exact.low) - 1) < 0.06


def test_published_cost_of_a_forest(spark):
    """TPR .785 and FPR .224 give q .0257, a 1.36 and E -.923 with one model for both sexes."""
    k, tpr, fpr = COST_CONSTANTS, 1662 / (1662 + 454), 9137 / (31719 + 9137)
    found = []
    for months in (6, 12):
        male, female = months / 2, months / 3
        wrongly = 1 + (k["mr"] * male + k["fr"] * female - 1) * fpr
        a = (1 - k["d"]) * wrongly + k["d"] * (k["mdr"] * male + k["fdr"] * female)
        e = spark.range(1).select(cost.economic_cost(F.lit(tpr), F.lit(a)).alias("e")).first().e
        found.append((round(k["d"] * tpr, 4), round(a, 2), round(e, 3)))
    assert found == [(0.0257, 1.36, -0.923), (0.0257, 1.97, 0.026)]


def test_extension_is_at_least_one(spark):
    grid = spark.range(121).select((F.col("id") % 11 / 10).alias("t"), (F.floor(F.col("id") / 11) / 10).alias("f"))
    for sex in ("male", "female", "both"):
        x = cost.interval_extension("t", "f", 6, sex)
        assert grid.agg(F.min(x["a"])).first()[0] >= 1 - 1e-12


def test_gradient_matches_known_derivatives(spark):
    one = spark.range(1).select(F.lit(0.015).alias("q"), F.lit(1.5).alias("a"))
    g = cost.cost_gradient(one, {"q": "q", "atot": "a", "Pm": 2.0, "Pd": 60.0, "F": 1.0, "Fn": 0.107, "rloss": 0.0}).first()
    assert abs(g.d_q + 60 * 0.03269718) < 1e-6
    assert abs(g.d_atot - 2 * (1 - 0.107) / (1 + 0.107 * 0.5) ** 2) < 1e-6


def test_calibration_keeps_empty_bins(scored):
    df, _ = scored
    out = metrics.calibration_bins(df.filter("score < 0.5"), "score", "label")
    assert out.count() == 10 and out.filter("count = 0").count() == 5


def test_cost_with_intervals_has_all_measures(scored):
    df, _ = scored
    named = df.withColumn("run", F.lit("data-both-rf"))
    out = metrics.cost_with_ci(named, "run", [0.2, 0.4, 0.6], replicates=60)
    assert out.count() == 2 + 3 * 13
    wide = {(r.variable, r.type): r.value for r in out.collect()}
    for name in metrics.COST_MEASURES:
        assert wide[name, "low"] <= wide[name, "value"] <= wide[name, "high"]


def test_prediction_table_has_no_ids(scored):
    df, _ = scored
    out = metrics.prediction_table(df)
    assert out.columns == ["g", "score", "label"] and rows(out) == rows(df.drop("id"))


def test_direction_follows_the_medians(scored):
    df, _ = scored
    flipped = df.withColumn("score", 1 - F.col("score"))
    assert metrics.score_direction(df) == ">=" and metrics.score_direction(flipped) == "<="
    a = metrics.auroc(metrics.threshold_sweep(df)).first()[0]
    b = metrics.auroc(metrics.threshold_sweep(flipped, direction="<=")).first()[0]
    assert abs(a - b) < 1e-12
