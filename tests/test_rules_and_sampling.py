"""Small hand-made frames for trimming, balance, splits and filters."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from donorflow.operators import joins, rules, sampling, series

SCHEMA = "donor string, dateonly date, Hb_deferral boolean, don_id long"
ORDER = ("dateonly", "don_id")


def frame(spark, *series_list):
    data, n = [], 0
    for donor, flags in series_list:
        for i, flag in enumerate(flags):
            n += 1
            data.append((donor, dt.date(2020, 1, 1 + i), bool(flag), n))
    return spark.createDataFrame(data, SCHEMA)


@pytest.mark.parametrize("flags,kept", [
    ([1, 1, 1], 3), ([0, 1, 0, 0], 2), ([0], 0), ([1], 0), ([1, 0, 0], 0), ([1, 0, 1, 0], 3), ([0, 0], 2),
])
def test_trim(spark, flags, kept):
    df = frame(spark, ("a", flags))
    assert series.trim_after_last_deferral(df.orderBy(F.desc("dateonly")), order=ORDER).count() == kept


def test_trim_empty_and_mixed(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert series.trim_after_last_deferral(empty, order=ORDER).count() == 0
    df = frame(spark, ("a", [0, 1, 0]), ("b", [0, 0, 0]), ("c", [1, 0]))
    assert rows(series.trim_after_last_deferral(df, order=ORDER).groupBy("donor").count()) == [("a", 2), ("b", 3)]


@pytest.mark.parametrize("target,some,none", [(0.5, 3, 3), (1.0, 3, 0), (0.0, 0, 5), (0.25, 1, 5)])
def test_balance(spark, target, some, none):
    df = frame(spark, *[(f"s{i}", [0, 1]) for i in range(3)], *[(f"n{i}", [0, 0]) for i in range(5)])
    out = sampling.balance_classes(df, target, 4).groupBy("donor").agg(F.max("Hb_deferral").alias("e"))
    got = {r.e: r.n for r in out.groupBy("e").agg(F.count("*").alias("n")).collect()}
    assert (got.get(True, 0), got.get(False, 0)) == (some, none)


def test_balance_three_deferred_one_accepted(spark):
    df = frame(spark, ("a", [1]), ("b", [1]), ("c", [1]), ("d", [0]))
    assert sampling.balance_classes(df, 0.5, 1).count() == 2


def test_three_way_split_is_exact_and_disjoint(spark, tables):
    out = sampling.split_three_way(tables.donations(), "donor", 42).cache()
    n = out.select("donor").distinct().count()
    sizes = {r.label: r.n for r in out.groupBy("label").agg(F.countDistinct("donor").alias("n")).collect()}
    assert sizes == {"train": int(0.64 * n), "validate": int(0.16 * n), "test": n - int(0.64 * n) - int(0.16 * n)}
    assert out.groupBy("donor").agg(F.countDistinct("label").alias("k")).agg(F.max("k")).first()[0] == 1
    again = sampling.split_three_way(tables.donations().repartition(7), "donor", 42)
    assert rows(out, "don_id", "label") == rows(again, "don_id", "label")


def test_stratified_sample_has_exact_size(spark, tables):
    j = tables.joined().select("donor", "label", "sex")
    assert sampling.stratified_sample(j, False, 30, 2).select("donor").distinct().count() == 30


def test_upsample_balances_and_keeps_rows(spark):
    df = frame(spark, ("a", [0] * 11), ("b", [1] * 4))
    out = sampling.upsample_minority(df, "Hb_deferral", 1, "don_id")
    counts = {tuple(r)[0]: r["count"] for r in out.groupBy("Hb_deferral").count().collect()}
    assert counts == {True: 11, False: 11}
    per = [r["count"] for r in out.filter("Hb_deferral").groupBy("don_id").count().collect()]
    assert len(per) == 4 and max(per) - min(per) <= 1


def test_smote_points_lie_between_minority_rows(spark, tables):
    j = tables.joined().withColumn("low", F.col("Hb_deferral")).select("don_id", "low", "age", "volume_drawn")
    out = sampling.smote(j, ["age", "volume_drawn"], "low", "don_id", seed=3).cache()
    sizes = [r["count"] for r in out.groupBy("low").count().collect()]
    assert sizes[0] == sizes[1]
    box = j.filter("low").agg(F.min("age"), F.max("age"), F.min("volume_drawn"), F.max("volume_drawn")).first()
    made = out.filter("synthetic").agg(F.min("age"), F.max("age"), F.min("volume_drawn"), F.max("volume_drawn")).first()
    assert made[0] >= box[0] and made[1] <= box[1] and made[2] >= box[2] and made[3] <= box[3]


@pytest.mark.parametrize("axes,count,cell", [(3, 1500, 60), (8, 800, 100), (1, 4, 512)])
def test_neighbors_equal_all_pairs(spark, axes, count, cell):
    """Recall is one, with a fifth of all rows equal, ties, an edge far away, and rows that lack a value."""
    rng = np.random.default_rng(axes)
    x = np.round(rng.normal(size=(count, axes)) * rng.choice([1, 10], size=(count, 1)), 1)
    x[: count // 5] = x[0]
    x[-3:, 0] = 1000
    names = [f"f{i}" for i in range(axes)]
    odd = [(count, *[None] * axes), (count + 1, *[float("nan")] * axes)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + odd, "id long, " + ", ".join(f"{n} double" for n in names))
    got = {r.key: [(n.d, n.key) for n in r.near] for r in sampling.nearest_neighbors(df, names, "id", 5, cell).collect()}
    assert len(got) == count
    for i in range(count):
        d = np.zeros(count)
        for j in range(axes):
            d += (x[i, j] - x[:, j]) * (x[i, j] - x[:, j])
        d = np.sqrt(d)
        d[i] = np.inf
        best = np.lexsort((np.arange(count), d))[: min(5, count - 1)]
        assert got[i] == [(float(d[q]), int(q)) for q in best]


def test_folds_keep_subjects_together(spark, tables):
    out = sampling.kfold_by_donor(tables.donations(), "donor", 4, 1)
    assert out.groupBy("donor").agg(F.countDistinct("fold").alias("k")).agg(F.max("k")).first()[0] == 1


def test_common_donors(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (9, "z")], "donor int, v string")
    b = spark.createDataFrame([(1,), (2,), (5,)], "donor int")
    x, y = joins.common_donor_reduce(a, b)
    assert rows(x, "donor") == [(1,), (2,)] and rows(y) == [(1,), (2,)]


def test_suspicious_last(spark):
    df = frame(spark, ("a", [0, 1, 0]), ("b", [0, 1, 0]), ("c", [1])).withColumn("volume_drawn", F.when(F.col("donor") == "a", 450).otherwise(50))
    assert rows(rules.drop_suspicious_last(df, ORDER).groupBy("donor").count()) == [("a", 2), ("b", 3), ("c", 1)]


def test_too_soon_keeps_regular_intervals(spark):
    df = spark.createDataFrame([(61, "male"), (62, "male"), (91, "female"), (92, "female"), (None, "male")], "days_to_previous_fb int, sex string")
    assert rules.drop_too_soon(df).count() == 2


def test_space_is_cut_no_finer_than_needed(spark):
    """A cell slightly too large falls into two, not sixteen: each cell costs a task some time."""
    from donorflow.operators import neighbors

    points = spark.range(700).selectExpr("id AS pid", "array(CAST(id * 7919 % 700 AS DOUBLE), 0.0D) AS x", "array(id) AS keys")
    cells, tree = neighbors.cut_space(points, 2, 512)
    sizes = [r["count"] for r in cells.groupBy("cell").count().collect()]
    assert sum(sizes) == 700 and len(sizes) == 2 and max(sizes) <= 512
    assert tree.filter("leaf").count() == 2


def test_space_is_cut_where_most_points_share_the_largest_value(spark):
    from donorflow.operators import neighbors

    points = spark.range(100).selectExpr("id AS pid", "array(CAST(least(id, 20) AS DOUBLE), CAST(id AS DOUBLE) / 1000) AS x", "array(id) AS keys")
    cells, _ = neighbors.cut_space(points, 2, 20)
    assert max(r["count"] for r in cells.groupBy("cell").count().collect()) <= 20
