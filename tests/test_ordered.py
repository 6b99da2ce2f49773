"""A cut subject, or a cut global order, gives what one window gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from donorflow.operators import ordered
from donorflow.operators.ordered import HotKeys, Lag, RunMax, RunSum, SpanSum, Total, Whole, attach, running


@pytest.fixture(scope="module")
def events(tables):
    d = tables.donations()
    # one subject owns a third of all rows, with equal times inside
    donor = F.when(F.col("don_id") % 3 == 0, -1).otherwise(F.col("donor"))
    d = d.withColumn("donor", donor).withColumn("low", F.col("Hb") < 130)
    return d.withColumn("clock", F.when(F.col("don_id") % 10 == 0, 883612800).otherwise(F.col("clock"))).cache()


def specs():
    low = F.when(F.col("low"), 1).otherwise(0)
    return dict(
        a=Lag("Hb", 1, 0.0), b=Lag("Hb", 4), c=RunSum(low), d=RunMax(F.when(F.col("low"), F.col("dateonly")), current=False),
        e=Total("don_id"), f=Whole(F.count(F.lit(1))), g=Whole(F.max("Hb"), ("dateonly",)), h=SpanSum(low, "clock", 63_115_200),
        i=RunSum(F.lit(1), current=False), j=RunMax("Hb"),
    )


@pytest.mark.parametrize("chunk_rows", [4, 60])
def test_hot_subject_equals_window(events, chunk_rows):
    order = ["clock", "don_id"]
    wanted = specs()
    plain = attach(events, "donor", order, HotKeys(), **wanted)
    cut = attach(events, "donor", order, chunk_rows=chunk_rows, **wanted)
    assert ordered.hot_keys(events, "donor", chunk_rows).rows >= 500
    assert rows(plain, "don_id", *wanted) == rows(cut, "don_id", *wanted)


def test_global_order_equals_window(events):
    spec = dict(r=RunSum(F.lit(1)), l=Lag("don_id", 2), t=Total("volume_drawn"))
    assert rows(running(events, ["Hb", "don_id"], **spec), "don_id", *spec) == rows(
        running(events, ["Hb", "don_id"], chunk_rows=40, **spec), "don_id", *spec
    )
    assert rows(running(events, ["Hb", "don_id"], "status", **spec), "don_id", *spec) == rows(
        running(events, ["Hb", "don_id"], "status", chunk_rows=40, **spec), "don_id", *spec
    )


def test_chunks_follow_the_rows(events):
    cut = ordered.in_chunks(events, ["clock", "don_id"], chunk_rows=100).cache()
    sizes = cut.groupBy("__chunk").agg(F.count("*").alias("n"), F.min("__step").alias("low"), F.max("__step").alias("high"), F.min("clock").alias("a"), F.max("clock").alias("b")).orderBy("__chunk").collect()
    assert sum(r.n for r in sizes) == 1500 and 10 <= len(sizes) <= 15 and max(r.n for r in sizes) < 400
    assert all(r.low == 0 and r.high == r.n - 1 for r in sizes) and all(x.b <= y.a for x, y in zip(sizes, sizes[1:]))


def test_many_hot_keys_stay_a_table(events):
    hot = ordered.hot_keys(events, "donor", 3)
    assert hot.keys.count() > 50
    plan = hot.split(events, "donor")[0][0]._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan and "INSET" not in plan and " IN (" not in plan


def test_quantiles_are_type_seven(events):
    values = np.array([r[0] for r in events.select("Hb").collect()])
    got = ordered.exact_quantiles(events, "Hb", {"a": 0.05, "b": 0.5, "c": 0.731}, chunk_rows=50).first()
    assert np.allclose([got.a, got.b, got.c], np.quantile(values, [0.05, 0.5, 0.731]))


def test_hash_ranks_are_a_permutation(spark, events):
    keys = events.select("don_id", "status")
    ranked = ordered.hash_ranks(keys, "don_id", 5, "status").cache()
    for r in ranked.groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("rank").alias("d"), F.max("rank").alias("m"), F.max("size").alias("s")).collect():
        assert r.n == r.d == r.m == r.s
    again = ordered.hash_ranks(keys.repartition(3), "don_id", 5, "status")
    assert rows(ranked) == rows(again)


def test_uniform_and_gaussian_moments(spark):
    f = spark.range(20_000).select(ordered.uniform(1, "id").alias("u"), ordered.gaussian(1, "id").alias("g"))
    r = f.agg(F.avg("u"), F.min("u"), F.max("u"), F.avg("g"), F.stddev("g")).first()
    assert abs(r[0] - 0.5) < 0.01 and r[1] > 0 and r[2] < 1 and abs(r[3]) < 0.03 and abs(r[4] - 1) < 0.03
