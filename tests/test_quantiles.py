import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from culturelens.operators import cleaning, quantiles, scaling

PROBS = [0.005, 0.25, 0.5, 0.75, 0.995]


def check(spark, columns):
    df = spark.createDataFrame(pd.DataFrame(columns)).repartition(4)
    found = quantiles.exact_quantiles(df, list(columns), PROBS)
    for name, values in columns.items():
        assert found[name] == pytest.approx(np.quantile(values, PROBS), rel=1e-12, abs=1e-12)


def test_known_bounds(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    bounds = cleaning.fit_clip_bounds(df, ["v"])
    assert bounds["v"] == pytest.approx((4.995, 994.005))
    ends = cleaning.clip(df, bounds).agg(F.min("v"), F.max("v")).first()
    assert tuple(ends) == pytest.approx((4.995, 994.005))


@pytest.mark.parametrize("limit", [quantiles.LISTED, 5])
def test_agrees_with_numpy_also_when_brackets_are_narrowed(spark, monkeypatch, limit):
    monkeypatch.setattr(quantiles, "LISTED", limit)
    rng = np.random.default_rng(3)
    n = 30_000
    hot = np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n) * 5)
    check(spark, {"normal": rng.normal(size=n), "hot": hot, "flat": np.full(n, 2.5),
                  "few": rng.integers(0, 4, n).astype(float), "skewed": rng.exponential(size=n)})


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=40))
def test_small_samples(spark, values):
    check(spark, {"v": np.array(values)})


def test_widens_a_bracket_the_sketch_missed(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "MARGIN", -0.01)
    values = np.random.default_rng(1).normal(size=2_000)
    check(spark, {"v": values})


def test_many_columns_need_no_exploded_rows(spark):
    rng = np.random.default_rng(9)
    check(spark, {f"c{i}": rng.normal(size=400) * i for i in range(13)})
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    numbers = {c: F.col(c) for c in "ab"}
    plan = quantiles._two_step(df, {}, numbers, {}, {}, {})._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_nulls_are_skipped_and_empty_columns_have_no_quantile(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, b double")
    found = quantiles.exact_quantiles(df, ["a", "b"], [0.5])
    assert found == {"a": [2.0], "b": [None]}


def test_kth_smallest(spark):
    df = spark.range(5000).select((F.col("id") * 7 % 5003).cast("double").alias("v"))
    ordered = sorted(i * 7 % 5003 for i in range(5000))
    for k in (1, 1250, 5000):
        assert quantiles.kth_smallest(df, "v", k, 5000) == ordered[k - 1]


def test_approximate_option(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    assert quantiles.exact_quantiles(df, ["v"], [0.5], accuracy=1000)["v"][0] == pytest.approx(500, abs=2)


def test_robust_scaling(spark):
    values = np.random.default_rng(5).normal(3, 2, 500)
    df = spark.createDataFrame(pd.DataFrame({"v": values, "flat": 7.0}))
    scaler = scaling.fit_robust(df, ["v", "flat"])
    out = scaler.apply(df).toPandas()
    q = np.quantile(values, [0.25, 0.5, 0.75])
    assert np.allclose(np.sort(out.v), np.sort((values - q[1]) / (q[2] - q[0])), atol=1e-12)
    assert (out.flat == 0).all()


def test_standard_scaling_and_back(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (6.0,)], "y double")
    target = scaling.fit_standard(df, "y")
    assert (target.mean, target.std) == pytest.approx((3.0, np.std([1, 2, 6])))
    back = df.select("y", target.invert(target.apply("y")).alias("z")).collect()
    assert all(r.y == pytest.approx(r.z) for r in back)
    assert scaling.fit_standard(df.where("y = 2"), "y").std == 1.0
    with pytest.raises(ValueError):
        scaling.fit_standard(df.where("y > 9"), "y")


def test_clip_keeps_missing_values(spark):
    df = spark.createDataFrame(
        [(0, None), (1, float("nan")), (2, 0.0), (3, float("inf")), (4, 2.0)], "i int, v double")
    found = [r.v for r in cleaning.clip(df, {"v": (1.0, 3.0)}).orderBy("i").collect()]
    assert found[0] is None and found[1] != found[1] and found[2:] == [1.0, 3.0, 2.0]
