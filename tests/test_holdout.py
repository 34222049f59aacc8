import numpy as np
import pytest
from pyspark.sql import functions as F

from culturelens.operators import holdout


def groups_of(spark, n):
    return spark.range(n * 5).select((F.col("id") % n + 1).cast("int").alias("g"), "id")


@pytest.mark.parametrize("n,held", [(1, 1), (3, 1), (4, 1), (60, 15)])
def test_number_of_groups(spark, n, held):
    df = groups_of(spark, n)
    split = holdout.hold_out_groups(df, "g")
    assert split.validation(df).select("g").distinct().count() == held
    assert split.train(df).count() + split.validation(df).count() == df.count()


def test_split_is_disjoint_and_complete(spark):
    df = groups_of(spark, 60)
    split = holdout.hold_out_groups(df, "g")
    a = {r.g for r in split.train(df).collect()}
    b = {r.g for r in split.validation(df).collect()}
    assert not a & b and a | b == set(range(1, 61))


def test_many_groups_are_ranked_without_listing_them(spark):
    df = groups_of(spark, 403)
    listed = holdout.hold_out_groups(df, "g")
    counted = holdout.hold_out_groups(df, "g", listed=10)
    for side in ("train", "validation"):
        one = {r.g for r in getattr(listed, side)(df).collect()}
        other = {r.g for r in getattr(counted, side)(df).collect()}
        assert one == other
    assert listed.validation(df).select("g").distinct().count() == 100


def test_same_split_on_any_partitioning(spark):
    df = groups_of(spark, 60)
    one = holdout.hold_out_groups(df, "g").validation(df)
    many = holdout.hold_out_groups(df.repartition(13, "id"), "g").validation(df)
    assert {r.g for r in one.collect()} == {r.g for r in many.collect()}


def test_seeded_draw(spark):
    df = groups_of(spark, 60)
    split = holdout.hold_out_groups(df, "g", method="draw")
    np.random.seed(50)
    want = set(np.random.choice(np.arange(1, 61), size=15, replace=False).tolist())
    assert {r.g for r in split.validation(df).collect()} == want


def test_missing_key_is_a_group_of_its_own(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), (None,)], "g string")
    for method in ("hash", "draw"):
        split = holdout.hold_out_groups(df, "g", method=method)
        assert split.train(df).count() + split.validation(df).count() == 4


def test_empty_table(spark):
    with pytest.raises(ValueError):
        holdout.hold_out_groups(groups_of(spark, 4).where("g > 9"), "g")


def test_row_shares(spark):
    df = spark.range(20_000).withColumn("k", F.col("id").cast("string"))
    outer = holdout.hold_out_rows("k")
    inner = holdout.hold_out_inner("k", 43)
    assert outer.validation(df).count() / 20_000 == pytest.approx(0.25, abs=0.01)
    block = outer.train(df)
    # Independent of the outer split.
    assert inner.validation(block).count() / block.count() == pytest.approx(0.2, abs=0.01)


def test_join_form_agrees_with_the_predicate(spark):
    df = groups_of(spark, 20)
    split = holdout.hold_out_groups(df, "g")
    train, validation = holdout.split_by_groups(df, split.validation(df).select("g"), "g")
    assert train.count() == split.train(df).count()
    assert validation.count() == split.validation(df).count()


def test_draw_of_many_groups(spark):
    df = groups_of(spark, 20_000)
    split = holdout.hold_out_groups(df, "g", method="draw")
    want = np.random.RandomState(50).choice(np.arange(1, 20_001), size=5_000, replace=False)
    assert {r.g for r in split.validation(df).collect()} == set(want.tolist())
    assert split.flag(df).where("split = 'train'").count() == 75_000


def test_split_is_a_filter_without_shuffle(spark):
    df = groups_of(spark, 20)
    train = holdout.hold_out_groups(df, "g").train(df)
    assert "Exchange" not in train._jdf.queryExecution().executedPlan().toString()


def test_split_counts(spark):
    df = groups_of(spark, 4)
    counts = holdout.split_counts(holdout.hold_out_groups(df, "g").flag(df)).collect()
    assert {r.split: r.n_rows for r in counts} == {"train": 15, "validation": 5}


def test_the_draw_numbers_groups_without_python_rows(spark):

    table = spark.range(0, 5000, 1, 7).selectExpr("id * 7919 % 5003 as k").union(
        spark.createDataFrame([(None,)], "k long"))
    held = holdout.hold_out_groups(table, "k", method="draw")
    keys = sorted((r.k for r in table.collect()), key=lambda k: (k is not None, k or 0))
    places = np.random.RandomState(50).choice(len(keys), len(keys) // 4, replace=False)
    assert {r._held for r in held.keys.collect()} == {keys[p] for p in places}
    plan = held.keys._jdf.queryExecution().toString()
    assert "ExternalRDD" not in plan and "Python" not in plan
