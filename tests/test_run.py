from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from culturelens.operators.cleaning import clean_invalid
from culturelens.operators.features import phase_levels
from culturelens.operators.holdout import distinct_groups
from culturelens.operators.leakage import drop_leaks, leak_report
from culturelens.operators.profile import profile
from culturelens.plans import run as run_steps
from culturelens.plans.run import RunConfig, run
from culturelens.streaming.scoring import score_stream

FAST = RunConfig(selectors=("correlation", "f_score"), models=("Linear", "Ridge"))


@pytest.fixture(scope="module")
def fitted(culture):
    result = run(culture, replace(
        FAST, selectors=("correlation", "f_score", "forest"), selector_trees=5, selector_depth=3,
        models=("Linear", "Ridge", "RandomForest", "Boosted", "PenaltyNet", "GatedNet"),
        forest_trees=5, forest_depth=4, boosted_rounds=3, boosted_depth=3, epochs=2,
    ))
    yield result
    result.release()


def test_every_model_and_the_ensemble_are_evaluated(fitted):
    rows = fitted.metrics.orderBy("position").collect()
    assert [r.model for r in rows] == ["Linear", "Ridge", "RandomForest", "Boosted", "PenaltyNet",
                                       "GatedNet", "Ensemble"]
    assert all(r.r2 > 0.5 for r in rows if r.model in ("Linear", "Ridge", "RandomForest", "Ensemble"))
    assert sum(fitted.weights.values()) == pytest.approx(1.0)


def test_leaks_never_become_features(fitted):
    assert fitted.leaks == ["Cell_Concentration_cells_mL", "Optical_Density_750"]
    assert not set(fitted.leaks) & set(fitted.selected)
    assert "Stirrer_Setpoint" not in fitted.selected


def test_score_repeats_the_validation_predictions(fitted, culture):
    columns = ["row_id", *[f"pred_{n}" for n in fitted.names]]
    want = {r.row_id: r for r in fitted.validation.select(columns).collect()}
    scored = fitted.score(culture).select(columns)
    found = {r.row_id: r for r in scored.collect() if r.row_id in want}
    assert len(found) == len(want)
    for key, row in list(want.items())[:200]:
        assert tuple(found[key])[1:] == pytest.approx(tuple(row)[1:])


def test_score_keeps_the_columns_of_its_rows(fitted, culture):
    raw = culture.drop("row_id", "Scenario").limit(20)
    assert fitted.score(raw).columns == [*raw.columns, *[f"pred_{n}" for n in fitted.names]]


def test_reports(spark, fitted):
    report = fitted.report(spark).first()
    assert report.n_leaks_removed == 2 and report.n_features == len(fitted.selected)
    assert fitted.top_features(spark).count() <= 10
    assert {r.feature for r in fitted.importances.collect()} == set(fitted.selected)


def test_scoring_a_stream(spark, fitted, culture, tmp_path):
    culture.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(culture.schema).parquet(str(tmp_path / "in"))
    query = (
        score_stream(stream, fitted).writeStream.format("memory").queryName("scored")
        .outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = spark.table("scored").agg(F.count("*"), F.avg("pred_Linear")).first()
    want = fitted.score(culture).agg(F.count("*"), F.avg("pred_Linear")).first()
    assert got[0] == want[0] and got[1] == pytest.approx(want[1])
    with pytest.raises(ValueError):
        score_stream(culture, fitted)


@pytest.mark.parametrize("changes", [
    {"fit_on": "train"}, {"include_phase": False}, {"target_nulls": "drop"},
    {"inner_split": "group"}, {"accuracy": 1000}, {"group_method": "draw"},
    {"max_features": 2, "optional": ("michaelis_menten_light",)},
])
def test_options(culture, changes):
    result = run(culture, replace(FAST, **changes))
    assert all(r.r2 > 0.5 for r in result.metrics.collect())
    if "max_features" in changes:
        assert len(result.selected) == 2
    result.release()


def test_tables_without_key_or_row_id(culture):
    result = run(culture.drop("row_id", "Scenario", "Growth_Phase", "Nutrients_g_L"), FAST)
    assert all(r.r2 > 0.5 for r in result.metrics.collect())
    result.release()


def test_result_does_not_depend_on_the_partitioning(culture):
    one = run(culture.coalesce(1), FAST)
    many = run(culture.repartition(11, "row_id"), FAST)
    assert one.selected == many.selected and one.bounds == many.bounds
    a, b = (r.metrics.orderBy("position").collect() for r in (one, many))
    for left, right in zip(a, b):
        assert left.r2 == pytest.approx(right.r2, abs=1e-9)
    one.release()
    many.release()


def test_cached_rows_of_a_task_are_bounded(spark, culture, monkeypatch):
    few = culture.coalesce(2)
    plain = run(few, FAST)
    monkeypatch.setattr(run_steps, "TASK_ROWS", 400)
    bounded = run(few, FAST)
    n = culture.count()
    sizes = [r["count"] for r in bounded.cached[0].groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n and max(sizes) < 800 and len(sizes) >= n // 800
    for column in ("r2", "rmse", "bias"):
        want, got = ([r[column] for r in f.metrics.orderBy("position").collect()]
                     for f in (plain, bounded))
        assert got == pytest.approx(want, rel=1e-6, abs=1e-9)
    plain.release()
    bounded.release()


@pytest.mark.parametrize("drop", [(), ("Biomass_g_L",), ("Biomass_g_L", "Growth_Phase")])
def test_profile_counts_the_rows(culture, drop):
    some = culture.drop(*drop)
    for nulls in ("zero", "drop"):
        seen = profile(some, target_nulls=nulls)
        assert seen.n_rows == some.count()
        seen.release()


def test_the_source_is_scanned_twice(spark, culture):
    scanned = spark.sparkContext.accumulator(0)

    def seen(row):
        scanned.add(1)
        return row

    source = spark.createDataFrame(culture.rdd.map(seen), culture.schema)
    result = run(source, FAST)
    assert result.metrics.count() == 3
    assert scanned.value == 2 * culture.count()
    result.release()


@pytest.mark.parametrize("target_nulls", ["zero", "drop"])
def test_profile_equals_its_parts(spark, culture, target_nulls):
    spoiled = culture.withColumns({
        "Scenario": F.when(F.col("Scenario") != 7, F.col("Scenario")),
        "Biomass_g_L": F.when(F.coalesce("Scenario", F.lit(7)) != 9, F.col("Biomass_g_L")),
    })
    seen = profile(spoiled, target_nulls=target_nulls)
    leaks = seen.leaks(spoiled.columns, 0.95, ["Cell_Concentration_cells_mL"])
    assert leaks == drop_leaks(spoiled)[1]
    report = {r.feature: r.r for r in leak_report(spoiled).where("not known").collect()}
    assert report.keys() == seen.correlations.keys()
    assert all(seen.correlations[c] == (None if r is None else pytest.approx(r, abs=1e-12))
               for c, r in report.items())
    assert seen.levels == phase_levels(spoiled)
    cleaned = clean_invalid(spoiled, target_nulls=target_nulls)
    want = sorted(r[0] for r in distinct_groups(cleaned, "Scenario").collect())
    assert sorted(r[0] for r in seen.groups.collect()) == want
    assert (9 in want) == (target_nulls == "zero") and 0 in want and 7 not in want
    seen.release()
    empty = profile(spoiled.where("false"))
    assert empty.levels == [] and empty.groups.count() == 0 and not empty.correlations
    empty.release()
