import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from culturelens.operators import leakage, selection


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    y = rng.normal(size=400)
    return spark.createDataFrame(pd.DataFrame({
        "Biomass_g_L": y,
        "twin": y * 3 + 1,
        "good": y + rng.normal(size=400),
        "weak": y + 4 * rng.normal(size=400),
        "noise": rng.normal(size=400),
        "flat": 7.0,
        "Specific_Growth_Rate_h": rng.normal(size=400),
        "label": "x",
    }))


def test_leaks_by_name_and_by_correlation(table):
    kept, leaks = leakage.drop_leaks(table)
    assert leaks == ["Specific_Growth_Rate_h", "twin"]
    assert kept.columns == ["Biomass_g_L", "good", "weak", "noise", "flat", "label"]


def test_leak_report_flags(table):
    rows = {r.feature: r for r in leakage.leak_report(table).collect()}
    assert "Biomass_g_L" not in rows and "label" not in rows
    assert rows["twin"].leak and not rows["twin"].known
    assert rows["Specific_Growth_Rate_h"].known and not rows["Specific_Growth_Rate_h"].leak
    assert rows["flat"].r is None and not rows["flat"].leak


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "Biomass_g_L double, x double")
    r = leakage.leak_report(df).first().r
    assert not leakage.leak_report(df, threshold=r).first().leak
    assert leakage.leak_report(df, threshold=r - 1e-9).first().leak


def test_without_a_target_nothing_is_removed(table):
    assert leakage.find_leaks(table.drop("Biomass_g_L")) == []


def test_correlation_skips_incomplete_pairs(spark):
    rows = [(1.0, 2.0), (2.0, None), (3.0, 5.0), (float("nan"), 1.0), (4.0, 4.0)]
    df = spark.createDataFrame(rows, "x double, y double").repartition(3)
    row = leakage.correlations(df, ["x"], "y").first()
    assert row.n == 3
    assert row.r == pytest.approx(np.corrcoef([1, 3, 4], [2, 5, 4])[0, 1])


@pytest.mark.parametrize("parts", [1, 4])
def test_correlation_of_a_constant_is_undefined_on_any_partitioning(spark, parts):
    df = spark.range(100).select(
        F.lit(0.1).alias("x"), F.col("id").cast("double").alias("y")
    ).repartition(parts)
    assert leakage.correlations(df, ["x"], "y").first().r is None
    assert leakage.correlations(df, ["y"], "x").first().r is None


def test_scores_against_the_formula(table):
    names = ["good", "weak", "noise", "flat"]
    scores = {r.feature: r for r in selection.feature_scores(table, names, "Biomass_g_L").collect()}
    pdf = table.toPandas()
    for name in names[:3]:
        r = np.corrcoef(pdf[name], pdf.Biomass_g_L)[0, 1]
        assert scores[name].r == pytest.approx(r, abs=1e-12)
        assert scores[name].f == pytest.approx(r * r / (1 - r * r) * 398, rel=1e-9)
    assert scores["flat"].abs_r is None and scores["flat"].f == 0.0


def test_medians_of_both_rankings(table):
    scores = selection.feature_scores(table, ["good", "weak", "noise", "flat"], "Biomass_g_L")
    by_r = {r.feature: r for r in selection.correlation_ranking(scores).collect()}
    by_f = {r.feature: r for r in selection.f_score_ranking(scores).collect()}
    # Three defined correlations, but four F-scores: only the second also keeps 'weak'.
    assert [k for k, r in by_r.items() if r.selected] == ["good"]
    assert sorted(k for k, r in by_f.items() if r.selected) == ["good", "weak"]


def test_votes_order_and_limit(spark, table):
    scores = selection.feature_scores(table, ["good", "weak", "noise", "flat"], "Biomass_g_L")
    importances = spark.createDataFrame(
        [("noise", 0.5), ("good", 0.4), ("weak", 0.1), ("flat", 0.0)],
        "feature string, importance double",
    )
    ballot = selection.votes(scores, importances)
    assert selection.selected_names(ballot) == ["good", "weak", "noise"]
    assert selection.selected_names(ballot, 2) == ["good", "weak"]
    report = selection.selection_report(ballot).first()
    assert tuple(report)[:6] == (4, 1, 2, 2, 0, 3)
    assert report.first_features == "good,weak,noise"


def test_leak_check_is_one_scan(table):
    plan = leakage.leak_report(table)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Join" not in plan
