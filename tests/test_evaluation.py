import numpy as np
import pytest
from pyspark.sql import functions as F

from culturelens.operators import chart_data, ensemble, evaluation


def table(spark, y, **preds):
    names = ["y", *[f"pred_{m}" for m in preds]]
    rows = list(zip(map(float, y), *[map(float, p) for p in preds.values()]))
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(2)


def test_metrics_by_hand(spark):
    y, p = np.array([0.0, 1.0, 2.0, 5.0]), np.array([0.5, 1.0, 1.0, 5.5])
    row = evaluation.evaluate(table(spark, y, A=p), ["A"], "y").first()
    sse, sst = ((y - p) ** 2).sum(), ((y - y.mean()) ** 2).sum()
    assert row.r2 == pytest.approx(1 - sse / sst) and row.nse == pytest.approx(row.r2)
    assert row.rmse == pytest.approx(np.sqrt(sse / 4))
    assert row.mae == pytest.approx(0.5)
    assert row.mape == pytest.approx(np.mean(np.abs((y - p) / (y + 1e-10))) * 100)
    assert row.bias == pytest.approx(0.0, abs=1e-12)
    assert row.risk == "LOW"


@pytest.mark.parametrize("r2,risk,colour", [(0.995, "HIGH", "red"), (0.98, "MEDIUM", "orange"),
                                            (0.97, "LOW", "green"), (0.99, "MEDIUM", "orange")])
def test_risk_and_colour_limits(spark, r2, risk, colour):
    df = spark.createDataFrame([(r2,)], "r2 double")
    found = df.select(evaluation.risk_level(F.col("r2")), chart_data.colour_class(F.col("r2")))
    assert tuple(found.first()) == (risk, colour)


def test_constant_target(spark):
    rows = evaluation.evaluate(table(spark, [3, 3], A=[3, 3], B=[3, 4]), ["A", "B"], "y").collect()
    found = {r.model: (r.r2, r.nse) for r in rows}
    assert found == {"A": (1.0, None), "B": (0.0, None)}


def test_best_model_takes_the_first_on_ties(spark):
    df = table(spark, [1, 2, 3], A=[3, 2, 1], B=[1, 2, 3.5], C=[1, 2, 3.5])
    assert evaluation.best_model(evaluation.evaluate(df, ["A", "B", "C"], "y")).first().model == "B"


@pytest.mark.parametrize("errors,want", [
    ([1.0, 2.0, 4.0], [4 / 7, 2 / 7, 1 / 7]), ([0.0, 1.0], [0.0, 1.0]), ([0.0, 0.0], [0.5, 0.5]),
])
def test_weights(spark, errors, want):
    rows = [(i, f"m{i}", e) for i, e in enumerate(errors)]
    frame = spark.createDataFrame(rows, "position int, model string, mse double")
    found = ensemble.collect_weights(ensemble.model_weights(frame))
    assert list(found.values()) == pytest.approx(want)
    assert sum(found.values()) == pytest.approx(1.0)


def test_errors_and_ensemble(spark):
    df = table(spark, [1, 2], A=[1, 4], B=[2, 2])
    errors = {r.model: r.mse for r in ensemble.holdout_errors(df, ["A", "B"], "y").collect()}
    assert errors == {"A": 2.0, "B": 0.5}
    total = df.select(ensemble.ensemble_prediction({"A": 0.25, "B": 0.75}).alias("e"))
    assert sorted(r.e for r in total.collect()) == [1.75, 2.5]


def test_histogram_equals_numpy(spark):
    values = np.random.default_rng(8).normal(size=700)
    df = spark.createDataFrame([(float(v),) for v in values], "e double")
    rows = chart_data.histogram(df, "e").orderBy("bin").collect()
    n, edges = np.histogram(values, bins=30)
    density, _ = np.histogram(values, bins=30, density=True)
    assert [r.n for r in rows] == n.tolist()
    assert [r.density for r in rows] == pytest.approx(density.tolist())
    assert [r.lo for r in rows] == pytest.approx(edges[:-1].tolist())


def test_histogram_of_equal_values(spark):
    df = spark.createDataFrame([(2.0,)] * 3, "e double")
    rows = chart_data.histogram(df, "e").orderBy("bin").collect()
    n, edges = np.histogram([2.0] * 3, bins=30)
    assert [r.n for r in rows] == n.tolist() and rows[0].lo == pytest.approx(edges[0])


def test_normal_curve(spark):
    values = [1.0, 2.0, 4.0]
    rows = chart_data.normal_curve(
        spark.createDataFrame([(v,) for v in values], "e double"), "e"
    ).orderBy("point").collect()
    x = np.linspace(1, 4, 100)
    mu, sd = np.mean(values), np.std(values)
    assert [r.x for r in rows] == pytest.approx(x.tolist())
    want = np.exp(-((x - mu) ** 2) / (2 * sd**2)) / (sd * np.sqrt(2 * np.pi))
    assert [r.density for r in rows] == pytest.approx(want.tolist())


def test_chart_frames(spark):
    df = table(spark, [1, 5], A=[0, 4])
    assert tuple(chart_data.parity_range(df, "y", "pred_A").first()) == (0.0, 5.0)
    assert {tuple(r) for r in chart_data.residuals(df, "y", "pred_A").collect()} == {(0, 1), (4, 1)}
    metrics = evaluation.evaluate(
        table(spark, [1, 2], **{m: [1, 2] for m in "ABCDE"}), list("ABCDE"), "y"
    )
    assert [r.model for r in chart_data.multi_metric(metrics).orderBy("model").collect()] == list("ABCD")
