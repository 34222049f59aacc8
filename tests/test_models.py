import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from culturelens.operators import boosting
from culturelens.operators import networks as nets
from culturelens.operators import regressors as reg
from culturelens.operators.workers import MANY, settle

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    y = x @ [1.5, -2.0, 0.3] + 0.7 + 0.1 * rng.normal(size=300)
    return x, y


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y = data
    table = pd.DataFrame(x, columns=NAMES).assign(y=y, row_id=[f"r{i}" for i in range(len(y))])
    return spark.createDataFrame(table).repartition(4, "row_id").persist()


def predicted(model, rows):
    return model.predict(rows, "p").toPandas().sort_values("row_id").p.to_numpy()


def ordered(rows):
    table = rows.toPandas().sort_values("row_id")
    return table[NAMES].to_numpy(), table.y.to_numpy()


@pytest.mark.parametrize("alpha", [0.0, 1.0, 50.0])
def test_linear_models_equal_the_closed_form(rows, alpha):
    x, y = ordered(rows)
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
    model = reg.fit_ridge(rows, NAMES, "y", alpha) if alpha else reg.fit_ols(rows, NAMES, "y")
    assert np.allclose(predicted(model, rows), xc @ w + y.mean(), atol=1e-9)


def test_collinear_features(rows):
    twice = rows.withColumn("d", F.col("a") + F.col("b"))
    both = predicted(reg.fit_ols(twice, [*NAMES, "d"], "y"), twice)
    assert np.allclose(both, predicted(reg.fit_ols(rows, NAMES, "y"), rows), atol=1e-6)


def test_ridge_on_a_constant_label(rows):
    flat = rows.withColumn("y", F.lit(2.0))
    assert np.allclose(predicted(reg.fit_ridge(flat, NAMES, "y"), flat), 2.0)


def test_single_lines(rows):
    x, y = ordered(rows)
    lines = reg.fit_lines(rows.withColumn("flat", F.lit(1.0)), ["a", "flat"], "y")
    assert lines["a"] == pytest.approx(tuple(np.polyfit(x[:, 0], y, 1)))
    assert lines["flat"] == pytest.approx((0.0, y.mean()))


def test_forest_stump_finds_the_best_split(spark):
    table = spark.createDataFrame(
        [(float(i), float(i % 3), 1.0 if i < 12 else 5.0, f"r{i}") for i in range(40)],
        "a double, b double, y double, row_id string",
    )
    model = reg.fit_forest(table, ["a", "b"], "y", "row_id", trees=5, depth=1)
    out = model.predict(table, "p").toPandas()
    assert out[out.a < 10].p.max() < 2.0 and out[out.a > 14].p.min() > 4.5
    assert model.importances[0] == pytest.approx(1.0)


def test_boosting_beats_the_mean_and_reports_importances(spark, rows):
    _, y = ordered(rows)
    model = boosting.fit_boosted(rows, NAMES, "y", "row_id", rounds=25, depth=3, rate=0.2)
    assert np.mean((predicted(model, rows) - y) ** 2) < 0.3 * y.var()
    table = [r.feature for r in reg.importance_table(spark, model, top=2).collect()]
    assert set(table) == {"a", "b"}


def test_no_importance_table_for_linear_models(spark, rows):
    assert reg.importance_table(spark, reg.fit_ols(rows, NAMES, "y")) is None


def spec_for(kind, **changes):
    moments = ((0.1, 0.2, -0.1), (1.1, 0.9, 1.0)) if kind == "dense" else ((), ())
    return nets.NetSpec(kind, *moments, floor=-0.2, **changes)


@pytest.mark.parametrize("kind", ["dense", "gated"])
def test_gradient_against_finite_differences(data, kind):
    x, y = data[0][:40], data[1][:40]
    seeds = np.arange(40, dtype=np.int64) * 7919
    spec, params = spec_for(kind), nets.initial_params(kind, 3, seed=4)
    _, grad = nets.loss_and_gradient(spec, params, x, y, seeds, epoch=3)
    flat, g = nets.pack(params), nets.pack({k: grad[k] for k in params})
    for i in np.random.default_rng(0).choice(flat.size, 60, replace=False):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        up, _ = nets.loss_and_gradient(spec, nets.unpack(flat + step, params), x, y, seeds, 3)
        down, _ = nets.loss_and_gradient(spec, nets.unpack(flat - step, params), x, y, seeds, 3)
        assert g[i] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-3)


@pytest.mark.parametrize("arity", [64, 2])
def test_gradient_job_does_not_depend_on_the_partitioning(rows, arity):
    both = [(spec_for(k), nets.initial_params(k, 3, seed=4)) for k in ("dense", "gated")]
    seeded = rows.withColumn(nets.ROW_SEED, F.xxhash64("row_id"))
    one = nets.gradient_job(seeded.coalesce(1), both, NAMES, "y", 5)
    many = nets.gradient_job(seeded.repartition(9), both, NAMES, "y", 5, arity=arity)
    for net, a, b in zip(both, one, many):
        alone = nets.gradient_job(seeded, [net], NAMES, "y", 5)[0]
        assert a[0] == pytest.approx(b[0], rel=1e-12) == pytest.approx(alone[0], rel=1e-12)
        assert np.allclose(a[1], b[1], atol=1e-12) and np.allclose(a[1], alone[1], atol=1e-12)


@pytest.mark.parametrize("kind", ["dense", "gated"])
def test_gradients_of_blocks_in_one_room_add_up(data, kind):
    """Blocks of other sizes work in the same arrays; none sees what one before left there."""
    x, y = data
    seeds = np.arange(len(y), dtype=np.int64) * 977
    spec, params, room = spec_for(kind), nets.initial_params(kind, 3, seed=6), nets.Room()
    loss, grad = nets.loss_and_gradient(spec, params, x, y, seeds, 2)
    parts = [slice(0, 130), slice(130, 137), slice(137, 300)]
    found = [nets.loss_and_gradient(spec, params, x[s], y[s], seeds[s], 2, room) for s in parts]
    assert loss == pytest.approx(sum(part for part, _ in found), rel=1e-12)
    for name in params:
        assert np.allclose(grad[name], sum(part[name] for _, part in found), atol=1e-9)


def test_one_exponential_gives_sigmoid_and_tanh():
    x = np.concatenate([np.linspace(-40, 40, 4001), [-1e6, -750.0, 0.0, 750.0, 1e6]])
    sigmoid, tanh = -x, 2.0 * x
    nets._one_over_exp_plus_one(sigmoid)
    nets._one_over_exp_plus_one(tanh)
    assert np.allclose(sigmoid, 0.5 * (1 + np.tanh(0.5 * x)), rtol=0, atol=1e-15)
    assert np.allclose(1 - 2 * tanh, np.tanh(x), rtol=0, atol=1e-15)


def test_workers_leave_what_they_imported_out_of_collections(spark):
    def run(found):
        import gc

        import pandas  # noqa: F401 - a worker that scores holds its objects
        list(found)
        settle()
        return [(gc.get_freeze_count(), len(gc.get_objects(2)))]

    for _ in range(3):      # the first task of a worker comes before its first collection
        seen = spark.sparkContext.parallelize(range(4), 1).mapPartitions(run).first()
    assert seen[0] > MANY > seen[1]


def test_rows_end_in_the_nodes_of_a_plain_descent():
    rng = np.random.default_rng(5)
    for _ in range(40):
        depth, width = rng.integers(1, 6), rng.integers(1, 9)
        size = 2 ** (depth + 1) - 1
        column, cut = np.full(size, -1), rng.integers(0, 255, size)
        for k in range(2**depth - 1):
            if (k == 0 or column[(k - 1) // 2] >= 0) and rng.random() < 0.8:
                column[k] = rng.integers(0, width)
        bins = np.asfortranarray(rng.integers(0, 256, (50, width)).astype(np.uint8))
        for levels in (None, *range(depth + 1)):
            want = []
            for row in bins:
                node = 0
                for _ in range(depth if levels is None else levels):
                    if column[node] >= 0:
                        node = 2 * node + 1 + (row[column[node]] > cut[node])
                want.append(node)
            assert boosting.nodes_of((column, cut, None, None), bins, levels).tolist() == want


def test_forest_is_the_same_whether_memory_holds_the_nodes(rows, monkeypatch):
    found, asked = [], []
    plain = reg.RandomForestRegressor
    monkeypatch.setattr(reg, "RandomForestRegressor", lambda **k: asked.append(k) or plain(**k))
    for room in (10**9, 0):
        monkeypatch.setattr(reg, "storage_bytes", lambda spark, room=room: room)
        model = reg.fit_forest(rows, NAMES, "y", "row_id", trees=5, depth=5, memory_mb=1)
        found.append((model.importances, predicted(model, rows).tolist()))
    assert [k["cacheNodeIds"] for k in asked] == [True, False]
    assert np.allclose(found[0][0], found[1][0], rtol=1e-12)
    assert np.allclose(found[0][1], found[1][1], rtol=1e-12)


def test_dropout_rate_and_scale():
    mask = nets.keep_mask(np.arange(5000, dtype=np.int64), 1, 0, 20, 0.3)
    assert (mask == 0).mean() == pytest.approx(0.3, abs=0.01)
    assert mask.max() == pytest.approx(1 / 0.7)
    other = nets.keep_mask(np.arange(5000, dtype=np.int64), 2, 0, 20, 0.3)
    assert (mask != other).mean() > 0.3


def test_penalty_only_below_the_floor(data):
    x, y = data[0][:20], data[1][:20]
    params = nets.initial_params("dense", 3, seed=1)
    spec = spec_for("dense", dropout=False)
    pred, _ = nets.forward(spec, params, x)
    loss, _ = nets.loss_and_gradient(spec, params, x, y)
    below = np.maximum(-0.2 - pred, 0).sum()
    assert loss == pytest.approx(((pred - y) ** 2).sum() + 0.5 * below)


@pytest.mark.parametrize("kind", ["dense", "gated"])
def test_training_lowers_the_error_and_keeps_the_best_checkpoint(rows, monkeypatch, kind):
    monkeypatch.setattr(nets, "LEARNING_RATE", 0.03)
    seen = []
    model = nets.fit_net(rows, rows, NAMES, "y", "row_id", kind, epochs=25, check_every=6,
                         history=lambda *h: seen.append(h))
    assert [e for e, _, _ in seen] == [0, 6, 12, 18, 24]
    _, y = ordered(rows)
    error = np.mean((predicted(model, rows) - y) ** 2)
    assert error == pytest.approx(min(h for _, _, h in seen), rel=1e-9)
    assert error < y.var()


@pytest.mark.parametrize("kind", ["dense", "gated"])
def test_native_scores_equal_the_forward_pass_without_python(rows, kind):
    spec, params = spec_for(kind), nets.initial_params(kind, 3, seed=4)
    scored = nets.net_regressor("n", spec, params, NAMES, native=True).predict(rows, "p")
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    x, _ = ordered(rows)
    got = scored.toPandas().sort_values("row_id").p.to_numpy()
    assert np.allclose(got, nets.forward(spec, params, x)[0], atol=1e-9)


@pytest.mark.parametrize("kind", ["dense", "gated"])
def test_native_scores_are_plain_arithmetic_and_keep_all_columns(rows, kind):
    spec, params = spec_for(kind), nets.initial_params(kind, 3, seed=4)
    regressor = nets.net_regressor("n", spec, params, NAMES, native=True)
    holed = rows.withColumn(NAMES[0], F.when(F.col("row_id") != rows.first().row_id, F.col(NAMES[0])))
    scored = regressor.predict(holed, "p")
    assert scored.columns == [*rows.columns, "p"] and scored.count() == rows.count()
    assert "lambda" not in scored._jdf.queryExecution().optimizedPlan().toString().lower()
    twice = regressor.predict(scored.withColumnRenamed("p", "q"), "p")
    assert twice.where(~F.col("p").eqNullSafe(F.col("q"))).count() == 0


def test_networks_go_on_from_a_written_checkpoint(rows, tmp_path):
    def fit(epochs, folder=None):
        return nets.fit_nets(rows, rows, NAMES, "y", "row_id", ["dense", "gated"], epochs=epochs,
                             check_every=3, folder=folder, history=lambda *h: seen.append(h))

    seen = []
    whole = [predicted(m, rows) for m in fit(9)]
    seen = []
    fit(5, str(tmp_path))                    # cut after a checkpoint at epoch 4
    first = len(seen)
    resumed = [predicted(m, rows) for m in fit(9, str(tmp_path))]
    assert {e for _, e, *_ in seen[first:]} == {6, 8}
    assert np.allclose(whole, resumed, atol=1e-9)


# Boosted trees


def plain_boosting(x, y, cuts, rounds, depth, rate, l1, l2):
    """The same trees by plain loops over every cut of every node."""
    def shrunk(g):
        return np.sign(g) * max(abs(g) - l1, 0)

    pred = np.full(len(y), y.mean())
    for _ in range(rounds):
        residual = np.rint((y - pred) * boosting.UNIT) / boosting.UNIT
        nodes = [np.arange(len(y))]
        step = np.zeros(len(y))
        for _ in range(depth):
            after = []
            for rows in nodes:
                best = (1e-6, None, None)
                g, n = residual[rows].sum(), len(rows)
                for k, edges in enumerate(cuts):
                    for c in edges:
                        left = x[rows, k] < c
                        if not 0 < left.sum() < n:
                            continue
                        gl, nl = residual[rows[left]].sum(), left.sum()
                        gain = (shrunk(gl) ** 2 / (nl + l2)
                                + shrunk(g - gl) ** 2 / (n - nl + l2) - shrunk(g) ** 2 / (n + l2))
                        if gain > best[0] + 1e-12:
                            best = (gain, rows[left], rows[~left])
                if best[1] is None:
                    step[rows] = rate * shrunk(g) / (n + l2)
                else:
                    after += best[1:]
            nodes = after
        for rows in nodes:
            step[rows] = rate * shrunk(residual[rows].sum()) / (len(rows) + l2)
        pred = pred + step
    return pred


def test_boosted_trees_equal_plain_loops(rows):
    x, y = ordered(rows)
    cuts = [np.quantile(x[:, k], np.arange(1, 12) / 12) for k in range(3)]
    model = boosting.fit_boosted(rows, NAMES, "y", "row_id", rounds=3, depth=3, rate=0.3, share=1.0,
                                 column_share=1.0, cuts=cuts)
    want = plain_boosting(x, y, cuts, 3, 3, 0.3, 0.1, 1.0)
    assert np.allclose(predicted(model, rows), want, atol=1e-6)


def test_trees_do_not_depend_on_the_partitions(rows):
    made = [rows.coalesce(1), rows.repartition(4), rows.repartition(7, "a")]
    boosted = [predicted(boosting.fit_boosted(r, NAMES, "y", "row_id", rounds=4, depth=3), rows)
               for r in made]
    forests = [predicted(reg.fit_forest(r, NAMES, "y", "row_id", trees=4, depth=3), rows)
               for r in made]
    for found in (boosted, forests):
        assert (found[0] == found[1]).all() and (found[0] == found[2]).all()


def test_boosting_goes_on_from_a_written_block(rows, tmp_path, monkeypatch):
    def fit(rounds, folder=None):
        return boosting.fit_boosted(rows, NAMES, "y", "row_id", rounds=rounds, depth=2, block=3,
                                    folder=folder)

    grown = []
    grow = boosting.grow
    monkeypatch.setattr(boosting, "grow", lambda *a: grown.append(a[2]) or grow(*a))
    whole = fit(8)
    fit(4, str(tmp_path))
    grown.clear()
    resumed = fit(8, str(tmp_path))
    assert grown == [4, 5, 6, 7]
    assert (predicted(whole, rows) == predicted(resumed, rows)).all()


def test_boosting_samples_rows_and_columns_by_tree(rows):
    seeds = np.arange(20_000, dtype=np.int64)
    kept = [boosting.in_sample(seeds, t, 0.8) for t in range(3)]
    assert all(k.mean() == pytest.approx(0.8, abs=0.02) for k in kept)
    assert (kept[0] != kept[1]).mean() == pytest.approx(0.32, abs=0.02)
    assert boosting.in_sample(seeds, 0, 1.0).all()
    model = boosting.fit_boosted(rows, NAMES, "y", "row_id", rounds=6, depth=1, column_share=0.34)
    assert sum(model.importances) == pytest.approx(1.0)


def test_boosting_on_a_constant_label(rows):
    flat = rows.withColumn("y", F.lit(2.0))
    model = boosting.fit_boosted(flat, NAMES, "y", "row_id", rounds=3)
    assert np.allclose(predicted(model, flat), 2.0) and sum(model.importances) == 0
    with pytest.raises(ValueError):
        boosting.fit_boosted(flat.limit(0), NAMES, "y", "row_id", rounds=1)


def test_forest_rows_are_bucketed_alike(rows):
    one, many = (reg.bucketed(r, "row_id", 5).withColumn("p", F.spark_partition_id())
                 for r in (rows.coalesce(1), rows.repartition(9)))
    places = [{r.row_id: r.p for r in t.collect()} for t in (one, many)]
    assert places[0] == places[1] and len(set(places[0].values())) == 5


def test_boosting_deals_its_rows_and_counts_one_of_two_siblings(spark, monkeypatch):
    lone = spark.range(40_000).coalesce(1).selectExpr(
        "cast(id % 97 as double) a", "cast(id % 89 as double) b", "cast(id % 97 + id % 7 as double) y",
        "cast(id as string) row_id")
    tasks, counted = [], []
    histograms = boosting.histograms

    def seen(blocks, tree, nodes, *rest):
        tasks.append(blocks.getNumPartitions())
        counted.append(len(nodes))
        return histograms(blocks, tree, nodes, *rest)

    monkeypatch.setattr(boosting, "histograms", seen)
    boosting.fit_boosted(lone, ["a", "b"], "y", "row_id", rounds=2, depth=4)
    assert min(tasks) == 3 and counted == [1, 1, 2, 4] * 2


def test_networks_deal_their_rows_and_read_them_once(spark, rows, monkeypatch):
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    table = rows.unionByName(rows.withColumn("row_id", F.concat("row_id", F.lit("x"))))
    lone = spark.createDataFrame(table.coalesce(1).rdd.map(seen), table.schema)
    tasks = []
    gradients = nets.gradients
    monkeypatch.setattr(nets, "TASK_ROWS", 100)
    monkeypatch.setattr(nets, "gradients", lambda blocks, *rest: tasks.append(
        blocks.getNumPartitions()) or gradients(blocks, *rest))
    nets.fit_nets(lone, rows, NAMES, "y", "row_id", ["dense", "gated"], epochs=4)
    assert tasks == [6] * 4 and read.value == table.count()
