"""The registered queries: every operator over the whole culture view."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from culturelens import fixed
from culturelens.functions.numeric import rounded
from culturelens.operators import boosting, chart_data, cleaning, ensemble, evaluation, features
from culturelens.operators import holdout, leakage, networks, regressors, scaling, selection
from culturelens.plans.run import ENSEMBLE, SCALED_TARGET, FittedRun, RunConfig, run
from culturelens.roles import DEFAULT_ROLES as R
from culturelens.sources import store, tables
from culturelens.sources.culture import culture_rows, culture_view
from culturelens.streaming.scoring import score_available

Query = Callable[[SparkSession, str], DataFrame]

# The smooth features behind the light, heat and acidity responses.
RESPONSES = ["light_efficiency", "temperature_effect", "ph_effect"]
# One-feature models that both engines can fit in closed form.
LINES = {
    "Capacity": "photosynthetic_capacity",
    "Light": "light_efficiency",
    "Warmth": "temperature_effect",
    "Acidity": "ph_effect",
    "Quality": "environmental_quality",
}
BEST = "pred_Capacity"

# Queries of 300 boosting rounds, by far the longest: registered after all others.
LAST = ("boosted_predictions", "full_run_evaluation", "all_model_predictions",
        "boosted_top_features", "full_run_report", "full_run_scores")

# Given cuts of the responses, and sensors of few distinct values: trees that SQL can repeat.
STUMP_CUTS = [k / 16 for k in range(1, 16)]
TREE_FEATURES = ["Temperature_C", "pH", "PAR_umol_m2_s"]
TREE_BINS = 64

# Rows spoiled by their own values, to exercise the cleaning of invalid numbers.
SPOILED_SQL = """
select row_id, Scenario, Growth_Phase, Nutrients_g_L, Stirrer_Setpoint,
  case when Time_h < 0e0 then null else Time_h end as Time_h,
  case when Temperature_C > 3.5e1 then cast('Infinity' as double)
       else Temperature_C end as Temperature_C,
  case when pH < 6.7e0 then cast('-Infinity' as double) else pH end as pH,
  case when PAR_umol_m2_s > 4e2 then cast('NaN' as double)
       else PAR_umol_m2_s end as PAR_umol_m2_s,
  case when Biomass_g_L < 4e-1 then null else Biomass_g_L end as Biomass_g_L
from {rows}
"""


# Cell counts are around ten million: their sixth decimal is noise.
DIGITS = {"Cell_Concentration_cells_mL": 0}


def shown(df: DataFrame) -> DataFrame:
    """Round every double so that two engines can be compared."""
    return df.select(*[
        rounded(F.col(f"`{f.name}`"), DIGITS.get(f.name, 6)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


# Shared stages


def kept_observations(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.drop_leaks(culture_view(spark, sf))[0]


def featured(spark: SparkSession, sf: str) -> DataFrame:
    """Derived features without phase indicators, so no job runs ahead."""
    return features.add_features(culture_view(spark, sf), levels=[])


def prepared(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """Leak-free rows with all features and valid numbers, and the indicator names."""
    kept = kept_observations(spark, sf)
    levels = features.phase_levels(kept)
    table = cleaning.clean_invalid(features.add_features(kept, levels=levels))
    return table, list(features.phase_indicators(levels))


def clip_fit(spark: SparkSession, sf: str):
    table, indicators = prepared(spark, sf)
    bounds = cleaning.fit_clip_bounds(table, cleaning.clipped_columns(table, R, indicators))
    return table, bounds


def clipped(spark: SparkSession, sf: str) -> DataFrame:
    table, bounds = clip_fit(spark, sf)
    return cleaning.clip(table, bounds)


def scores(spark: SparkSession, sf: str) -> DataFrame:
    table = clipped(spark, sf)
    return selection.feature_scores(table, tables.candidate_columns(table.schema), R.target)


def splits(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Inner training rows, inner holdout rows, held-out groups."""
    outer = holdout.hold_out_groups(df, R.group)
    inner = holdout.hold_out_inner(R.row_id, fixed.ROW_SEED + 1)
    block = outer.train(df)
    return inner.train(block), inner.validation(block), outer.validation(df)


def line_models(train: DataFrame) -> list[regressors.Regressor]:
    fits = regressors.fit_lines(train, list(LINES.values()), R.target)
    models = []
    for name, feature in LINES.items():
        slope, bias = fits[feature]
        line = regressors.linear_expression([feature], [slope], bias)
        models.append(regressors.Regressor(
            name, lambda df, column, line=line: df.withColumn(column, line)
        ))
    return models


def scored_lines(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Line models fitted inside the training groups: holdout rows and validation rows."""
    train, inner, validation = splits(featured(spark, sf))
    models = line_models(train)
    return ensemble.predict_all(inner, models), ensemble.predict_all(validation, models)


def with_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    inner, validation = scored_lines(spark, sf)
    errors = ensemble.holdout_errors(inner, list(LINES), R.target)
    weights = ensemble.collect_weights(ensemble.model_weights(errors))
    return validation.withColumn(
        ensemble.prediction_column(ENSEMBLE), ensemble.ensemble_prediction(weights)
    )


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.evaluate(with_ensemble(spark, sf), [*LINES, ENSEMBLE], R.target)


def scaled_responses(spark: SparkSession, sf: str):
    """Response features and target scaled on the training groups, split three ways."""
    table = featured(spark, sf)
    outer = holdout.hold_out_groups(table, R.group)
    train = outer.train(table)
    scaler = scaling.fit_robust(train, RESPONSES)
    target = scaling.fit_standard(train, R.target)
    scaled = scaler.apply(table).withColumn(SCALED_TARGET, target.apply(R.target))
    inner = holdout.hold_out_inner(R.row_id, fixed.ROW_SEED + 1)
    block = outer.train(scaled)
    return inner.train(block), inner.validation(block), outer.validation(scaled), target


def fitted_predictions(fit) -> Query:
    """Predictions of one learner for the held-out groups, in target units."""

    def query(spark: SparkSession, sf: str) -> DataFrame:
        train, inner, validation, target = scaled_responses(spark, sf)
        # The fit passes over its rows several times: keep the few columns it reads.
        rows = train.select(R.row_id, *RESPONSES, SCALED_TARGET).persist()
        try:
            model = fit(rows, inner, target)
        finally:
            rows.unpersist()
        out = model.predict(validation, "_p")
        return shown(out.select("row_id", target.invert("_p").alias("predicted")))

    return query


FULL = RunConfig()
# The run with the parts that other engines can repeat exactly.
CLOSED_FORM = RunConfig(
    selectors=("correlation", "f_score"), max_features=3, models=("Linear", "Ridge"),
    ridge_alpha=100.0,
)
_runs: dict[RunConfig, tuple[tuple[str, str], FittedRun]] = {}


def shared_run(spark: SparkSession, sf: str, config: RunConfig) -> FittedRun:
    """One fit for all queries of a session over the same tables; others are released."""
    key = (spark.sparkContext.applicationId, sf)
    held = _runs.get(config)
    if held is None or held[0] != key:
        if held is not None and held[0][0] == key[0]:
            held[1].release()
        _runs[config] = (key, run(culture_view(spark, sf), config))
    return _runs[config][1]


def closed_form_fit(spark: SparkSession, sf: str) -> FittedRun:
    return shared_run(spark, sf, CLOSED_FORM)


def release_runs() -> None:
    """Drop the fits that this session shares, and what they keep cached."""
    for _, fitted in _runs.values():
        fitted.release()
    _runs.clear()


# Queries


def csv_copies(spark: SparkSession, sf: str, spoiled: bool = False) -> str:
    """A folder with the view as CSV files of two column orders, halved by row id.

    `spoiled` puts text for the acidity of the rows of the first light step.
    """
    view = culture_view(spark, sf)
    if spoiled:
        view = view.withColumn("pH", F.when(F.col(R.light) == 9.0, F.lit("n/a"))
                               .otherwise(F.col("pH").cast("string")))
    folder = store.fresh_folder(spark, "observations")
    half = F.pmod(F.xxhash64(R.row_id), F.lit(2))
    for part, names in enumerate((view.columns, view.columns[::-1])):
        (view.where(half == part).select(*names).write.mode("append")
         .option("header", True).csv(folder))
    return folder


def csv_observations(spark, sf):
    return shown(tables.read_observations(spark, csv_copies(spark, sf)))


def csv_rejects(spark, sf):
    """Every row by its id, whether its line parsed, and the acidity that was read."""
    rows = tables.read_observations(spark, csv_copies(spark, sf, spoiled=True), rejects="_line")
    return shown(rows.select("row_id", F.col("_line").isNotNull().alias("rejected"), "pH"))


def shape_report(spark, sf):
    return tables.shape_report(culture_view(spark, sf))


def candidate_features(spark, sf):
    return shown(tables.candidate_features(culture_view(spark, sf), keep=("row_id",)))


def known_leaks(spark, sf):
    report = leakage.leak_report(culture_view(spark, sf))
    return report.where("known").select("feature", "known")


def removed_leaks(spark, sf):
    report = leakage.leak_report(culture_view(spark, sf))
    return report.where("known or leak").select("feature")


def feature_query(name: str) -> Query:
    def query(spark, sf):
        return shown(featured(spark, sf).select("row_id", name))

    return query


def optional_query(name: str) -> Query:
    def query(spark, sf):
        view = features.add_features(
            culture_view(spark, sf), levels=[], optional=[name], age=R.time
        )
        return shown(view.select("row_id", name))

    return query


def physiology_features(spark, sf, names="english"):
    derived = features.base_feature_names()
    columns = [fixed.SPANISH_NAMES[c] for c in derived] if names == "spanish" else derived
    table = features.add_features(culture_view(spark, sf), levels=[], names=names)
    return shown(table.select("row_id", *columns))


def phase_indicators(spark, sf):
    view = culture_view(spark, sf)
    levels = features.phase_levels(view)
    return view.select(
        "row_id", *[c.alias(n) for n, c in features.phase_indicators(levels).items()]
    )


def clean_invalid(spark, sf):
    spoiled = spark.sql(SPOILED_SQL, rows=culture_view(spark, sf))
    return shown(cleaning.clean_invalid(features.add_features(spoiled, levels=[])))


def drop_invalid_targets(spark, sf):
    spoiled = spark.sql(SPOILED_SQL, rows=culture_view(spark, sf))
    cleaned = cleaning.clean_invalid(spoiled, target_nulls="drop")
    return shown(cleaned.select("row_id", R.target))


def clip_bounds(spark, sf):
    _, bounds = clip_fit(spark, sf)
    rows = [(c, lo, hi) for c, (lo, hi) in bounds.items()]
    return shown(spark.createDataFrame(rows, "feature string, lo double, hi double"))


def selected_features(spark, sf):
    ballot = selection.votes(scores(spark, sf))
    chosen = selection.select_features(ballot, max_features=8)
    return shown(chosen.select("feature", "abs_r", "f", "votes"))


def feature_votes(spark, sf):
    ballot = selection.votes(scores(spark, sf))
    return shown(ballot.select(
        "feature", "r", "f", "by_correlation", "by_f_score", "votes"
    ))


def forest_importance(spark, sf):
    fitted = run(culture_view(spark, sf), RunConfig(models=("Linear",)))
    fitted.release()
    return fitted.importances


def culture_groups(spark, sf):
    return holdout.sorted_groups(culture_view(spark, sf), R.group)


def group_holdout(method: str) -> Query:
    def query(spark, sf):
        view = culture_view(spark, sf)
        held = holdout.hold_out_groups(view, R.group, method=method)
        return held.flag(view).select("row_id", R.group, "split")

    return query


def group_split_join(spark, sf):
    view = culture_view(spark, sf).select("row_id", R.group, R.target)
    held = holdout.hold_out_groups(view, R.group).validation(view).select(R.group)
    train, validation = holdout.split_by_groups(view, held, R.group)
    return shown(
        train.withColumn("split", F.lit(holdout.TRAIN))
        .unionByName(validation.withColumn("split", F.lit(holdout.VALIDATION)))
        .groupBy("split").agg(
            F.count(F.lit(1)).alias("n_rows"), F.avg(R.target).alias("mean_target")
        )
    )


def row_holdout(spark, sf):
    view = culture_view(spark, sf)
    return holdout.hold_out_rows(R.row_id).flag(view).select("row_id", "split")


def inner_holdout(spark, sf):
    view = culture_view(spark, sf)
    block = holdout.hold_out_groups(view, R.group).train(view)
    return holdout.hold_out_inner(R.row_id).flag(block).select("row_id", "split")


def split_counts(spark, sf):
    view = culture_view(spark, sf)
    return holdout.split_counts(holdout.hold_out_groups(view, R.group).flag(view))


def robust_fit(spark, sf):
    table = cleaning.clean_invalid(featured(spark, sf))
    outer = holdout.hold_out_groups(table, R.group)
    names = ["Time_h", "Nutrients_g_L", "Stirrer_Setpoint", *features.base_feature_names()]
    return table, scaling.fit_robust(outer.train(table), names)


def robust_scale_stats(spark, sf):
    _, scaler = robust_fit(spark, sf)
    rows = [(c, *q, scaler.scale(c)) for c, q in scaler.quartiles.items()]
    return shown(spark.createDataFrame(
        rows, "feature string, q25 double, q50 double, q75 double, scale double"
    ))


def robust_scaled(spark, sf):
    table, scaler = robust_fit(spark, sf)
    return shown(scaler.apply(table).select("row_id", *scaler.quartiles))


def standard_scaled_target(spark, sf):
    view = culture_view(spark, sf)
    outer = holdout.hold_out_groups(view, R.group)
    target = scaling.fit_standard(outer.train(view), R.target)
    return shown(view.select("row_id", target.apply(R.target).alias("y_scaled")))


def unscaled_predictions(spark, sf):
    """Predictions in scaled units and back: the line on light, all rows."""
    table = featured(spark, sf)
    outer = holdout.hold_out_groups(table, R.group)
    train = outer.train(table)
    target = scaling.fit_standard(train, R.target)
    y_scaled = target.apply(R.target).alias(SCALED_TARGET)
    lines = regressors.fit_lines(
        train.select("light_efficiency", y_scaled), ["light_efficiency"], SCALED_TARGET
    )
    slope, bias = lines["light_efficiency"]
    scaled = regressors.linear_expression(["light_efficiency"], [slope], bias)
    return shown(table.select(
        "row_id", scaled.alias("pred_scaled"), target.invert(scaled).alias("predicted")
    ))


def single_feature_lines(spark, sf):
    """Slope and intercept per response, plain and ridge-penalised."""
    table = featured(spark, sf)
    train = holdout.hold_out_groups(table, R.group).train(table)
    rows = []
    for alpha in (0.0, 1000.0):
        lines = regressors.fit_lines(train, RESPONSES, R.target, alpha)
        rows += [(c, alpha, *line) for c, line in lines.items()]
    return shown(spark.createDataFrame(
        rows, "feature string, alpha double, slope double, intercept double"
    ))


def checkpoint_history(spark, sf):
    """Training loss and holdout error at each checkpoint of the penalised net."""
    train, inner, _, target = scaled_responses(spark, sf)
    seen: list[tuple] = []
    networks.fit_net(
        train, inner, RESPONSES, SCALED_TARGET, R.row_id, "dense",
        floor=-target.mean / target.std,
        history=lambda epoch, loss, held: seen.append((epoch, loss, held)),
    )
    return spark.createDataFrame(seen, "epoch int, loss double, holdout_mse double")


def holdout_errors(spark, sf):
    inner, _ = scored_lines(spark, sf)
    return shown(ensemble.holdout_errors(inner, list(LINES), R.target).select("model", "mse"))


def model_weights(spark, sf):
    inner, _ = scored_lines(spark, sf)
    errors = ensemble.holdout_errors(inner, list(LINES), R.target)
    return shown(ensemble.model_weights(errors).select("model", "weight"))


def all_model_predictions(spark, sf):
    fitted = shared_run(spark, sf, FULL)
    return fitted.validation.select(
        "row_id", *[ensemble.prediction_column(n) for n in fitted.names]
    )


def score_raw_rows(spark, sf):
    return shown(closed_form_fit(spark, sf).score(culture_view(spark, sf)))


def streamed_scores(spark, sf):
    """The rows of a file stream scored into a table, all that is available now."""
    fitted = closed_form_fit(spark, sf)
    path = f"{sf}/lineitem.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(
        path + "*")    # a pattern, since a stream reads no single file by its name
    scored = score_available(culture_rows(stream), fitted, store.fresh_folder(spark, "scores"))
    names = [ensemble.prediction_column(n) for n in fitted.names]
    return shown(scored.select("row_id", R.group, *names))


def boosted_stumps(spark, sf):
    """Two rounds of boosted trees of depth one at given cuts, without sampling."""
    train, _, validation = splits(featured(spark, sf))
    model = boosting.fit_boosted(
        train, RESPONSES, R.target, R.row_id, rounds=2, depth=1, rate=0.3, share=1.0,
        column_share=1.0, cuts=[STUMP_CUTS] * len(RESPONSES),
    )
    return shown(model.predict(validation, "predicted").select("row_id", "predicted"))


def regression_tree(spark, sf):
    """The forest learner as one tree of depth two without bootstrap."""
    train, _, validation = splits(culture_view(spark, sf))
    model = regressors.fit_forest(
        train.select(R.row_id, *TREE_FEATURES, R.target), TREE_FEATURES, R.target, R.row_id,
        trees=1, depth=2, bootstrap=False, bins=TREE_BINS,
    )
    return model, validation


def tree_predictions(spark, sf):
    model, validation = regression_tree(spark, sf)
    return shown(model.predict(validation, "predicted").select("row_id", "predicted"))


def tree_importances(spark, sf):
    model, _ = regression_tree(spark, sf)
    return shown(regressors.importance_table(spark, model))


def initial_nets(rows: DataFrame, target) -> dict[str, networks.Net]:
    return {kind: networks.untrained(rows, RESPONSES, kind, floor=_floor(target), dropout=False)
            for kind in networks.NAMES}


def initial_net_scores(spark, sf):
    """Both networks at their seeded initial weights, scored without Python."""
    train, _, validation, target = scaled_responses(spark, sf)
    for kind, net in initial_nets(train, target).items():
        scorer = networks.net_regressor(networks.NAMES[kind], *net, RESPONSES, native=True)
        validation = scorer.predict(validation, kind)
    return shown(validation.select("row_id", *[
        target.invert(kind).alias(name) for kind, name in networks.NAMES.items()]))


def initial_net_losses(spark, sf):
    """The loss of the first epoch of both networks, without dropout, from one gradient job."""
    train, _, _, target = scaled_responses(spark, sf)
    nets = initial_nets(train, target)
    rows = train.withColumn(networks.ROW_SEED, F.xxhash64(R.row_id))
    found = networks.gradient_job(rows, list(nets.values()), RESPONSES, SCALED_TARGET, 0)
    return shown(spark.createDataFrame(
        [(networks.NAMES[kind], loss) for kind, (loss, _) in zip(nets, found)],
        "model string, loss double"))


def closed_form_run(spark, sf):
    return shown(closed_form_fit(spark, sf).metrics.drop("position"))


def ensemble_prediction(spark, sf):
    return shown(with_ensemble(spark, sf).select(
        "row_id", F.col(ensemble.prediction_column(ENSEMBLE)).alias("predicted")
    ))


def model_metrics(spark, sf):
    return shown(metrics(spark, sf).drop("position"))


def best_model(spark, sf):
    return shown(evaluation.best_model(metrics(spark, sf)).select("model", "r2", "rmse", "risk"))


def boosted_top_features(spark, sf):
    return shared_run(spark, sf, FULL).top_features(spark)


def run_report(spark, sf):
    return shown(closed_form_fit(spark, sf).report(spark))


def parity_pairs(spark, sf):
    _, validation = scored_lines(spark, sf)
    return shown(chart_data.parity_pairs(validation, R.target, BEST, keep=["row_id"]))


def parity_range(spark, sf):
    _, validation = scored_lines(spark, sf)
    return shown(chart_data.parity_range(validation, R.target, BEST))


def model_comparison(spark, sf):
    return shown(chart_data.model_comparison(metrics(spark, sf)))


def residuals(spark, sf):
    _, validation = scored_lines(spark, sf)
    return shown(chart_data.residuals(validation, R.target, BEST, keep=["row_id"]))


def residual_frame(spark, sf):
    _, validation = scored_lines(spark, sf)
    return chart_data.residuals(validation, R.target, BEST)


def residual_histogram(spark, sf):
    return shown(chart_data.histogram(residual_frame(spark, sf), "residual"))


def residual_normal_curve(spark, sf):
    return shown(chart_data.normal_curve(residual_frame(spark, sf), "residual"))


def multi_metric(spark, sf):
    return shown(chart_data.multi_metric(metrics(spark, sf)))


def full_run_evaluation(spark, sf):
    return shared_run(spark, sf, FULL).metrics


def full_run_report(spark, sf):
    return shared_run(spark, sf, FULL).report(spark)


def full_run_scores(spark, sf):
    """Raw rows scored by all six models and the ensemble."""
    return shared_run(spark, sf, FULL).score(culture_view(spark, sf))


def _floor(target: scaling.StandardScaler) -> float:
    return -target.mean / target.std


def net_fit(kind: str):
    return lambda train, inner, target: networks.fit_net(
        train, inner, RESPONSES, SCALED_TARGET, R.row_id, kind, floor=_floor(target),
    )


def all_queries() -> dict[str, Query]:
    y = SCALED_TARGET
    found: dict[str, Query] = {
        # sources
        "observations": lambda s, d: shown(culture_view(s, d)),
        "csv_observations": csv_observations,
        "csv_rejects": csv_rejects,
        "shape_report": shape_report,
        "candidate_features": candidate_features,
        "drop_columns": lambda s, d: shown(
            tables.drop_columns(culture_view(s, d), list(fixed.KNOWN_LEAKS))
        ),
        # leakage
        "known_leaks": known_leaks,
        "leak_report": lambda s, d: shown(leakage.leak_report(culture_view(s, d))),
        "removed_leaks": removed_leaks,
        "leak_free_observations": lambda s, d: shown(kept_observations(s, d)),
    }
    # features
    found.update({name: feature_query(name) for name in features.base_feature_names()})
    found["phase_indicators"] = phase_indicators
    found.update({name: optional_query(name) for name in features.OPTIONAL})
    found["physiology_features"] = physiology_features
    found["physiology_features_spanish"] = lambda s, d: physiology_features(s, d, "spanish")
    found.update({
        # cleaning
        "clean_invalid": clean_invalid,
        "drop_invalid_targets": drop_invalid_targets,
        "clip_bounds": clip_bounds,
        "clipped_observations": lambda s, d: shown(clipped(s, d)),
        # selection
        "correlation_ranking": lambda s, d: shown(selection.correlation_ranking(scores(s, d))),
        "f_score_ranking": lambda s, d: shown(selection.f_score_ranking(scores(s, d))),
        "feature_votes": feature_votes,
        "selected_features": selected_features,
        "selection_report": lambda s, d: selection.selection_report(
            selection.votes(scores(s, d))
        ),
        "forest_importance": forest_importance,
        # splits
        "culture_groups": culture_groups,
        "group_holdout": group_holdout("hash"),
        "group_holdout_draw": group_holdout("draw"),
        "group_split_join": group_split_join,
        "row_holdout": row_holdout,
        "inner_holdout": inner_holdout,
        "split_counts": split_counts,
        # scaling
        "robust_scale_stats": robust_scale_stats,
        "robust_scaled": robust_scaled,
        "standard_scaled_target": standard_scaled_target,
        "unscaled_predictions": unscaled_predictions,
        # regressors
        "single_feature_lines": single_feature_lines,
        "linear_predictions": fitted_predictions(
            lambda train, inner, target: regressors.fit_ols(train, RESPONSES, y)
        ),
        "ridge_predictions": fitted_predictions(
            lambda train, inner, target: regressors.fit_ridge(train, RESPONSES, y, alpha=100.0)
        ),
        "forest_predictions": fitted_predictions(
            lambda train, inner, target: regressors.fit_forest(train, RESPONSES, y, R.row_id)
        ),
        "boosted_predictions": fitted_predictions(
            lambda train, inner, target: boosting.fit_boosted(train, RESPONSES, y, R.row_id)
        ),
        "penalty_net_predictions": fitted_predictions(net_fit("dense")),
        "gated_net_predictions": fitted_predictions(net_fit("gated")),
        "checkpoint_history": checkpoint_history,
        "tree_predictions": tree_predictions,
        "tree_importances": tree_importances,
        "boosted_stumps": boosted_stumps,
        "initial_net_scores": initial_net_scores,
        "initial_net_losses": initial_net_losses,
        # ensemble
        "holdout_errors": holdout_errors,
        "model_weights": model_weights,
        "all_model_predictions": all_model_predictions,
        "score_raw_rows": score_raw_rows,
        "streamed_scores": streamed_scores,
        "ensemble_prediction": ensemble_prediction,
        # evaluation
        "model_metrics": model_metrics,
        "best_model": best_model,
        "boosted_top_features": boosted_top_features,
        "run_report": run_report,
        # chart data
        "parity_pairs": parity_pairs,
        "parity_range": parity_range,
        "model_comparison": model_comparison,
        "residuals": residuals,
        "residual_histogram": residual_histogram,
        "residual_normal_curve": residual_normal_curve,
        "multi_metric": multi_metric,
        # end to end
        "closed_form_run": closed_form_run,
        "full_run_evaluation": full_run_evaluation,
        "full_run_report": full_run_report,
        "full_run_scores": full_run_scores,
    })
    return found
