"""The end-to-end run: from an observation table to evaluated models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from culturelens import fixed
from culturelens.operators import boosting, cleaning, ensemble, evaluation, features, holdout
from culturelens.operators import networks, regressors, scaling, selection
from culturelens.operators.profile import profile
from culturelens.roles import DEFAULT_ROLES, Roles, candidate_columns
from culturelens.sources.session import keep_compiled

SCALED_TARGET = "_y"
ENSEMBLE = "Ensemble"
TASK_ROWS = 500_000    # most cached rows of a task, about 0.2 kB each
ALL_MODELS = ("Linear", "Ridge", "RandomForest", "Boosted", "PenaltyNet", "GatedNet")


@dataclass(frozen=True)
class RunConfig:
    """Settings of a run; the defaults are the full-size ones."""

    roles: Roles = DEFAULT_ROLES
    leak_threshold: float = fixed.LEAK_THRESHOLD
    known_leaks: tuple[str, ...] = fixed.KNOWN_LEAKS
    include_phase: bool = True
    double_only: bool = False
    optional: tuple[str, ...] = ()
    target_nulls: str = "zero"
    fit_on: str = "all"                # or 'train': clip and select on training groups only
    accuracy: int | None = None        # None: exact quantiles
    max_features: int | None = None
    selectors: tuple[str, ...] = selection.METHODS
    selector_trees: int = 50
    selector_depth: int = 12
    group_method: str = "hash"
    group_seed: int = fixed.GROUP_SEED
    row_seed: int = fixed.ROW_SEED
    inner_split: str = "row"           # or 'group'
    models: tuple[str, ...] = ALL_MODELS
    ridge_alpha: float = 1.0
    forest_trees: int = 100
    forest_depth: int = 8
    boosted_rounds: int = 300
    boosted_depth: int = 6
    epochs: int = networks.EPOCHS
    penalty_floor: str = "zero"        # or 'scaled_zero'
    native_scoring: bool = False       # networks score without Python
    state_folder: str | None = None    # boosting and networks go on from their states there


@dataclass
class FittedRun:
    """Everything needed to score raw rows: names, bounds, scalers, models, weights."""

    config: RunConfig
    leaks: list[str]
    levels: list[str]
    bounds: dict[str, tuple[float, float]]
    selected: list[str]
    features: scaling.RobustScaler
    target: scaling.StandardScaler
    models: list[regressors.Regressor]
    weights: dict[str, float]
    ballot: DataFrame
    metrics: DataFrame | None = None
    validation: DataFrame | None = None
    importances: DataFrame | None = None
    cached: list[DataFrame] = field(default_factory=list)

    @property
    def names(self) -> list[str]:
        return [m.name for m in self.models] + [ENSEMBLE]

    def score(self, df: DataFrame) -> DataFrame:
        """Raw observation rows in, predictions in target units out (``pred_*``)."""
        return score(df, self)

    def report(self, spark: SparkSession) -> DataFrame:
        """One row: best model with its metrics, leaks removed, features used."""
        best = evaluation.best_model(self.metrics)
        return best.select(
            F.col("model").alias("best_model"), "r2", "rmse", "risk",
            F.lit(len(self.leaks)).alias("n_leaks_removed"),
            F.lit(len(self.selected)).alias("n_features"),
        )

    def top_features(self, spark: SparkSession, top: int = fixed.TOP_FEATURES) -> DataFrame | None:
        """Leading features of the boosted model."""
        for model in self.models:
            if model.name == "Boosted":
                return regressors.importance_table(spark, model, top)
        return None

    def release(self) -> None:
        for df in self.cached:
            df.unpersist()


def dealt(df: DataFrame, n: int) -> DataFrame:
    """The `n` rows of a table, in parts of about TASK_ROWS where the cores would hold more each.

    A scan gives a task up to a file split of compressed rows, many times as much in the cache.
    """
    if n <= TASK_ROWS * df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(-(-n // TASK_ROWS), *[F.col(f"`{c}`") for c in df.columns])


def prepare(df: DataFrame, config: RunConfig, levels: Sequence[str]) -> DataFrame:
    """Derived features and valid numbers: one projection over the scan."""
    roles = config.roles
    derived = features.add_features(df, roles, levels, config.optional)
    return cleaning.clean_invalid(derived, roles, config.target_nulls)


def _candidates(df: DataFrame, kept: DataFrame, config: RunConfig, levels) -> list[str]:
    roles = config.roles
    indicators = list(features.phase_indicators(levels, roles))
    source = candidate_columns(kept.schema, roles, config.double_only)
    derived = [
        c for c in candidate_columns(df.schema, roles)
        if c not in kept.columns and c not in indicators
    ]
    return source + derived + (indicators if config.include_phase else [])


def choose_features(
    fit_rows: DataFrame, candidates: Sequence[str], config: RunConfig
) -> tuple[list[str], DataFrame, DataFrame | None]:
    """Selected names, the ballot they come from, and the importance table."""
    roles = config.roles
    spark = fit_rows.sparkSession
    scores = selection.feature_scores(fit_rows, candidates, roles.target)
    importances = None
    if "forest" in config.selectors:
        forest = regressors.fit_forest(
            fit_rows, candidates, roles.target, roles.row_id, config.selector_trees,
            config.selector_depth, config.row_seed,
        )
        importances = regressors.importance_table(spark, forest)
    ballot = selection.votes(scores, importances)
    names = selection.selected_names(ballot, config.max_features)
    if not names:
        raise ValueError("no feature passed the selection")
    table = None
    if importances is not None:
        table = importances.where(F.col("feature").isin(names)).orderBy(
            F.desc("importance"), "feature"
        )
    return names, ballot, table


def split(
    df: DataFrame, config: RunConfig, groups: DataFrame | None = None
) -> tuple[holdout.Holdout, holdout.Holdout]:
    """Outer holdout (groups, or rows without a group key) and inner holdout."""
    roles = config.roles
    row_key = roles.row_id if roles.row_id in df.columns else holdout.row_identity(df)
    if roles.group in df.columns:
        outer = holdout.hold_out_groups(
            df, roles.group, config.group_seed, config.group_method, groups=groups)
    else:
        outer = holdout.hold_out_rows(row_key, seed=config.row_seed)
    by_group = config.inner_split == "group" and roles.group in df.columns
    # Another seed than the outer split, so that both are independent.
    inner = holdout.hold_out_inner(roles.group if by_group else row_key, config.row_seed + 1)
    return outer, inner


def run(df: DataFrame, config: RunConfig = RunConfig()) -> FittedRun:
    """Fit everything on ``df`` and evaluate on the held-out groups.

    Only names, two or three quantiles per column, group counts, model weights
    and metrics reach the driver. The source is scanned twice: once for its profile, and once
    for the prepared rows, which stay cached for the fits. The scaled rows stay cached for the
    lazy evaluation tables; call ``release`` on the result to free them.
    """
    keep_compiled(df.sparkSession)
    roles = config.roles
    seen = profile(df, roles, config.known_leaks, config.target_nulls)
    leaks = seen.leaks(df.columns, config.leak_threshold, config.known_leaks)
    kept = df.drop(*leaks)
    if roles.row_id not in kept.columns:
        # Without a row id the content identifies a row, before it is changed.
        kept = kept.withColumn(roles.row_id, F.md5(holdout.row_identity(kept)))
    levels = seen.levels if roles.phase in kept.columns else []
    prepared = prepare(dealt(kept, seen.n_rows), config, levels)
    outer, inner = split(prepared, config, seen.groups)
    seen.release()
    indicators = list(features.phase_indicators(levels, roles))

    def fit_rows(frame: DataFrame) -> DataFrame:
        return outer.train(frame) if config.fit_on == "train" else frame

    limited = cleaning.clipped_columns(prepared, roles, indicators)
    candidates = _candidates(prepared, kept, config, levels)
    keys = [c for c in (roles.row_id, roles.group) if c in prepared.columns]
    # Keep only what the following steps read.
    numbers = list(dict.fromkeys([*candidates, *limited]))
    held = prepared.select(
        *keys, roles.target, *[F.col(f"`{c}`") for c in numbers if c not in keys]).persist()
    bounds = cleaning.fit_clip_bounds(fit_rows(held), limited, accuracy=config.accuracy)
    clipped = cleaning.clip(held, bounds).select(
        *keys, roles.target, *[F.col(f"`{c}`") for c in candidates])
    chosen, ballot, importances = choose_features(fit_rows(clipped), candidates, config)

    training = outer.train(clipped)
    scaler = scaling.fit_robust(training, chosen, config.accuracy)
    target = scaling.fit_standard(training, roles.target)
    scaled = clipped.select(
        *keys, roles.target, *[scaler.column(c).alias(c) for c in chosen],
        target.apply(roles.target).alias(SCALED_TARGET),
    ).persist()
    block = outer.train(scaled)
    models = fit_models(inner.train(block), inner.validation(block), chosen, target, config)
    # The fits have filled the cache of the scaled rows.
    held.unpersist()

    scored = ensemble.predict_all(inner.validation(block), models)
    errors = ensemble.holdout_errors(scored, [m.name for m in models], SCALED_TARGET)
    weights = ensemble.collect_weights(ensemble.model_weights(errors))
    fitted = FittedRun(config, leaks, levels, bounds, chosen, scaler, target, models, weights,
                       ballot, importances=importances, cached=[scaled])
    fitted.validation = predictions(outer.validation(scaled), fitted)
    fitted.metrics = evaluation.evaluate(fitted.validation, fitted.names, roles.target)
    return fitted


def fit_models(
    train: DataFrame, held: DataFrame, names: Sequence[str],
    target: scaling.StandardScaler, config: RunConfig,
) -> list[regressors.Regressor]:
    """Fit the configured models on scaled rows, in training order."""
    y, row_id = SCALED_TARGET, config.roles.row_id
    floor = 0.0 if config.penalty_floor == "scaled_zero" else -target.mean / target.std

    def state(name: str) -> str | None:
        return config.state_folder and f"{config.state_folder}/{name}"

    fits = {
        "Linear": lambda: regressors.fit_ols(train, names, y),
        "Ridge": lambda: regressors.fit_ridge(train, names, y, config.ridge_alpha),
        "RandomForest": lambda: regressors.fit_forest(
            train, names, y, row_id, config.forest_trees, config.forest_depth, config.row_seed),
        "Boosted": lambda: boosting.fit_boosted(
            train, names, y, row_id, config.boosted_rounds, config.boosted_depth,
            seed=config.row_seed, folder=state("boosted")),
    }
    models = [fit() for name, fit in fits.items() if name in config.models]
    kinds = [kind for kind, name in networks.NAMES.items() if name in config.models]
    if kinds:
        models += networks.fit_nets(
            train, held, names, y, row_id, kinds, config.epochs, config.row_seed, floor,
            folder=state("networks"), native=config.native_scoring)
    return models


def predictions(scaled: DataFrame, fitted: FittedRun) -> DataFrame:
    """Predictions of all models and the ensemble, back in target units."""
    out = ensemble.predict_all(scaled, fitted.models)
    out = out.withColumn(
        ensemble.prediction_column(ENSEMBLE), ensemble.ensemble_prediction(fitted.weights)
    )
    return out.withColumns({
        ensemble.prediction_column(n): fitted.target.invert(
            F.col(f"`{ensemble.prediction_column(n)}`")
        )
        for n in fitted.names
    })


ROW = "_scored_row"    # the raw row, carried under one private name


def score(df: DataFrame, fitted: FittedRun) -> DataFrame:
    """All columns of raw rows and their predictions, in target units; fits streams too."""
    keep_compiled(df.sparkSession)
    roles = fitted.config.roles
    raw = df.withColumn(ROW, F.struct(*[F.col(f"`{c}`") for c in df.columns])).drop(*fitted.leaks)
    prepared = features.add_features(raw, roles, fitted.levels, fitted.config.optional)
    inputs = fitted.selected
    valid = cleaning.clean_invalid(prepared.select(ROW, *[F.col(f"`{c}`") for c in inputs]), roles)
    clipped = cleaning.clip(valid, {c: b for c, b in fitted.bounds.items() if c in inputs})
    scaled = clipped.select(ROW, *[fitted.features.column(c).alias(c) for c in inputs])
    names = [ensemble.prediction_column(n) for n in fitted.names]
    return predictions(scaled, fitted).select(f"{ROW}.*", *[F.col(f"`{n}`") for n in names])
