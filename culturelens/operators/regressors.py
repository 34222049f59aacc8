"""Linear and tree regressors on MLlib, fitted by distributed passes over the table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from culturelens import fixed
from culturelens.operators.longform import to_long

VECTOR = "_features"
FOREST_BUCKETS = 16
# Collinear features make the solver iterate on the (small) normal equations:
# let it run until it has settled.
SETTLED = {"tol": 1e-13, "maxIter": 1000}


@dataclass(frozen=True)
class Regressor:
    """A fitted model that adds its prediction as a column of the same rows."""

    name: str
    add: Callable[[DataFrame, str], DataFrame]
    importances: tuple[float, ...] | None = None
    features: tuple[str, ...] = field(default=())

    def predict(self, df: DataFrame, column: str) -> DataFrame:
        return self.add(df, column)


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=VECTOR).transform(df)


def linear_expression(features: Sequence[str], weights: Sequence[float], bias: float) -> Column:
    """The fitted line as a plain column expression."""
    total = F.lit(float(bias))
    for name, weight in zip(features, weights):
        total = total + F.col(f"`{name}`") * F.lit(float(weight))
    return total


def _line(name: str, features: Sequence[str], weights, bias) -> Regressor:
    line = linear_expression(features, weights, bias)
    return Regressor(name, lambda df, column: df.withColumn(column, line), None, tuple(features))


def fit_ols(train: DataFrame, features: Sequence[str], label: str) -> Regressor:
    """Least squares from one pass of normal equations."""
    model = LinearRegression(
        featuresCol=VECTOR, labelCol=label, solver="normal", regParam=0.0, **SETTLED
    ).fit(assemble(train, features).select(VECTOR, label))
    return _line("Linear", features, model.coefficients, model.intercept)


def fit_ridge(
    train: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0
) -> Regressor:
    """Ridge with an unpenalised intercept.

    MLlib divides the squared error by the row count and the label by its
    deviation, so the penalty is translated to keep ``alpha`` the plain weight
    of the squared coefficients next to the summed squared error.
    """
    seen = train.agg(F.count(label).alias("n"), F.stddev_pop(label).alias("deviation")).first()
    penalty = alpha * seen.deviation / seen.n
    if penalty == 0.0:
        # A constant label, fitted by its mean: every coefficient is zero.
        constant = train.agg(F.avg(label)).first()[0]
        return _line("Ridge", features, [0.0] * len(features), constant)
    model = LinearRegression(
        featuresCol=VECTOR, labelCol=label, solver="normal", regParam=penalty,
        elasticNetParam=0.0, standardization=False, **SETTLED
    ).fit(assemble(train, features).select(VECTOR, label))
    return _line("Ridge", features, model.coefficients, model.intercept)


def fit_lines(
    train: DataFrame, features: Sequence[str], label: str, alpha: float = 0.0
) -> dict[str, tuple[float, float]]:
    """Slope and intercept of each feature on its own, ridge-penalised by ``alpha``.

    One grouped aggregate for all features; a constant feature has slope 0.
    """
    rows = to_long(train, features, keep=[label]).groupBy("feature").agg(
        F.covar_pop("x", label).alias("cxy"),
        F.var_pop("x").alias("vx"),
        F.avg("x").alias("mx"),
        F.avg(label).alias("my"),
        F.count(label).alias("n"),
        (F.min("x") < F.max("x")).alias("varies"),
    )
    lines = {}
    for row in rows.collect():
        slope = row.n * row.cxy / (row.n * row.vx + alpha) if row.varies else 0.0
        lines[row.feature] = (slope, row.my - slope * row.mx)
    return lines


def _trees(name: str, model, features: Sequence[str]) -> Regressor:
    def add(df: DataFrame, column: str) -> DataFrame:
        scored = model.setPredictionCol(column).transform(assemble(df, features))
        return scored.drop(VECTOR)

    return Regressor(
        name, add, tuple(float(v) for v in model.featureImportances.toArray()), tuple(features)
    )


def bucketed(train: DataFrame, row_key: str, buckets: int) -> DataFrame:
    """The rows in a fixed number of partitions by the hash of their key, ordered inside.

    MLlib draws rows partition by partition: so the draw follows the rows alone, not the
    files, cores or partitions they come in.
    """
    key = F.col(f"`{row_key}`").cast("string")
    spread = train.withColumn("_key", F.xxhash64(key)).repartition(buckets, "_key")
    return spread.sortWithinPartitions("_key", key).drop("_key")


def storage_bytes(spark: SparkSession) -> int:
    """The memory that the session's executors have for cached rows."""
    found, total = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().valuesIterator(), 0
    while found.hasNext():
        total += found.next()._1()
    return total


def fit_forest(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    row_key: str,
    trees: int = 100,
    depth: int = 8,
    seed: int = fixed.ROW_SEED,
    bootstrap: bool = True,
    bins: int = 32,
    buckets: int = FOREST_BUCKETS,
    memory_mb: int = 512,
) -> Regressor:
    """Random forest that looks at every feature in every split.

    Without ``bootstrap`` and with one tree it is a regression tree, exact where no feature
    has more than ``bins`` distinct values. ``buckets`` must suit the table (a bucket is a
    task); another number draws other rows. ``memory_mb`` of statistics are gathered a pass.
    A pass reads the node of each row and tree where memory holds them, besides the new ones and
    the draws, of four bytes each too; else rows go down their trees again. Trees are the same.
    """
    rows = bucketed(train, row_key, buckets)
    held = 3 * (4 * trees + 16) * train.count() <= storage_bytes(train.sparkSession)
    model = RandomForestRegressor(
        featuresCol=VECTOR, labelCol=label, numTrees=trees, maxDepth=depth, maxBins=bins,
        featureSubsetStrategy="all", seed=seed, bootstrap=bootstrap, maxMemoryInMB=memory_mb,
        cacheNodeIds=held,
    ).fit(assemble(rows, features).select(VECTOR, label))
    return _trees("RandomForest", model, features)


def importance_table(
    spark: SparkSession, model: Regressor, top: int | None = None
) -> DataFrame | None:
    """``(feature, importance)`` sorted descending; None for models without any."""
    if model.importances is None:
        return None
    rows = list(zip(model.features, model.importances))
    table = spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )
    return table if top is None else table.limit(top)
