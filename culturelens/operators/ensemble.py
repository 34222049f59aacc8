"""Weighting models by their inverse holdout error."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culturelens.operators.longform import with_totals
from culturelens.operators.regressors import Regressor


def prediction_column(model: str) -> str:
    return f"pred_{model}"


def predict_all(df: DataFrame, models: Sequence[Regressor]) -> DataFrame:
    """Add one prediction column per model; the rows stay where they are."""
    for model in models:
        df = model.predict(df, prediction_column(model.name))
    return df


def to_model_rows(
    df: DataFrame, models: Sequence[str], label: str, keep: Sequence[str] = ()
) -> DataFrame:
    """``(keep..., y, position, model, pred)``, one row per row and model."""
    entries = F.array(*[
        F.struct(
            F.lit(i).alias("position"),
            F.lit(m).alias("model"),
            F.col(f"`{prediction_column(m)}`").cast("double").alias("pred"),
        )
        for i, m in enumerate(models)
    ])
    return df.select(*keep, F.col(label).cast("double").alias("y"), F.inline(entries))


def holdout_errors(df: DataFrame, models: Sequence[str], label: str) -> DataFrame:
    """``(position, model, mse)``; map-side sums, a handful of rows shuffled."""
    miss = F.col("y") - F.col("pred")
    return (
        to_model_rows(df, models, label)
        .groupBy("position", "model")
        .agg(F.avg(miss * miss).alias("mse"))
    )


def model_weights(errors: DataFrame) -> DataFrame:
    """``(model, mse, weight)`` with weights that sum to one.

    A model without error gets no weight, unless none has any: then all get
    the same.
    """
    inverse = F.when(F.col("mse") > 0, F.lit(1.0) / F.col("mse"))
    shared = with_totals(errors, total=F.sum(inverse), n_models=F.count(F.lit(1)))
    weight = (
        F.when(F.col("total").isNull(), F.lit(1.0) / F.col("n_models"))
        .when(F.col("mse") > 0, F.try_divide(F.lit(1.0) / F.col("mse"), F.col("total")))
        .otherwise(0.0)
    )
    return shared.select("position", "model", "mse", weight.alias("weight"))


def collect_weights(weights: DataFrame) -> dict[str, float]:
    return {r.model: r.weight for r in weights.orderBy("position").collect()}


def ensemble_prediction(weights: Mapping[str, float]) -> Column:
    total = F.lit(0.0)
    for model, weight in weights.items():
        total = total + F.lit(weight) * F.col(f"`{prediction_column(model)}`")
    return total
