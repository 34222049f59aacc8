"""The numbers behind the diagnostic charts; drawing is left to the reader."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culturelens import fixed


def parity_pairs(df: DataFrame, label: str, pred: str, keep: Sequence[str] = ()) -> DataFrame:
    """Observed against predicted, all rows."""
    return df.select(*keep, F.col(label).alias("observed"), F.col(pred).alias("predicted"))


def parity_range(df: DataFrame, label: str, pred: str) -> DataFrame:
    """The common range of both axes."""
    return df.agg(
        F.least(F.min(label), F.min(pred)).alias("low"),
        F.greatest(F.max(label), F.max(pred)).alias("high"),
    )


def colour_class(r2: Column) -> Column:
    return (
        F.when(r2 > fixed.RISK_HIGH, "red").when(r2 > fixed.RISK_MEDIUM, "orange").otherwise("green")
    )


def model_comparison(metrics: DataFrame) -> DataFrame:
    return metrics.select("model", "r2", "rmse", colour_class(F.col("r2")).alias("colour"))


def multi_metric(metrics: DataFrame, first: int = fixed.CHART_MODELS) -> DataFrame:
    """r2 and nse of the first models in training order."""
    return metrics.where(F.col("position") < first).select("model", "r2", "nse")


def residuals(df: DataFrame, label: str, pred: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(
        *keep, F.col(pred).alias("predicted"), (F.col(label) - F.col(pred)).alias("residual")
    )


def histogram(df: DataFrame, column: str, bins: int = fixed.HISTOGRAM_BINS) -> DataFrame:
    """``(bin, lo, hi, n, density)``: equal bins, the last one closed, empty ones kept.

    Values that are all the same fall into a range of width one around them.
    """
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if ends.lo is None:
        raise ValueError(f"no values in {column}")
    low, high = ends.lo, ends.hi
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    place = F.floor((F.col(column) - F.lit(low)) * F.lit(bins) / F.lit(high - low)).cast("int")
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.least(place, F.lit(bins - 1)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # At most `bins` rows from here on.
    packed = counts.agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("found"),
        F.sum("n").alias("total"),
    )
    listed = packed.select(
        "found", "total", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    n = F.coalesce(F.try_element_at("found", F.col("bin")), F.lit(0).cast("bigint"))
    return listed.select(
        "bin",
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("lo"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
        n.alias("n"),
        (n / (F.col("total") * F.lit(width))).alias("density"),
    )


def normal_curve(df: DataFrame, column: str, points: int = fixed.CURVE_POINTS) -> DataFrame:
    """``(point, x, density, mean, deviation)``: the fitted normal over the value range."""
    fit = df.agg(
        F.avg(column).alias("mean"),
        F.stddev_pop(column).alias("deviation"),
        F.min(column).alias("lo"),
        F.max(column).alias("hi"),
    )
    steps = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / F.lit(float(points - 1))
    z = F.try_divide(F.col("x") - F.col("mean"), F.col("deviation"))
    peak = F.try_divide(F.lit(1.0 / math.sqrt(2.0 * math.pi)), F.col("deviation"))
    return fit.select("*", steps).withColumn("x", x).select(
        "point", "x", (peak * F.exp(-(z * z) / F.lit(2.0))).alias("density"), "mean", "deviation"
    )
