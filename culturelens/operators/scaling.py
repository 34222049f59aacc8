"""Robust scaling of features and standard scaling of the target."""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culturelens.functions.numeric import as_column
from culturelens.operators.quantiles import exact_quantiles

TINY_RANGE = 10 * sys.float_info.epsilon


@dataclass(frozen=True)
class RobustScaler:
    """Median and interquartile range per column; a range of zero counts as one."""

    quartiles: Mapping[str, tuple[float, float, float]]

    def scale(self, name: str) -> float:
        q25, _, q75 = self.quartiles[name]
        return q75 - q25 if q75 - q25 > TINY_RANGE else 1.0

    def column(self, name: str) -> Column:
        centre = self.quartiles[name][1]
        return (F.col(f"`{name}`") - F.lit(centre)) / F.lit(self.scale(name))

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns({name: self.column(name) for name in self.quartiles})


def fit_robust(
    train: DataFrame, columns: Sequence[str], accuracy: int | None = None
) -> RobustScaler:
    found = exact_quantiles(train, columns, [0.25, 0.5, 0.75], accuracy)
    return RobustScaler({c: tuple(v) for c, v in found.items() if v[0] is not None})


@dataclass(frozen=True)
class StandardScaler:
    """Mean and population deviation of the target; a deviation of zero counts as one."""

    mean: float
    std: float

    def apply(self, value: Column | str) -> Column:
        return (as_column(value) - F.lit(self.mean)) / F.lit(self.std)

    def invert(self, value: Column | str) -> Column:
        return as_column(value) * F.lit(self.std) + F.lit(self.mean)


def fit_standard(train: DataFrame, target: str) -> StandardScaler:
    row = train.agg(
        F.avg(target).alias("mean"),
        F.stddev_pop(target).alias("std"),
        (F.min(target) < F.max(target)).alias("varies"),
    ).first()
    if row.mean is None:
        raise ValueError(f"no values of {target} to fit on")
    return StandardScaler(row.mean, row.std if row.varies and row.std > 0 else 1.0)
