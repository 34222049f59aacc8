"""Replace invalid numbers and clip outliers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from culturelens import fixed
from culturelens.functions.numeric import finite, zero_filled
from culturelens.operators.quantiles import exact_quantiles
from culturelens.roles import DEFAULT_ROLES, Roles, numeric_columns


def clean_invalid(
    df: DataFrame, roles: Roles = DEFAULT_ROLES, target_nulls: str = "zero"
) -> DataFrame:
    """Null, NaN and infinite numbers become 0; text keeps its nulls.

    ``target_nulls='drop'`` removes rows without a valid target instead.
    """
    if target_nulls not in ("zero", "drop"):
        raise ValueError("target_nulls must be 'zero' or 'drop'")
    if target_nulls == "drop":
        df = df.where(finite(f"`{roles.target}`").isNotNull())
    return df.select(*[x.alias(c) for c, x in valid_columns(df.schema, roles).items()])


def valid_columns(schema: T.StructType, roles: Roles = DEFAULT_ROLES) -> dict[str, Column]:
    """Every column with 0 for its invalid numbers; a whole-number group key keeps its type."""
    numbers = set(numeric_columns(schema))
    keys = {roles.group} & numbers
    return {
        f.name: F.coalesce(F.col(f"`{f.name}`"), F.lit(0).cast(f.dataType))
        if f.name in keys and f.dataType.typeName() not in ("double", "float")
        else zero_filled(f"`{f.name}`") if f.name in numbers
        else F.col(f"`{f.name}`")
        for f in schema.fields
    }


def clipped_columns(
    df: DataFrame, roles: Roles = DEFAULT_ROLES, indicators: Sequence[str] = ()
) -> list[str]:
    """Number columns to clip: not the target, the key or the 0/1 indicators."""
    skipped = {roles.target, roles.group, *indicators}
    return [c for c in numeric_columns(df.schema) if c not in skipped]


def fit_clip_bounds(
    df: DataFrame,
    columns: Sequence[str],
    low: float = fixed.CLIP_LOW,
    high: float = fixed.CLIP_HIGH,
    accuracy: int | None = None,
) -> dict[str, tuple[float, float]]:
    """Lower and upper quantile per column (two numbers per column reach the driver)."""
    found = exact_quantiles(df, columns, [low, high], accuracy)
    return {c: tuple(v) for c, v in found.items() if v[0] is not None}


def clip(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Clip to fitted bounds, missing values apart: a plain projection, so it also fits a stream."""
    out = {}
    for c, (lo, hi) in bounds.items():
        x = F.col(f"`{c}`")
        missing = x.isNull() | F.isnan(x.cast("double"))
        out[c] = F.when(missing, x).otherwise(F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))
    return df.withColumns(out)
