"""Columns that give the target away: by name, or by correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from culturelens import fixed
from culturelens.functions.numeric import finite, guarded_corr
from culturelens.operators.longform import to_long
from culturelens.roles import DEFAULT_ROLES, Roles, numeric_columns


def correlations(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """``(feature, n, r)``: one grouped aggregate over all columns at once."""
    pairs = to_long(df.withColumn("_y", finite(f"`{target}`")), features, keep=["_y"])
    pairs = pairs.withColumn("x", finite("x"))
    return pairs.groupBy("feature").agg(
        F.count_if(F.col("x").isNotNull() & F.col("_y").isNotNull()).alias("n"),
        guarded_corr("x", "_y").alias("r"),
    )


def leak_report(
    df: DataFrame,
    roles: Roles = DEFAULT_ROLES,
    threshold: float = fixed.LEAK_THRESHOLD,
    known: Sequence[str] = fixed.KNOWN_LEAKS,
) -> DataFrame:
    """``(feature, r, known, leak)`` for every number column but the target."""
    features = [c for c in numeric_columns(df.schema) if c != roles.target]
    return correlations(df, features, roles.target).select(
        "feature",
        "r",
        F.col("feature").isin(*known).alias("known"),
        F.coalesce(F.abs("r") > F.lit(threshold), F.lit(False)).alias("leak"),
    )


def find_leaks(
    df: DataFrame,
    roles: Roles = DEFAULT_ROLES,
    threshold: float = fixed.LEAK_THRESHOLD,
    known: Sequence[str] = fixed.KNOWN_LEAKS,
) -> list[str]:
    """Names to drop, sorted; empty when the table has no target column."""
    if roles.target not in df.columns:
        return []
    named = {c for c in known if c in df.columns}
    # Columns dropped by name need no statistics.
    rest = df.drop(*named)
    if len(numeric_columns(rest.schema)) > 1:
        report = leak_report(rest, roles, threshold, known)
        named.update(r.feature for r in report.filter("leak").select("feature").collect())
    return sorted(named)


def drop_leaks(
    df: DataFrame,
    roles: Roles = DEFAULT_ROLES,
    threshold: float = fixed.LEAK_THRESHOLD,
    known: Sequence[str] = fixed.KNOWN_LEAKS,
) -> tuple[DataFrame, list[str]]:
    """The table without its leaks, and the names removed."""
    leaks = find_leaks(df, roles, threshold, known)
    return df.drop(*leaks), leaks
