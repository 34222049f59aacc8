"""Row-local features: one projection, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culturelens import fixed
from culturelens.functions import physiology as bio
from culturelens.roles import DEFAULT_ROLES, Roles


OPTIONAL = (
    "michaelis_menten_light",
    "nutrient_limitation",
    "monod_nutrient",
    "density_attenuation",
    "light_penetration",
)


def feature_steps(
    roles: Roles = DEFAULT_ROLES, nutrients: bool = True
) -> list[dict[str, Column]]:
    """Always-on features in steps: a step may use the columns of earlier ones."""
    responses = {
        "light_efficiency": bio.light_efficiency(roles.light),
        "photoinhibition": bio.photoinhibition(roles.light),
        "temperature_effect": bio.temperature_effect(roles.temperature),
        "ph_effect": bio.ph_effect(roles.ph),
        "temperature_stress": bio.temperature_stress(roles.temperature),
        "ph_stress": bio.ph_stress(roles.ph),
    }
    if nutrients:
        responses["nutrient_effect"] = bio.nutrient_effect(roles.nutrients)
    responses.update({
        "sin_24h": bio.sin_24h(roles.time),
        "cos_24h": bio.cos_24h(roles.time),
        "culture_day": bio.culture_day(roles.time),
    })
    combined = {
        "environmental_stress": bio.environmental_stress("temperature_stress", "ph_stress"),
        "photosynthetic_capacity": bio.photosynthetic_capacity(
            "temperature_effect", "ph_effect", "light_efficiency"
        ),
    }
    quality = {
        "environmental_quality": bio.environmental_quality(
            "photosynthetic_capacity", "photoinhibition"
        ),
    }
    return [responses, combined, quality]


def base_feature_names(nutrients: bool = True) -> list[str]:
    return [n for n in fixed.SPANISH_NAMES if nutrients or n != "nutrient_effect"]


def optional_features(roles: Roles = DEFAULT_ROLES, age: str | None = None) -> dict[str, Column]:
    return {
        "michaelis_menten_light": bio.michaelis_menten_light(roles.light),
        "nutrient_limitation": bio.nutrient_limitation(roles.nutrients),
        "monod_nutrient": bio.monod_nutrient(roles.nutrients),
        "density_attenuation": bio.density_attenuation(age or roles.age),
        "light_penetration": bio.light_penetration(
            bio.michaelis_menten_light(roles.light), bio.density_attenuation(age or roles.age)
        ),
    }


def phase_levels(df: DataFrame, roles: Roles = DEFAULT_ROLES) -> list[str]:
    """Sorted growth phases in the data; each becomes a column."""
    if roles.phase not in df.columns:
        return []
    levels = df.select(F.col(roles.phase).cast("string").alias("v")).where("v is not null")
    return sorted(r.v for r in levels.distinct().collect())


def phase_indicators(levels: Sequence[str], roles: Roles = DEFAULT_ROLES) -> dict[str, Column]:
    """One 0/1 column per phase; a missing phase is 0 everywhere."""
    return {
        f"phase_{v}": F.when(F.col(roles.phase).cast("string") == F.lit(v), 1.0).otherwise(0.0)
        for v in levels
    }


def add_features(
    df: DataFrame,
    roles: Roles = DEFAULT_ROLES,
    levels: Sequence[str] | None = None,
    optional: Sequence[str] = (),
    age: str | None = None,
    names: str = "english",
) -> DataFrame:
    """Append the features; ``levels`` None looks the growth phases up in the data.

    ``names='spanish'`` gives the derived columns their Spanish names.
    """
    levels = phase_levels(df, roles) if levels is None else levels
    extra = optional_features(roles, age) if optional else {}
    independent = {name: extra[name] for name in optional} | phase_indicators(levels, roles)
    out = df
    # One projection per step: the optimizer merges them, and a later feature
    # can use an earlier one without repeating its formula.
    for step in feature_steps(roles, roles.nutrients in df.columns):
        out = out.withColumns(independent | step)
        independent = {}
    if names == "spanish":
        out = out.withColumnsRenamed(fixed.SPANISH_NAMES)
    return out
