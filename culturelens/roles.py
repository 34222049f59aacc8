"""Which column plays which part in an observation table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Roles:
    target: str = "Biomass_g_L"
    group: str = "Scenario"
    time: str = "Time_h"
    light: str = "PAR_umol_m2_s"
    temperature: str = "Temperature_C"
    ph: str = "pH"
    nutrients: str = "Nutrients_g_L"
    phase: str = "Growth_Phase"
    timestamp: str = "DateTime"
    age: str = "Culture_Age_h"
    row_id: str = "row_id"

    @property
    def not_features(self) -> tuple[str, ...]:
        return (self.target, self.group, self.phase, self.timestamp, self.row_id)


DEFAULT_ROLES = Roles()


def numeric_columns(schema: T.StructType, double_only: bool = False) -> list[str]:
    """Names of the number columns; booleans, text and dates are not numbers."""
    wanted = T.DoubleType if double_only else T.NumericType
    return [f.name for f in schema.fields if isinstance(f.dataType, wanted)]


def candidate_columns(
    schema: T.StructType, roles: Roles = DEFAULT_ROLES, double_only: bool = False
) -> list[str]:
    """Number columns that may serve as model features."""
    return [c for c in numeric_columns(schema, double_only) if c not in roles.not_features]
