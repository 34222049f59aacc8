"""Growth-physiology features as column expressions (no shuffle, no Python rows)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from culturelens import fixed
from culturelens.functions.numeric import as_column, finite


def _number(value: Column | str) -> Column:
    return as_column(value).cast("double")


def _bell(value: Column | str, optimum: float, width: float) -> Column:
    distance = _number(value) - F.lit(optimum)
    return F.exp(-(distance * distance) / F.lit(width))


def light_efficiency(light, alpha=fixed.ALPHA_LIGHT, pmax=fixed.PMAX_LIGHT) -> Column:
    """Jassby-Platt saturation curve."""
    return F.lit(pmax) * F.tanh(F.lit(alpha) * _number(light) / F.lit(pmax))


def photoinhibition(light) -> Column:
    """Excess over the light threshold; grows without an upper bound."""
    value = _number(light)
    excess = (value - F.lit(fixed.LIGHT_THRESHOLD)) / F.lit(fixed.LIGHT_RANGE)
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), excess))


def temperature_effect(temperature) -> Column:
    return _bell(temperature, fixed.OPTIMUM_TEMPERATURE, fixed.TEMPERATURE_WIDTH)


def ph_effect(ph) -> Column:
    return _bell(ph, fixed.OPTIMUM_PH, fixed.PH_WIDTH)


def temperature_stress(temperature) -> Column:
    return F.abs(_number(temperature) - F.lit(fixed.OPTIMUM_TEMPERATURE))


def ph_stress(ph) -> Column:
    return F.abs(_number(ph) - F.lit(fixed.OPTIMUM_PH))


def environmental_stress(heat_stress, acid_stress) -> Column:
    return _number(heat_stress) / F.lit(fixed.TEMPERATURE_STRESS_UNIT) + _number(
        acid_stress
    ) / F.lit(fixed.PH_STRESS_UNIT)


def nutrient_effect(nutrients, ks=fixed.HALDANE_KS, ki=fixed.HALDANE_KI) -> Column:
    """Haldane uptake: saturates, then falls; null where the denominator is zero."""
    n = _number(nutrients)
    return F.try_divide(n, F.lit(ks) + n + n * n / F.lit(ki))


def sin_24h(hours) -> Column:
    return F.sin(F.lit(2 * math.pi) * _number(hours) / F.lit(fixed.DAY_HOURS))


def cos_24h(hours) -> Column:
    return F.cos(F.lit(2 * math.pi) * _number(hours) / F.lit(fixed.DAY_HOURS))


def culture_day(hours) -> Column:
    """Whole days, rounded down also below zero."""
    return F.floor(finite(hours) / F.lit(fixed.DAY_HOURS)).cast("double")


def photosynthetic_capacity(heat_effect, acid_effect, efficiency) -> Column:
    return _number(heat_effect) * _number(acid_effect) * _number(efficiency)


def environmental_quality(capacity, inhibition) -> Column:
    return _number(capacity) * (F.lit(1.0) - _number(inhibition))


# Opt-in formulas, described but not computed by default.


def michaelis_menten_light(light, pmax=fixed.PMAX_LIGHT, half=fixed.HALF_LIGHT) -> Column:
    value = _number(light)
    return F.try_divide(value * F.lit(pmax), value + F.lit(half))


def nutrient_limitation(nutrients) -> Column:
    shifted = _number(nutrients) - F.lit(fixed.SIGMOID_CENTRE)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(fixed.SIGMOID_SLOPE) * shifted))


def monod_nutrient(nutrients, ks=fixed.MONOD_KS) -> Column:
    n = _number(nutrients)
    return F.try_divide(n, n + F.lit(ks))


def density_attenuation(age) -> Column:
    return F.try_divide(F.lit(1.0), F.lit(1.0) + F.lit(fixed.AGE_ATTENUATION) * _number(age))


def light_penetration(efficiency, attenuation) -> Column:
    return _number(efficiency) * _number(attenuation)
