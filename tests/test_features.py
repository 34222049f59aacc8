import math

import pytest
from pyspark.sql import functions as F

from culturelens import fixed
from culturelens.functions import physiology as bio
from culturelens.operators import cleaning, features
from culturelens.roles import Roles

SCHEMA = ("Time_h double, PAR_umol_m2_s double, Temperature_C double, pH double,"
          " Nutrients_g_L double, Biomass_g_L double")


def frame(spark, **changes):
    row = {"Time_h": 0.0, "PAR_umol_m2_s": 300.0, "Temperature_C": 28.0, "pH": 8.0,
           "Nutrients_g_L": 0.5, "Biomass_g_L": 1.0, **changes}
    return spark.createDataFrame([tuple(row.values())], SCHEMA)


def derived(spark, **changes):
    return features.add_features(frame(spark, **changes)).first()


def test_optimum(spark):
    row = derived(spark)
    assert row.temperature_effect == row.ph_effect == 1.0
    assert row.photoinhibition == row.temperature_stress == row.ph_stress == 0.0
    assert row.light_efficiency == pytest.approx(math.tanh(3.6))
    assert row.environmental_quality == row.photosynthetic_capacity == row.light_efficiency


def test_light_above_the_threshold_is_not_capped(spark):
    row = derived(spark, PAR_umol_m2_s=500.0)
    assert row.photoinhibition == 2.0
    assert row.environmental_quality == pytest.approx(-math.tanh(6.0))


def test_stress_terms(spark):
    row = derived(spark, Temperature_C=18.0, pH=7.0)
    assert (row.temperature_stress, row.ph_stress, row.environmental_stress) == (10.0, 1.0, 1.5)
    assert row.temperature_effect == pytest.approx(math.exp(-2))
    assert row.ph_effect == pytest.approx(math.exp(-0.5))


@pytest.mark.parametrize("hours,day", [(0, 0), (6, 0), (24, 1), (25, 1), (-1.5, -1)])
def test_daily_cycle(spark, hours, day):
    row = derived(spark, Time_h=float(hours))
    assert row.culture_day == day
    assert row.sin_24h == pytest.approx(math.sin(2 * math.pi * hours / 24), abs=1e-12)
    assert row.cos_24h == pytest.approx(math.cos(2 * math.pi * hours / 24), abs=1e-12)


def test_nutrients(spark):
    assert derived(spark, Nutrients_g_L=0.0).nutrient_effect == 0.0
    assert derived(spark, Nutrients_g_L=0.02).nutrient_effect == pytest.approx(
        0.02 / (0.04 + 0.0004 / 1.5))
    zero = frame(spark, Nutrients_g_L=0.0)
    assert zero.select(bio.nutrient_effect("Nutrients_g_L", ks=0.0)).first()[0] is None


def test_nutrient_column_is_optional(spark):
    out = features.add_features(frame(spark).drop("Nutrients_g_L"))
    assert "nutrient_effect" not in out.columns and "culture_day" in out.columns


def test_optional_formulas(spark):
    row = features.add_features(
        frame(spark, PAR_umol_m2_s=150.0, Time_h=10.0), optional=features.OPTIONAL, age="Time_h"
    ).first()
    assert row.michaelis_menten_light == 0.5
    assert row.nutrient_limitation == 0.5
    assert row.monod_nutrient == pytest.approx(0.5 / 0.52)
    assert row.density_attenuation == 0.5
    assert row.light_penetration == 0.25


def test_phase_indicators(spark):
    df = spark.createDataFrame(
        [("lag",), ("decline",), (None,)], "Growth_Phase string"
    )
    levels = features.phase_levels(df)
    assert levels == ["decline", "lag"]
    rows = df.select("*", *[c.alias(n) for n, c in features.phase_indicators(levels).items()])
    found = {r.Growth_Phase: (r.phase_decline, r.phase_lag) for r in rows.collect()}
    assert found == {"lag": (0.0, 1.0), "decline": (1.0, 0.0), None: (0.0, 0.0)}


def test_any_number_of_phases(spark):
    df = spark.range(1200).selectExpr("cast(id as string) as Growth_Phase")
    assert len(features.phase_levels(df)) == 1200


def test_spanish_names(spark):
    out = features.add_features(frame(spark), names="spanish")
    assert set(fixed.SPANISH_NAMES.values()) <= set(out.columns)
    assert "eficiencia_luminica__jassby_platt" in out.columns


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf"), float("-inf")])
def test_invalid_numbers_end_as_zero(spark, bad):
    dirty = frame(spark, PAR_umol_m2_s=bad, Temperature_C=bad, pH=bad, Time_h=bad,
                  Nutrients_g_L=bad)
    row = cleaning.clean_invalid(features.add_features(dirty)).first().asDict()
    assert all(v is not None and math.isfinite(v) for v in row.values())
    assert row["PAR_umol_m2_s"] == row["culture_day"] == row["nutrient_effect"] == 0.0
    # Derived before cleaning: a saturating curve of an infinite input is finite.
    if bad == float("inf"):
        assert row["light_efficiency"] == 1.0 and row["photoinhibition"] == 0.0
    elif bad != float("-inf"):
        assert row["light_efficiency"] == 0.0


def test_cleaning_keeps_text_and_key_types(spark):
    df = spark.createDataFrame(
        [(None, None, None, True), (3, "lag", 2.0, None)],
        "Scenario int, Growth_Phase string, Biomass_g_L double, flag boolean",
    )
    out = cleaning.clean_invalid(df)
    assert dict(out.dtypes) == {"Scenario": "int", "Growth_Phase": "string",
                                "Biomass_g_L": "double", "flag": "boolean"}
    assert out.collect()[0] == (0, None, 0.0, True)
    assert cleaning.clean_invalid(df, target_nulls="drop").count() == 1


def test_other_role_names(spark):
    roles = Roles(light="light", temperature="t")
    df = frame(spark).withColumnsRenamed({"PAR_umol_m2_s": "light", "Temperature_C": "t"})
    assert features.add_features(df, roles).first().temperature_effect == 1.0


def test_features_need_no_shuffle(spark):
    names = [part.split()[0] for part in SCHEMA.split(",")]
    df = features.add_features(
        spark.range(10).select(*[F.rand(1).alias(c) for c in names]), levels=[]
    )
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
