"""Constants, names and limits the results depend on."""

# Physiology constants.
ALPHA_LIGHT = 0.012
PMAX_LIGHT = 1.0
LIGHT_THRESHOLD = 300.0
LIGHT_RANGE = 100.0
OPTIMUM_TEMPERATURE = 28.0
TEMPERATURE_WIDTH = 50.0
OPTIMUM_PH = 8.0
PH_WIDTH = 2.0
TEMPERATURE_STRESS_UNIT = 10.0
PH_STRESS_UNIT = 2.0
HALDANE_KS = 0.02
HALDANE_KI = 1.5
DAY_HOURS = 24.0
HALF_LIGHT = 150.0
SIGMOID_SLOPE = 5.0
SIGMOID_CENTRE = 0.5
MONOD_KS = 0.02
AGE_ATTENUATION = 0.1

# Columns that leak the target whatever their correlation.
KNOWN_LEAKS = (
    "Cell_Concentration_cells_mL",
    "Cell_Density_10E6_mL",
    "Instantaneous_Productivity_g_L_d",
    "Specific_Growth_Rate_h",
)
LEAK_THRESHOLD = 0.95

# Clipping, splits, scaling.
CLIP_LOW = 0.005
CLIP_HIGH = 0.995
GROUP_SEED = 50
ROW_SEED = 42
GROUP_DIVISOR = 4
ROW_HOLDOUT_SHARE = 0.25
INNER_HOLDOUT_SHARE = 0.2

# Report limits.
RISK_HIGH = 0.99
RISK_MEDIUM = 0.97
MAPE_OFFSET = 1e-10
PREVIEW_FEATURES = 18
TOP_FEATURES = 10
HISTOGRAM_BINS = 30
CURVE_POINTS = 100
CHART_MODELS = 4

# Spanish names of the derived columns.
SPANISH_NAMES = {
    "light_efficiency": "eficiencia_luminica__jassby_platt",
    "photoinhibition": "fotoinhibicion",
    "temperature_effect": "efecto_temp",
    "ph_effect": "efecto_pH",
    "temperature_stress": "estres_de_temperatura",
    "ph_stress": "estres_ph",
    "environmental_stress": "estres_ambiental",
    "nutrient_effect": "efecto_de_nutrientes_haldane",
    "sin_24h": "sin_24h",
    "cos_24h": "cos_24h",
    "culture_day": "dia_actual",
    "photosynthetic_capacity": "capacidad_fotosintetica",
    "environmental_quality": "calidad_ambiental",
}
