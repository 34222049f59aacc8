"""The registered queries as plain SQL for another engine.

Written from the formulas, independently of the Spark code: only the source
view and the column names are shared.
"""

from __future__ import annotations

from culturelens.operators import boosting, networks
from culturelens.plans.catalog import LINES, RESPONSES, SPOILED_SQL, STUMP_CUTS, TREE_FEATURES
from culturelens.sources.culture import CULTURE_SQL

DAYS = "date_diff('day', date '1995-01-01', cast(l_shipdate as date))"
SOURCE = ["Time_h", "Temperature_C", "pH", "PAR_umol_m2_s", "Nutrients_g_L", "Stirrer_Setpoint"]
LEAKS = ["Cell_Concentration_cells_mL", "Optical_Density_750"]
PHASES = ["exponential", "lag", "stationary"]

# Cultures that the seeded draw holds out of 60.
DRAWN = [2, 9, 14, 17, 18, 19, 26, 30, 42, 43, 44, 45, 48, 52, 58]

FORMULAS = {
    "light_efficiency": "1e0 * tanh(1.2e-2 * PAR_umol_m2_s / 1e0)",
    "photoinhibition": "case when PAR_umol_m2_s is not null"
                       " then greatest(0e0, (PAR_umol_m2_s - 3e2) / 1e2) end",
    "temperature_effect": "exp(-((Temperature_C - 2.8e1) * (Temperature_C - 2.8e1)) / 5e1)",
    "ph_effect": "exp(-((pH - 8e0) * (pH - 8e0)) / 2e0)",
    "temperature_stress": "abs(Temperature_C - 2.8e1)",
    "ph_stress": "abs(pH - 8e0)",
    "environmental_stress": "abs(Temperature_C - 2.8e1) / 1e1 + abs(pH - 8e0) / 2e0",
    "nutrient_effect": "Nutrients_g_L / nullif(2e-2 + Nutrients_g_L"
                       " + Nutrients_g_L * Nutrients_g_L / 1.5e0, 0e0)",
    "sin_24h": "sin(2e0 * pi() * Time_h / 2.4e1)",
    "cos_24h": "cos(2e0 * pi() * Time_h / 2.4e1)",
    "culture_day": "floor(Time_h / 2.4e1)",
}
LATER = {
    "photosynthetic_capacity": "temperature_effect * ph_effect * light_efficiency",
    "environmental_quality":
        "temperature_effect * ph_effect * light_efficiency * (1e0 - photoinhibition)",
}
DERIVED = [*FORMULAS, *LATER]
OPTIONAL = {
    "michaelis_menten_light": "PAR_umol_m2_s * 1e0 / nullif(PAR_umol_m2_s + 1.5e2, 0e0)",
    "nutrient_limitation": "1e0 / (1e0 + exp(5e0 * (Nutrients_g_L - 5e-1)))",
    "monod_nutrient": "Nutrients_g_L / nullif(Nutrients_g_L + 2e-2, 0e0)",
    "density_attenuation": "1e0 / nullif(1e0 + 1e-1 * Time_h, 0e0)",
    "light_penetration": "PAR_umol_m2_s * 1e0 / nullif(PAR_umol_m2_s + 1.5e2, 0e0)"
                         " * (1e0 / nullif(1e0 + 1e-1 * Time_h, 0e0))",
}
SPANISH = {
    "light_efficiency": "eficiencia_luminica__jassby_platt",
    "photoinhibition": "fotoinhibicion",
    "temperature_effect": "efecto_temp",
    "ph_effect": "efecto_pH",
    "temperature_stress": "estres_de_temperatura",
    "ph_stress": "estres_ph",
    "environmental_stress": "estres_ambiental",
    "nutrient_effect": "efecto_de_nutrientes_haldane",
    "culture_day": "dia_actual",
    "photosynthetic_capacity": "capacidad_fotosintetica",
    "environmental_quality": "calidad_ambiental",
}
CANDIDATES = [*SOURCE, *DERIVED, *[f"phase_{p}" for p in PHASES]]


def r6(expression: str, name: str | None = None) -> str:
    return f"round({expression}, 6) + 0e0 as {name or expression}"


def shown(names: list[str]) -> str:
    # Cell counts are around ten million: their sixth decimal is noise.
    return ", ".join(
        r6(n) if n != "Cell_Concentration_cells_mL" else f"round({n}, 0) + 0e0 as {n}"
        for n in names
    )


def union_all(parts) -> str:
    return "\nunion all\n".join(parts)


def corr(x: str, y: str) -> str:
    return f"case when min({x}) < max({x}) then corr({x}, {y}) end"


def featured(source: str) -> str:
    first = ", ".join(f"{sql} as {name}" for name, sql in FORMULAS.items())
    later = ", ".join(f"{sql} as {name}" for name, sql in LATER.items())
    return f"select *, {later} from (select *, {first} from {source})"


def zero_filled(name: str) -> str:
    return f"coalesce(case when isfinite({name}) then {name} end, 0e0) as {name}"


CULTURE = f"culture as ({CULTURE_SQL.format(rows='lineitem', days=DAYS)})"
FEATURED = f"featured as ({featured('culture')})"
KEPT_COLUMNS = ["row_id", "Scenario", "Growth_Phase", "Biomass_g_L", *SOURCE]
PHASE_SQL = ", ".join(
    f"case when Growth_Phase = '{p}' then 1e0 else 0e0 end as phase_{p}" for p in PHASES
)
CLEANED = f"""cleaned as (
  select row_id, Scenario, Growth_Phase, {zero_filled('Biomass_g_L')},
    {', '.join(zero_filled(c) for c in [*SOURCE, *DERIVED])}, {PHASE_SQL}
  from featured)"""
CLIP_COLUMNS = [*SOURCE, *DERIVED]
BOUNDS = "bounds as (select {} from cleaned)".format(", ".join(
    f"quantile_cont({c}, 0.005) as {c}_lo, quantile_cont({c}, 0.995) as {c}_hi"
    for c in CLIP_COLUMNS
))
CLIPPED = """clipped as (
  select row_id, Scenario, Growth_Phase, Biomass_g_L, {}, {} from cleaned, bounds)""".format(
    ", ".join(f"least(greatest({c}, {c}_lo), {c}_hi) as {c}" for c in CLIP_COLUMNS),
    ", ".join(f"phase_{p}" for p in PHASES),
)
SCORES = """correlated as ({}),
scores as (
  select feature, r, abs(r) as abs_r,
    case when r is null then 0e0 else r * r / (1e0 - r * r) * (n - 2) end as f
  from correlated)""".format(union_all(
    f"select '{c}' as feature, count(*) as n, {corr(c, 'Biomass_g_L')} as r from clipped"
    for c in CANDIDATES
))
VOTES = """cuts as (select median(abs_r) as r_cut, median(f) as f_cut from scores),
votes as (
  select feature, r, abs_r, f,
    coalesce(abs_r > r_cut, false) as by_correlation, f > f_cut as by_f_score,
    cast(cast(coalesce(abs_r > r_cut, false) as int) + cast(f > f_cut as int) as int) as votes
  from scores, cuts)"""
CLIP_CHAIN = ",\n".join([CULTURE, FEATURED, CLEANED, BOUNDS, CLIPPED])
SELECT_CHAIN = ",\n".join([CLIP_CHAIN, SCORES, VOTES])

HELD = """held as (
  select Scenario from (select distinct Scenario from culture)
  order by md5(concat('50-', cast(Scenario as varchar)))
  limit (select greatest(1, count(distinct Scenario) // 4) from culture))"""


def in_share(key: str, seed: int, limit: str) -> str:
    return f"substr(md5(concat('{seed}-', {key})), 1, 8) < '{limit}'"


IS_INNER = in_share("row_id", 43, "33333333")
SPLIT = f"""{HELD},
train as (select * from featured where Scenario not in (select Scenario from held)),
validation as (select * from featured where Scenario in (select Scenario from held)),
inner_train as (select * from train where not {IS_INNER}),
inner_held as (select * from train where {IS_INNER})"""
SPLIT_CHAIN = ",\n".join([CULTURE, FEATURED, SPLIT])

LINE_FIT = "fit as (select {} from inner_train)".format(", ".join(
    f"regr_slope(Biomass_g_L, {f}) as {m}_b, regr_intercept(Biomass_g_L, {f}) as {m}_a"
    for m, f in LINES.items()
))


def predicted(frame: str, source: str) -> str:
    columns = ", ".join(f"{m}_a + {m}_b * {f} as pred_{m}" for m, f in LINES.items())
    return f"{frame} as (select row_id, Biomass_g_L as y, {columns} from {source}, fit)"


ERRORS = "errors as ({})".format(union_all(
    f"select {i} as position, '{m}' as model,"
    f" avg((y - pred_{m}) * (y - pred_{m})) as mse from inner_scored"
    for i, m in enumerate(LINES)
))
WEIGHTS = """weights as (
  select position, model, mse, (1e0 / mse) / (sum(1e0 / mse) over ()) as weight
  from errors where mse > 0)"""
LINE_CHAIN = ",\n".join([
    SPLIT_CHAIN, LINE_FIT, predicted("inner_scored", "inner_train_held"),
]).replace("inner_train_held", "inner_held")
SCORED = predicted("scored", "validation")
ENSEMBLE = "combined as (select *, {} as pred_Ensemble from scored)".format(" + ".join(
    f"(select weight from weights where model = '{m}') * pred_{m}" for m in LINES
))
ENSEMBLE_CHAIN = ",\n".join([LINE_CHAIN, ERRORS, WEIGHTS, SCORED, ENSEMBLE])


def _metric_row(position: int, m: str) -> str:
    miss = f"(y - pred_{m})"
    return f"""select {position} as position, '{m}' as model,
  1e0 - sum({miss} * {miss}) / (var_pop(y) * count(*)) as r2,
  sqrt(avg({miss} * {miss})) as rmse,
  avg(abs({miss})) as mae,
  avg(abs({miss} / (y + 1e-10))) * 1e2 as mape,
  1e0 - sum({miss} * {miss}) / (var_pop(y) * count(*)) as nse,
  sum(pred_{m} - y) / sum(y) * 1e2 as bias
  from combined"""


METRICS = """measured as ({}),
metrics as (select *, case when r2 > 0.99 then 'HIGH' when r2 > 0.97 then 'MEDIUM'
  else 'LOW' end as risk from measured)""".format(
    union_all(_metric_row(i, m) for i, m in enumerate([*LINES, "Ensemble"]))
)
METRIC_CHAIN = ",\n".join([ENSEMBLE_CHAIN, METRICS])
RESIDUAL_CHAIN = ",\n".join([
    LINE_CHAIN, SCORED,
    "residual as (select row_id, pred_Capacity as predicted, y - pred_Capacity as e from scored)",
])

# Three scaled responses x1, x2, x3 and the scaled target v.
QUARTILES = "quartiles as (select {}, avg(Biomass_g_L) as my, stddev_pop(Biomass_g_L) as sy from train)".format(
    ", ".join(
        f"quantile_cont({c}, {p}) as q{i}_{n}"
        for i, c in enumerate(RESPONSES, 1) for n, p in (("a", 0.25), ("b", 0.5), ("c", 0.75))
    )
)


def scaled(frame: str, source: str) -> str:
    xs = ", ".join(
        f"({c} - q{i}_b) / (q{i}_c - q{i}_a) as x{i}" for i, c in enumerate(RESPONSES, 1)
    )
    return f"{frame} as (select row_id, {xs}, (Biomass_g_L - my) / sy as v, my, sy from {source}, quartiles)"


def cramer(alpha: str) -> tuple[str, str]:
    """Moments and slopes by Cramer's rule for three features, alpha on the diagonal."""
    moments = ", ".join(
        [f"count(*) * covar_pop(x{i}, x{j}) {'+ ' + alpha if i == j else ''} as c{i}{j}"
         for i in (1, 2, 3) for j in (1, 2, 3)]
        + [f"count(*) * covar_pop(x{i}, v) as d{i}" for i in (1, 2, 3)]
        + [f"avg(x{i}) as m{i}" for i in (1, 2, 3)] + ["avg(v) as mv"]
    )

    def determinant(replaced: int | None) -> str:
        a = [[f"d{i}" if j == replaced else f"c{i}{j}" for j in (1, 2, 3)] for i in (1, 2, 3)]
        return (
            f"({a[0][0]} * ({a[1][1]} * {a[2][2]} - {a[1][2]} * {a[2][1]})"
            f" - {a[0][1]} * ({a[1][0]} * {a[2][2]} - {a[1][2]} * {a[2][0]})"
            f" + {a[0][2]} * ({a[1][0]} * {a[2][1]} - {a[1][1]} * {a[2][0]}))"
        )

    slopes = ", ".join(f"{determinant(k)} / {determinant(None)} as w{k}" for k in (1, 2, 3))
    return moments, slopes


def least_squares(alpha: str) -> str:
    moments, slopes = cramer(alpha)
    chain = ",\n".join([
        SPLIT_CHAIN, QUARTILES, scaled("block", "inner_train"), scaled("unseen", "validation"),
        f"moments as (select {moments} from block)",
        f"solved as (select *, {slopes} from moments)",
    ])
    line = "mv + " + " + ".join(f"w{k} * (x{k} - m{k})" for k in (1, 2, 3))
    return f"with {chain}\nselect row_id, {r6(f'({line}) * sy + my', 'predicted')} from unseen, solved"


# Two rounds of boosted stumps: whole residual units, gains with both penalties.
UNITS = f"{boosting.UNIT}e0"


def _shrunk(g: str) -> str:
    return f"sign({g}) * greatest(abs({g}) - 1e-1, 0e0)"


def _stump(k: int, source: str) -> str:
    cells = union_all(
        f"select {f} as f, {c!r}::double as c, sum(g) filter ({x} < {c!r}) as gl,"
        f" count(*) filter ({x} < {c!r}) as nl, sum(g) as gt, count(*) as nt from residual{k}"
        for f, x in enumerate(RESPONSES) for c in STUMP_CUTS)
    sides = {"l": ("gl", "nl"), "r": ("(gt - gl)", "(nt - nl)"), "t": ("gt", "nt")}
    shrunk = {s: _shrunk(f"{g} / {UNITS}") for s, (g, _) in sides.items()}
    gain = " + ".join(f"({shrunk[s]}) * ({shrunk[s]}) / ({sides[s][1]} + 1e0)" for s in "lr")
    case = " ".join(f"when {f} then {x}" for f, x in enumerate(RESPONSES))
    return f"""residual{k} as (
  select *, round_even((Biomass_g_L - p) * {UNITS}, 0)::bigint as g from {source}
  where row_id in (select row_id from inner_train)),
cells{k} as (select *, {gain} - ({shrunk['t']}) * ({shrunk['t']}) / (nt + 1e0) as gain
  from ({cells}) where nl > 0 and nl < nt),
cut{k} as (select f, c, 3e-1 * ({shrunk['l']}) / (nl + 1e0) as vl,
    3e-1 * ({shrunk['r']}) / (nt - nl + 1e0) as vr
  from cells{k} order by gain desc, f, c limit 1),
round{k} as (select * exclude (p, f, c, vl, vr),
    p + case when case f {case} end < c then vl else vr end as p
  from {source}, cut{k})"""


def boosted_stumps() -> str:
    return f"""with {SPLIT_CHAIN},
round0 as (select *, (select sum(round(Biomass_g_L * {UNITS})::hugeint)::double / {UNITS} / count(*)
  from inner_train) as p from featured),
{_stump(1, 'round0')},
{_stump(2, 'round1')}
select row_id, {r6('p', 'predicted')} from round2 where row_id in (select row_id from validation)"""


# A regression tree of depth two: prefix sums over the ordered values of each sensor.
def _best_cuts(level: int, source: str) -> str:
    values = union_all(
        f"select node, {f} as f, {x} as x, count(*) as n, sum(Biomass_g_L) as s"
        f" from {source} group by all" for f, x in enumerate(TREE_FEATURES))
    return f"""values{level} as ({values}),
prefix{level} as (select node, f, x, sum(n) over upto as nl, sum(s) over upto as sl,
    sum(n) over whole as nt, sum(s) over whole as st
  from values{level} window upto as (partition by node, f order by x),
    whole as (partition by node, f)),
cut{level} as (select node, f, x, sl * sl / nl + (st - sl) * (st - sl) / (nt - nl)
    - st * st / nt as gain
  from prefix{level} where nl < nt
  qualify row_number() over (partition by node order by gain desc, f, x) = 1)"""


def _tree() -> str:
    case = " ".join(f"when {f} then {x}" for f, x in enumerate(TREE_FEATURES))

    def below(level: int, source: str) -> str:
        return (f"select r.* exclude (node), 2 * r.node + 1 + (case f {case} end > c.x)::int as node"
                f" from {source} r join cut{level} c on r.node = c.node")

    return f"""with {SPLIT_CHAIN},
grown0 as (select *, 0 as node, row_id in (select row_id from inner_train) as fits
  from featured),
fit0 as (select * from grown0 where fits),
{_best_cuts(0, 'fit0')},
grown1 as ({below(0, 'grown0')}),
fit1 as (select * from grown1 where fits),
{_best_cuts(1, 'fit1')},
grown2 as ({below(1, 'grown1')}),
leaves as (select node, avg(Biomass_g_L) as p from grown2 where fits group by node)"""


# Both networks at their initial weights: a bias is the weight of a constant 1.
def _weights(matrix, bias) -> str:
    columns = [[*map(float, column), float(b)] for column, b in zip(matrix.T, bias)]
    return "[" + ", ".join("[" + ", ".join(f"{v!r}::double" for v in c) + "]" for c in columns) + "]"


def _units(x: str, matrix, bias, form: str = "{}") -> str:
    unit = form.format(f"list_inner_product(list_append({x}, 1e0), w)")
    return f"[{unit} for w in {_weights(matrix, bias)}]"


def _net_chain() -> str:
    width = len(RESPONSES)
    d, g = (networks.initial_params(k, width, 42) for k in ("dense", "gated"))
    relu, sigmoid = "greatest({}, 0e0)", "(5e-1 * (1e0 + tanh(5e-1 * {})))"
    xs = ", ".join(f"x{k}" for k in range(1, width + 1))
    normal = ", ".join(f"(x{k} - a{k}) / b{k}" for k in range(1, width + 1))
    gates = {n: (g[f"w_{n}"], g[f"b_{n}"] + g[f"r_{n}"]) for n in ("in", "cell", "out")}
    return ",\n".join([
        SPLIT_CHAIN, QUARTILES, scaled("block", "inner_train"), scaled("unseen", "validation"),
        "moments as (select {} from block)".format(", ".join(
            f"avg(x{k}) as a{k}, sqrt(var_pop(x{k}) + 1e-5) as b{k}"
            for k in range(1, width + 1))),
        "points as (select *, true as fits from block union all select *, false from unseen)",
        f"layer1 as (select *, {_units(f'[{normal}]', d['w1'], d['b1'], relu)} as h,"
        f" {_units(f'[{xs}]', *gates['in'], sigmoid)} as gi,"
        f" {_units(f'[{xs}]', *gates['cell'], 'tanh({})')} as gc,"
        f" {_units(f'[{xs}]', *gates['out'], sigmoid)} as go from points, moments)",
        f"layer2 as (select *, {_units('h', d['w2'], d['b2'], relu)} as h2,"
        " [go[i] * tanh(gi[i] * gc[i]) for i in range(1, len(go) + 1)] as state from layer1)",
        f"layer3 as (select *, {_units('state', g['w1'], g['b1'], relu)} as s1 from layer2)",
        f"scored as (select *, {_units('h2', d['w3'], d['b3'])}[1] as dense,"
        f" {_units('s1', g['w2'], g['b2'])}[1] as gated from layer3)",
    ])


# The whole run on the three leading features, whichever these turn out to be.
def _value_of(k: int, source: str) -> str:
    cases = " ".join(f"when '{c}' then {source}.{c}" for c in CANDIDATES)
    return f"case (select feature from chosen where k = {k}) {cases} end as f{k}"


def _whole_run() -> str:
    parts = [
        SELECT_CHAIN, HELD,
        """chosen as (select feature,
  row_number() over (order by votes desc, abs_r desc nulls last, feature) as k
  from votes where votes > 0)""",
        "picked as (select row_id, Scenario, Biomass_g_L as y, {} from clipped)".format(
            ", ".join(_value_of(k, "clipped") for k in (1, 2, 3))
        ),
        "picked_train as (select * from picked where Scenario not in (select Scenario from held))",
        "fit_scale as (select avg(y) as my, stddev_pop(y) as sy, {} from picked_train)".format(
            ", ".join(
                f"quantile_cont(f{k}, {p}) as q{k}_{n}"
                for k in (1, 2, 3) for n, p in (("a", 0.25), ("b", 0.5), ("c", 0.75))
            )
        ),
        "points as (select row_id, Scenario, y, (y - my) / sy as v, my, sy, {}"
        " from picked, fit_scale)".format(", ".join(
            f"(f{k} - q{k}_b) / case when q{k}_c = q{k}_a then 1e0 else q{k}_c - q{k}_a end as x{k}"
            for k in (1, 2, 3)
        )),
        "block as (select * from points where Scenario not in (select Scenario from held)"
        f" and not {IS_INNER})",
    ]
    lines = []
    for name, alpha in (("Linear", "0e0"), ("Ridge", "1e2")):
        moments, slopes = cramer(alpha)
        parts.append(f"moments_{name} as (select {moments} from block)")
        renamed = slopes
        for k in (1, 2, 3):
            renamed = renamed.replace(f" as w{k}", f" as {name}_w{k}")
        parts.append(
            f"solved_{name} as (select {renamed}, mv as {name}_mv,"
            f" {', '.join(f'm{k} as {name}_m{k}' for k in (1, 2, 3))} from moments_{name})"
        )
        line = " + ".join(f"{name}_w{k} * (x{k} - {name}_m{k})" for k in (1, 2, 3))
        lines.append(f"{name}_mv + {line} as s_{name}")
    parts += [
        f"all_scored as (select row_id, Scenario, y, v, my, sy, {', '.join(lines)}"
        " from points, solved_Linear, solved_Ridge)",
        "inner_errors as (select avg((v - s_Linear) * (v - s_Linear)) as e_Linear,"
        " avg((v - s_Ridge) * (v - s_Ridge)) as e_Ridge from all_scored"
        f" where Scenario not in (select Scenario from held) and {IS_INNER})",
        """unscaled as (select row_id, Scenario, y, s_Linear * sy + my as pred_Linear,
  s_Ridge * sy + my as pred_Ridge,
  (s_Linear / e_Linear + s_Ridge / e_Ridge) / (1e0 / e_Linear + 1e0 / e_Ridge) * sy + my
    as pred_Ensemble
  from all_scored, inner_errors)""",
        "combined as (select * from unscaled where Scenario in (select Scenario from held))",
        """measured as ({}),
metrics as (select *, case when r2 > 0.99 then 'HIGH' when r2 > 0.97 then 'MEDIUM'
  else 'LOW' end as risk from measured)""".format(
            union_all(_metric_row(i, m) for i, m in enumerate(["Linear", "Ridge", "Ensemble"]))
        ),
    ]
    return "with " + ",\n".join(parts)


def _line_row(feature: str, alpha: float) -> str:
    slope = (
        f"count(*) * covar_pop({feature}, Biomass_g_L) / (count(*) * var_pop({feature}) + {alpha!r})"
    )
    return (
        f"select '{feature}' as feature, cast({alpha!r} as double) as alpha,"
        f" {r6(slope, 'slope')},"
        f" {r6(f'avg(Biomass_g_L) - {slope} * avg({feature})', 'intercept')} from train"
    )


ROBUST_COLUMNS = ["Time_h", "Nutrients_g_L", "Stirrer_Setpoint", *DERIVED]
CLEAN_TRAIN = f"""{CLEANED}, {HELD},
clean_train as (select * from cleaned where Scenario not in (select Scenario from held))"""


def _iqr(c: str) -> str:
    return f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"


ROBUST_STATS = union_all(
    f"select '{c}' as feature, quantile_cont({c}, 0.25) as q25, median({c}) as q50,"
    f" quantile_cont({c}, 0.75) as q75,"
    f" case when {_iqr(c)} = 0 then 1e0 else {_iqr(c)} end as scale from clean_train"
    for c in ROBUST_COLUMNS
)
ROBUST_WIDE = ", ".join(
    f"median({c}) as {c}_m, case when {_iqr(c)} = 0 then 1e0 else {_iqr(c)} end as {c}_s"
    for c in ROBUST_COLUMNS
)


def _nulls(column: str) -> str:
    return (
        f"select count(*) as n_rows, cast(12 as bigint) as n_columns, '{column}' as \"column\","
        f" count(*) - count({column}) as n_null from culture"
    )


def all_oracles() -> dict[str, str]:
    view = f"with {CULTURE}\n"
    numbers = [*SOURCE, "Biomass_g_L", *LEAKS]
    everything = f"select row_id, Scenario, Growth_Phase, {shown(numbers)} from culture"
    leaks = ",\n".join([CULTURE, "report as ({})".format(union_all(
        f"select '{c}' as feature, {corr(c, 'Biomass_g_L')} as r,"
        f" '{c}' = 'Cell_Concentration_cells_mL' as known from culture"
        for c in ["Scenario", *SOURCE, *LEAKS]
    ))])
    features_chain = f"with {CULTURE}, {FEATURED}\n"
    spoiled = f"with {CULTURE}, spoiled as ({SPOILED_SQL.format(rows='culture')}),\n"
    cleaned_names = ["Biomass_g_L", *SOURCE, *DERIVED]
    found = {
        "observations": view + everything,
        "csv_observations": view + everything,
        "csv_rejects": view + "select row_id, PAR_umol_m2_s = 9e0 as rejected, {} from culture"
                              .format(r6("case when PAR_umol_m2_s <> 9e0 then pH end", "pH")),
        "shape_report": view + union_all(
            _nulls(c) for c in ["row_id", "Scenario", "Growth_Phase", *numbers]
        ),
        "candidate_features": view + f"select row_id, {shown([*SOURCE, *LEAKS])} from culture",
        "drop_columns": view + "select row_id, Scenario, Growth_Phase, {} from culture".format(
            shown([*SOURCE, "Biomass_g_L", "Optical_Density_750"])
        ),
        "known_leaks": f"with {leaks} select feature, known from report where known",
        "leak_report": f"with {leaks} select feature, {r6('r')}, known,"
                       " coalesce(abs(r) > 0.95, false) as leak from report",
        "removed_leaks": f"with {leaks} select feature from report"
                         " where known or coalesce(abs(r) > 0.95, false)",
        "leak_free_observations": view + "select row_id, Scenario, Growth_Phase, {}"
                                         " from culture".format(shown([*SOURCE, "Biomass_g_L"])),
        "phase_indicators": view + f"select row_id, {PHASE_SQL} from culture",
        "physiology_features": features_chain
        + f"select row_id, {shown(DERIVED)} from featured",
        "physiology_features_spanish": features_chain + "select row_id, {} from featured".format(
            ", ".join(r6(c, SPANISH.get(c, c)) for c in DERIVED)
        ),
        "clean_invalid": spoiled + "featured as ({}), cleaned as (select row_id, Scenario,"
        " Growth_Phase, {} from featured) select row_id, Scenario, Growth_Phase, {}"
        " from cleaned".format(
            featured("spoiled"), ", ".join(map(zero_filled, cleaned_names)), shown(cleaned_names)
        ),
        "drop_invalid_targets": f"with {CULTURE}, spoiled as"
        f" ({SPOILED_SQL.format(rows='culture')})\nselect row_id, {r6('Biomass_g_L')}"
        " from spoiled where Biomass_g_L is not null",
        "clip_bounds": f"with {CULTURE}, {FEATURED}, {CLEANED}\n" + union_all(
            f"select '{c}' as feature, {r6(f'quantile_cont({c}, 0.005)', 'lo')},"
            f" {r6(f'quantile_cont({c}, 0.995)', 'hi')} from cleaned" for c in CLIP_COLUMNS
        ),
        "clipped_observations": f"with {CLIP_CHAIN}\nselect row_id, Scenario, Growth_Phase,"
        f" {shown(['Biomass_g_L', *CANDIDATES])} from clipped",
        "correlation_ranking": f"with {SELECT_CHAIN}\nselect feature, {r6('abs_r')},"
        f" {r6('r_cut', 'cut')}, by_correlation as selected from votes, cuts",
        "f_score_ranking": f"with {SELECT_CHAIN}\nselect feature, {r6('f')},"
        f" {r6('f_cut', 'cut')}, by_f_score as selected from votes, cuts",
        "feature_votes": f"with {SELECT_CHAIN}\nselect feature, {r6('r')}, {r6('f')},"
        " by_correlation, by_f_score, votes from votes",
        "selected_features": f"with {SELECT_CHAIN}, chosen as (select * from votes"
        " where votes > 0 order by votes desc, abs_r desc nulls last, feature limit 8)\n"
        f"select feature, {r6('abs_r')}, {r6('f')}, votes from chosen",
        "selection_report": f"""with {SELECT_CHAIN},
ranked as (select *, row_number() over (order by votes desc, abs_r desc nulls last, feature) as k
  from votes where votes > 0)
select count(*) as n_candidates, count(*) filter (by_correlation) as n_correlation,
  count(*) filter (by_f_score) as n_f_score, cast(0 as bigint) as n_forest,
  count(*) filter (abs_r = 0) as n_zero_correlation,
  (select count(*) from ranked) as n_selected,
  (select string_agg(feature, ',' order by k) from ranked where k <= 18) as first_features
from votes""",
        "culture_groups": view + "select distinct Scenario from culture order by Scenario",
        "group_holdout": f"with {CULTURE}, {HELD}\nselect row_id, Scenario, case when Scenario in"
        " (select Scenario from held) then 'validation' else 'train' end as split from culture",
        "group_holdout_draw": view + "select row_id, Scenario, case when Scenario in ({})"
        " then 'validation' else 'train' end as split from culture".format(
            ", ".join(map(str, DRAWN))
        ),
        "group_split_join": f"""with {CULTURE}, {HELD}, flagged as (
  select Biomass_g_L, case when Scenario in (select Scenario from held)
    then 'validation' else 'train' end as split from culture)
select split, count(*) as n_rows, {r6('avg(Biomass_g_L)', 'mean_target')}
from flagged group by split""",
        "row_holdout": view + f"select row_id, case when {in_share('row_id', 42, '40000000')}"
        " then 'validation' else 'train' end as split from culture",
        "inner_holdout": f"with {CULTURE}, {HELD}\nselect row_id, case when"
        f" {in_share('row_id', 42, '33333333')} then 'validation' else 'train' end as split"
        " from culture where Scenario not in (select Scenario from held)",
        "split_counts": f"""with {CULTURE}, {HELD}
select case when Scenario in (select Scenario from held) then 'validation' else 'train' end
  as split, count(*) as n_rows from culture group by 1""",
        "robust_scale_stats": f"with {CULTURE}, {FEATURED}, {CLEAN_TRAIN}, stats as ({ROBUST_STATS})"
        f"\nselect feature, {shown(['q25', 'q50', 'q75', 'scale'])} from stats",
        "robust_scaled": f"with {CULTURE}, {FEATURED}, {CLEAN_TRAIN}, stats as"
        f" (select {ROBUST_WIDE} from clean_train)\nselect row_id, "
        + ", ".join(r6(f"({c} - {c}_m) / {c}_s", c) for c in ROBUST_COLUMNS)
        + " from cleaned, stats",
        "standard_scaled_target": f"with {CULTURE}, {HELD}, stats as (select avg(Biomass_g_L) as m,"
        " stddev_pop(Biomass_g_L) as s from culture where Scenario not in"
        " (select Scenario from held))\nselect row_id,"
        f" {r6('(Biomass_g_L - m) / s', 'y_scaled')} from culture, stats",
        "unscaled_predictions": f"""with {SPLIT_CHAIN},
moments as (select avg(Biomass_g_L) as m, stddev_pop(Biomass_g_L) as s,
  regr_slope(Biomass_g_L, light_efficiency) as b,
  regr_intercept(Biomass_g_L, light_efficiency) as a from train)
select row_id, {r6('(a + b * light_efficiency - m) / s', 'pred_scaled')},
  {r6('a + b * light_efficiency', 'predicted')} from featured, moments""",
        "single_feature_lines": f"with {SPLIT_CHAIN}\n" + union_all(
            _line_row(c, alpha) for c in RESPONSES for alpha in (0.0, 1000.0)
        ),
        "linear_predictions": least_squares("0e0"),
        "ridge_predictions": least_squares("1e2"),
        "holdout_errors": f"with {LINE_CHAIN}, {ERRORS}\nselect model, {r6('mse')} from errors",
        "model_weights": f"with {LINE_CHAIN}, {ERRORS}, {WEIGHTS}\n"
        f"select model, {r6('weight')} from weights",
        "ensemble_prediction": f"with {ENSEMBLE_CHAIN}\n"
        f"select row_id, {r6('pred_Ensemble', 'predicted')} from combined",
        "model_metrics": f"with {METRIC_CHAIN}\nselect model,"
        f" {shown(['r2', 'rmse', 'mae', 'mape', 'nse', 'bias'])}, risk from metrics",
        "best_model": f"with {METRIC_CHAIN}, best as (select * from metrics"
        f" order by r2 desc, position limit 1)\nselect model, {r6('r2')}, {r6('rmse')}, risk"
        " from best",
        "parity_pairs": f"with {LINE_CHAIN}, {SCORED}\nselect row_id, {r6('y', 'observed')},"
        f" {r6('pred_Capacity', 'predicted')} from scored",
        "parity_range": f"with {LINE_CHAIN}, {SCORED}\nselect"
        f" {r6('least(min(y), min(pred_Capacity))', 'low')},"
        f" {r6('greatest(max(y), max(pred_Capacity))', 'high')} from scored",
        "model_comparison": f"with {METRIC_CHAIN}\nselect model, {r6('r2')}, {r6('rmse')},"
        " case when r2 > 0.99 then 'red' when r2 > 0.97 then 'orange' else 'green' end as colour"
        " from metrics",
        "residuals": f"with {RESIDUAL_CHAIN}\nselect row_id, {r6('predicted')},"
        f" {r6('e', 'residual')} from residual",
        "residual_histogram": f"""with {RESIDUAL_CHAIN},
ends as (select min(e) as low, max(e) as high, (max(e) - min(e)) / 3e1 as width,
  count(*) as total from residual),
placed as (select cast(least(floor((e - low) * 30 / (high - low)), 29) as int) as bin
  from residual, ends),
counted as (select bin, count(*) as n from placed group by bin),
bins as (select cast(i as int) as bin from range(30) as t(i))
select bins.bin as bin, {r6('low + bins.bin * width', 'lo')},
  {r6('low + (bins.bin + 1) * width', 'hi')}, coalesce(n, 0) as n,
  {r6('coalesce(n, 0) / (total * width)', 'density')}
from bins cross join ends left join counted on counted.bin = bins.bin""",
        "residual_normal_curve": f"""with {RESIDUAL_CHAIN},
fit_e as (select avg(e) as mean, stddev_pop(e) as deviation, min(e) as low, max(e) as high
  from residual),
curve as (select cast(i as int) as point, low + (high - low) * i / 9.9e1 as x, mean, deviation
  from fit_e, range(100) as t(i))
select point, {r6('x')}, {r6('exp(-((x - mean) / deviation) * ((x - mean) / deviation) / 2e0)'
                            ' / (deviation * sqrt(2e0 * pi()))', 'density')},
  {r6('mean')}, {r6('deviation')} from curve""",
        "closed_form_run": f"{_whole_run()}\nselect model,"
        f" {shown(['r2', 'rmse', 'mae', 'mape', 'nse', 'bias'])}, risk from metrics",
        "streamed_scores": f"{_whole_run()}\nselect row_id, Scenario,"
        f" {shown(['pred_Linear', 'pred_Ridge', 'pred_Ensemble'])} from unscaled",
        "score_raw_rows": f"{_whole_run()}\nselect row_id, culture.Scenario, Growth_Phase,"
        f" {shown([*SOURCE, 'Biomass_g_L', 'Optical_Density_750'])},"
        f" round(Cell_Concentration_cells_mL, 0) + 0e0 as Cell_Concentration_cells_mL,"
        f" {shown(['pred_Linear', 'pred_Ridge', 'pred_Ensemble'])}"
        " from unscaled join culture using (row_id)",
        "boosted_stumps": boosted_stumps(),
        "tree_predictions": f"{_tree()}\nselect row_id, {r6('p', 'predicted')}"
        " from grown2 join leaves using (node) where row_id in (select row_id from validation)",
        "tree_importances": f"{_tree()}, gains as (select f, gain from cut0 union all"
        " select f, gain from cut1)\nselect feature, "
        + r6("coalesce((select sum(gain) from gains where gains.f = t.f), 0e0)"
             " / (select sum(gain) from gains)", "importance")
        + " from (values {}) as t(f, feature)".format(
            ", ".join(f"({f}, '{x}')" for f, x in enumerate(TREE_FEATURES))),
        "initial_net_scores": f"with {_net_chain()}\nselect row_id,"
        f" {r6('dense * sy + my', 'PenaltyNet')}, {r6('gated * sy + my', 'GatedNet')}"
        " from scored where not fits",
        "initial_net_losses": f"with {_net_chain()}\nselect 'PenaltyNet' as model, "
        + r6("avg((dense - v) * (dense - v) + 5e-1 * greatest(-my / sy - dense, 0e0))", "loss")
        + " from scored where fits union all select 'GatedNet', "
        + r6("avg((gated - v) * (gated - v))", "loss") + " from scored where fits",
        "run_report": f"{_whole_run()}, best as (select * from metrics"
        f" order by r2 desc, position limit 1)\nselect model as best_model, {r6('r2')},"
        f" {r6('rmse')}, risk, 2 as n_leaks_removed, 3 as n_features from best",
        "multi_metric": f"with {METRIC_CHAIN}\nselect model, {r6('r2')}, {r6('nse')}"
        " from metrics where position < 4",
    }
    for name in DERIVED:
        found[name] = features_chain + f"select row_id, {r6(name)} from featured"
    for name, sql in OPTIONAL.items():
        found[name] = view + f"select row_id, {r6(sql, name)} from culture"
    return found
