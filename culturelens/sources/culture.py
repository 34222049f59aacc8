"""A culture observation view over the ``lineitem`` test table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from culturelens.sources.session import keep_compiled
from culturelens.sources.tables import read_observations, spread

# {rows} is the table to read and {days} the days since 1995-01-01 in the
# engine's own words; everything else means the same in Spark and in other SQL.
CULTURE_SQL = """
with b as (
  select
    concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string),
              cast(l_partkey as string), cast(l_suppkey as string),
              cast(cast(round(l_extendedprice * 1e2) as bigint) as string)) as row_id,
    cast(l_orderkey % 60 + 1 as int)                  as Scenario,
    cast({days} * 24 + l_partkey % 24 as double)      as Time_h,
    2e1 + l_discount * 1.6e2                          as Temperature_C,
    6.5e0 + l_tax * 3.75e1                            as pH,
    l_quantity * 9e0                                  as PAR_umol_m2_s,
    case when l_linenumber = 7 and l_partkey % 10 = 0 then null
         else l_extendedprice / 3.5e4 end             as Nutrients_g_L,
    case when l_partkey % 50 = 0 then null
         when l_returnflag = 'A' then 'lag'
         when l_returnflag = 'N' then 'exponential'
         else 'stationary' end                        as Growth_Phase,
    1e0                                               as Stirrer_Setpoint,
    (l_partkey % 101) / 1.01e2                        as u,
    (l_suppkey % 37) / 3.7e1                          as w
  from {rows}),
t as (
  select *,
    2e-1 + 2e0 * tanh(1.2e-2 * PAR_umol_m2_s)
         * exp(-((Temperature_C - 2.8e1) * (Temperature_C - 2.8e1)) / 5e1)
         * exp(-((pH - 8e0) * (pH - 8e0)) / 2e0) + 3e-1 * u as Biomass_g_L
  from b)
select row_id, Scenario, Time_h, Temperature_C, pH, PAR_umol_m2_s,
  Nutrients_g_L, Growth_Phase, Stirrer_Setpoint, Biomass_g_L,
  Biomass_g_L * 1e7                as Cell_Concentration_cells_mL,
  9e-1 * Biomass_g_L + 5e-2 * w    as Optical_Density_750
from t
"""

SPARK_DAYS = "datediff(l_shipdate, date'1995-01-01')"


def culture_rows(lineitem: DataFrame) -> DataFrame:
    """The view over rows of ``lineitem``, a table or a stream."""
    keep_compiled(lineitem.sparkSession)
    return lineitem.sparkSession.sql(
        CULTURE_SQL.format(rows="{rows}", days=SPARK_DAYS), rows=lineitem)


def culture_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = read_observations(spark, f"{sf_dir}/lineitem.parquet", fmt="parquet")
    return culture_rows(spread(lineitem, "l_orderkey", "l_linenumber"))
