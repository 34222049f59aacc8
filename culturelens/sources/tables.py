"""Reading observation tables and describing their shape."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from culturelens.fixed import KNOWN_LEAKS
from culturelens.roles import DEFAULT_ROLES, Roles, candidate_columns
from culturelens.sources import headered


class ObservationsNotFound(FileNotFoundError):
    """The table to read does not exist."""


def known_types(roles: Roles = DEFAULT_ROLES) -> dict[str, T.DataType]:
    """Types of the columns with a known role; all others are inferred."""
    doubles = (
        roles.target, roles.time, roles.light, roles.temperature, roles.ph,
        roles.nutrients, roles.age, *KNOWN_LEAKS,
    )
    types: dict[str, T.DataType] = {name: T.DoubleType() for name in doubles}
    types.update({roles.phase: T.StringType(), roles.timestamp: T.StringType(),
                  roles.row_id: T.StringType()})
    return types


def read_observations(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    schema: T.StructType | None = None,
    roles: Roles = DEFAULT_ROLES,
    rejects: str | None = None,
    each_header: bool = True,
) -> DataFrame:
    """Scan headered CSV files or a parquet table lazily.

    CSV columns go by their names, whatever their order in a file; with ``schema`` the result
    has its columns. Types of known columns need no pass; unknown ones cost one inference pass.
    ``rejects`` names a column for lines that do not parse. ``each_header=False`` reads the
    header of one file only, for folders of very many files: another header is then an error.
    """
    try:
        if fmt != "csv":
            return spark.read.format(fmt).load(path)
        if each_header:
            groups = headered.files_by_header(spark, path)
        else:
            groups = {tuple(headered.reader(spark).csv(path).columns): [path]}
        if not groups:
            if schema is None:
                raise ObservationsNotFound(f"no observation table with a header at {path}")
            return spark.createDataFrame([], schema)
        if schema is None:
            types = headered.column_types(spark, groups, known_types(roles))
            return headered.read_groups(spark, groups, types, rejects)
        types = {name: T.StringType() for header in groups for name in header}
        types |= {f.name: f.dataType for f in schema}
        rows = headered.read_groups(spark, groups, types, rejects)
        return rows.select(*[
            F.col(f"`{f.name}`") if f.name in rows.columns
            else F.lit(None).cast(f.dataType).alias(f.name) for f in schema
        ], *([f"`{rejects}`"] if rejects else []))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise ObservationsNotFound(f"no observation table at {path}") from error
        raise


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition by row identity where that at least doubles the running tasks.

    Meant for small tables in few files; a table that already fills half of
    the cores passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() * 2 > cores:
        return df
    return df.repartition(cores, *keys)


def shape_report(df: DataFrame) -> DataFrame:
    """One row per column: rows of the table, columns of the table, nulls in it."""
    width = len(df.columns)
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(df.columns)],
    )
    entries = F.array(*[
        F.struct(
            F.lit(c).alias("column"),
            (F.col("n_rows") - F.col(f"_{i}")).alias("n_null"),
        )
        for i, c in enumerate(df.columns)
    ])
    return counts.select(
        "n_rows", F.lit(width).cast("bigint").alias("n_columns"), F.inline(entries)
    )


def candidate_features(
    df: DataFrame, roles: Roles = DEFAULT_ROLES, double_only: bool = False, keep: tuple = ()
) -> DataFrame:
    """Project the candidate feature columns; the scan reads nothing else."""
    features = candidate_columns(df.schema, roles, double_only)
    return df.select(*keep, *[F.col(f"`{c}`").cast("double").alias(c) for c in features])


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)
