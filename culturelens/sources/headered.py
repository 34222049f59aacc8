"""Headered CSV files of one table, each read in the order of its own header.

Only the first lines of the files are read ahead, OPENED files at a time. Files with the same
header are one scan, and the scans are joined by name: a column that a file lacks is null there.
Where files disagree on the type of an inferred column, numbers widen to doubles and anything
else becomes text. Files without a byte hold no rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPENED = 32

Header = tuple[str, ...]


def reader(spark: SparkSession) -> DataFrameReader:
    return spark.read.options(
        header=True, enforceSchema=False, nanValue="NaN", positiveInf="inf", negativeInf="-inf")


def files_by_header(spark: SparkSession, path: str) -> dict[Header, list[str]]:
    """The files under `path` by the column names that they start with, in order of path."""
    # Without its content column this source lists files and opens none.
    files = sorted(r.path for r in spark.read.format("binaryFile").load(path)
                   .select("path").collect())
    with ThreadPoolExecutor(OPENED) as pool:
        names = list(pool.map(lambda f: tuple(reader(spark).csv(f).columns), files))
    groups: dict[Header, list[str]] = {}
    for header, file in zip(names, files):
        groups.setdefault(header, []).append(file)
    return groups


def common_type(found: list[T.DataType]) -> T.DataType:
    if all(t == found[0] for t in found):
        return found[0]
    return T.DoubleType() if all(isinstance(t, T.NumericType) for t in found) else T.StringType()


def _filled(spark: SparkSession, header: Header, files: list[str], names: list[str]) -> set[str]:
    """Which of `names` have a value in the files: an empty column is inferred as text."""
    text = T.StructType([T.StructField(name, T.StringType()) for name in header])
    row = reader(spark).schema(text).csv(files).agg(
        *[F.count(F.col(f"`{name}`")) for name in names]).first()
    return {name for name, n in zip(names, row) if n}


def column_types(
    spark: SparkSession, groups: Mapping[Header, list[str]], known: Mapping[str, T.DataType]
) -> dict[str, T.DataType]:
    """A type for every column; one pass over the files that have an unknown one."""
    inferred = {
        header: {f.name: f.dataType
                 for f in reader(spark).option("inferSchema", True).csv(files).schema
                 if f.name not in known}
        for header, files in groups.items() if any(name not in known for name in header)
    }
    seen: dict[str, list[T.DataType]] = {}
    for found in inferred.values():
        for name, own in found.items():
            seen.setdefault(name, []).append(own)
    mixed = {name for name, found in seen.items() if T.StringType() in found
             and any(t != T.StringType() for t in found)}
    for header, found in inferred.items():
        doubtful = [n for n in found if n in mixed and found[n] == T.StringType()]
        if doubtful:
            for name in set(doubtful) - _filled(spark, header, groups[header], doubtful):
                seen[name].remove(T.StringType())
    return {name: common_type(found) for name, found in seen.items()} | dict(known)


def read_groups(
    spark: SparkSession,
    groups: Mapping[Header, list[str]],
    types: Mapping[str, T.DataType],
    rejects: str | None = None,
) -> DataFrame:
    """All rows of the files; `rejects` names a text column for lines that do not parse.

    Such a line keeps the values that do parse. With `rejects` a scan parses all its columns, as a
    line is whole or not whatever a query selects.
    """
    scans = []
    for header, files in groups.items():
        fields = [T.StructField(name, types[name]) for name in header]
        own = reader(spark)
        if rejects is not None:
            fields.append(T.StructField(rejects, T.StringType()))
            own = own.options(mode="PERMISSIVE", columnNameOfCorruptRecord=rejects,
                              columnPruning=False)
        scan = own.schema(T.StructType(fields)).csv(files)
        if rejects is not None:
            # Always the line; it names another column, as Spark refuses to read it alone.
            line, other = F.col(f"`{rejects}`"), F.col(f"`{header[0]}`").cast("string")
            scan = scan.withColumn(rejects, F.coalesce(line, F.when(line.isNotNull(), other)))
        scans.append(scan)
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)
    if rejects is None:
        return out
    return out.select(*[f"`{c}`" for c in out.columns if c != rejects], f"`{rejects}`")
