"""Helpers of the operators: tables in the shared folder, checked broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from culturelens.sources.store import shared_folder

# Rows of a side that may be broadcast; beyond it the same join shuffles.
BROADCAST_BYTES = 48 << 20
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Have Spark delete the shuffle files of a query as soon as the query has ended.

    Else they stay until the driver happens to collect its garbage.
    """
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table of the shared folder, which outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(table: DataFrame) -> None:
    """Delete a table made by `written` that nothing reads any more."""
    spark = table.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def join_side(table: DataFrame, row_bytes: int) -> DataFrame:
    """A written table as the small side of a join: broadcast only if its counted size allows."""
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
