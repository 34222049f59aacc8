"""A session setting that wide projections need."""

from __future__ import annotations

from pyspark.sql import SparkSession

METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
COMPILED = 8000    # bytes of a method that HotSpot still compiles; it interprets longer ones


def keep_compiled(spark: SparkSession) -> None:
    """Have Spark cut into short methods what HotSpot would interpret as one long method.

    Spark's documentation of the setting advises this value for HotSpot. A limit that the
    session sets itself stays.
    """
    if METHOD_LIMIT not in spark.conf.getAll:
        spark.conf.set(METHOD_LIMIT, str(COMPILED))
