"""State of long computations in the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; without one only local mode goes on, with its own."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("this job needs a shared folder in spark.checkpoint.dir")
        folder = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write `df` and return what was written."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    files, there = _file_system(spark, f"{path}/_SUCCESS")
    return files.exists(there)


def delete(spark: SparkSession, path: str) -> None:
    files, there = _file_system(spark, path)
    files.delete(there, True)
