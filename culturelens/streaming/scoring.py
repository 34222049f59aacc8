"""Scoring a stream of observations with a fitted run.

Features, clipping, scaling and prediction are stateless projections, so the
batch function runs on a ``readStream`` frame as it is: no watermark, no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from culturelens.plans.run import FittedRun, score


def score_stream(observations: DataFrame, fitted: FittedRun) -> DataFrame:
    if not observations.isStreaming:
        raise ValueError("expected a streaming table; use score() for a batch table")
    return score(observations, fitted)


def score_available(observations: DataFrame, fitted: FittedRun, folder: str) -> DataFrame:
    """Score what a stream holds now into a table under ``folder``, and return the table.

    The checkpoint beside the table remembers what was scored: another call, also after a
    lost driver, adds only what is new, each row once.
    """
    scored = score_stream(observations, fitted)
    table = f"{folder}/scored"
    (scored.writeStream.format("parquet").outputMode("append")
     .option("checkpointLocation", f"{folder}/progress")
     .trigger(availableNow=True).start(table).awaitTermination())
    return observations.sparkSession.read.schema(scored.schema).parquet(table)
