"""Holding rows back: whole groups, or single rows, without moving any data.

Membership is a predicate on the row's own key, so splitting a table is a
filter inside the scan stage. Only the cut value of the predicate is computed
ahead, from the distinct keys.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from culturelens import fixed
from culturelens.functions.hashing import falls_in_share, seeded_md5
from culturelens.functions.numeric import as_column
from culturelens.operators.quantiles import kth_smallest
from culturelens.sources import store

LISTED_GROUPS = 100_000   # most group keys ranked by one task

TRAIN, VALIDATION = "train", "validation"


def distinct_groups(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct()


def sorted_groups(df: DataFrame, key: str) -> DataFrame:
    return distinct_groups(df, key).orderBy(key)


@dataclass(frozen=True)
class Holdout:
    """A row predicate that is true for held-out rows, or a table of the held-out keys."""

    held: Column | None = None
    keys: DataFrame | None = None    # one column, `_held`
    key: str = ""

    def _same(self, df: DataFrame) -> Column:
        return F.col(f"`{self.key}`").eqNullSafe(F.col("_held"))

    def flag(self, df: DataFrame, name: str = "split") -> DataFrame:
        if self.keys is not None:
            return self.train(df).withColumn(name, F.lit(TRAIN)).unionByName(
                self.validation(df).withColumn(name, F.lit(VALIDATION)))
        return df.withColumn(name, F.when(self.held, VALIDATION).otherwise(TRAIN))

    def train(self, df: DataFrame) -> DataFrame:
        if self.keys is not None:
            return df.join(self.keys, self._same(df), "left_anti")
        return df.where(~self.held)

    def validation(self, df: DataFrame) -> DataFrame:
        if self.keys is not None:
            return df.join(self.keys, self._same(df), "left_semi")
        return df.where(self.held)


def hold_out_groups(
    df: DataFrame,
    key: str,
    seed: int = fixed.GROUP_SEED,
    method: str = "hash",
    listed: int = LISTED_GROUPS,
    groups: DataFrame | None = None,
) -> Holdout:
    """Hold out ``max(1, groups // 4)`` whole groups.

    ``hash`` takes the groups with the smallest seeded hash, at any number of
    groups. ``draw`` takes the classic NumPy draw without replacement from the
    sorted keys: the driver draws positions, a distributed index turns them into keys.
    ``groups`` are the distinct keys, where they are known already.
    """
    groups = (distinct_groups(df, key) if groups is None else groups).persist()
    try:
        n_groups = groups.count()
        if n_groups == 0:
            raise ValueError("no rows to split")
        n_held = max(1, n_groups // fixed.GROUP_DIVISOR)
        if method == "draw":
            return Holdout(keys=_drawn(groups, key, seed, n_groups, n_held), key=key)
        if method != "hash":
            raise ValueError("method must be 'hash' or 'draw'")
        last = _nth_hash(groups, key, seed, n_held, n_groups, listed)
        # Equal hashes of different keys are ranked by the key's text.
        own = seeded_md5(key, seed)
        text = F.coalesce(F.col(key).cast("string"), F.lit(""))
        return Holdout((own < last.h) | ((own == last.h) & (text <= F.lit(last.t))))
    finally:
        groups.unpersist()


def _drawn(groups: DataFrame, key: str, seed: int, n_groups: int, n_held: int) -> DataFrame:
    """The drawn keys; the positions take eight bytes a group on the driver."""
    picked = np.sort(np.random.RandomState(seed).choice(n_groups, n_held, replace=False))
    spark = groups.sparkSession
    ordered = groups.select(F.col(key).alias("_held")).orderBy("_held")
    # Written, so that the ranges that are counted are the ranges that are numbered.
    ranges = store.write_table(ordered.withColumn("_range", F.spark_partition_id()),
                               store.fresh_folder(spark, "groups"))
    sizes = sorted((r["_range"], r["count"]) for r in ranges.groupBy("_range").count().collect())
    starts, total = [], 0
    for number, size in sizes:
        starts.append((number, total))
        total += size
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_held"))
    ranked = ranges.join(
        F.broadcast(spark.createDataFrame(starts, "_range int, _start bigint")), "_range"
    ).withColumn("place", F.col("_start") + within - 1)
    places = spark.createDataFrame(pd.DataFrame({"place": picked.astype("int64")}))
    return ranked.join(places, "place", "left_semi").select("_held")


def _nth_hash(groups: DataFrame, key: str, seed: int, n: int, n_groups: int, listed: int):
    """The n-th smallest ``(hash, key text)``, however many groups there are."""
    hashed = groups.select(
        seeded_md5(key, seed).alias("h"),
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("t"),
    )
    if n_groups > listed:
        # The leading 52 bits, exact as a double, bring it down to a few keys.
        lead = hashed.withColumn("lead", F.conv(F.substring("h", 1, 13), 16, 10).cast("double"))
        cut = kth_smallest(lead, "lead", n, n_groups)
        n -= lead.where(F.col("lead") < cut).count()
        hashed = lead.where(F.col("lead") == cut)
    return hashed.orderBy("h", "t").limit(n).agg(
        F.max(F.struct("h", "t")).alias("last")
    ).select("last.*").first()


def hold_out_rows(
    key: Column | str, share: float = fixed.ROW_HOLDOUT_SHARE, seed: int = fixed.ROW_SEED
) -> Holdout:
    """Hold out about ``share`` of the rows by a hash of their identity."""
    return Holdout(falls_in_share(as_column(key), share, seed))


def hold_out_inner(key: Column | str, seed: int = fixed.ROW_SEED) -> Holdout:
    """The 20 % kept back inside the training block (row id, or group key)."""
    return hold_out_rows(key, fixed.INNER_HOLDOUT_SHARE, seed)


def row_identity(df: DataFrame) -> Column:
    """A text that identifies a row by its content, for tables without a row id."""
    return F.concat_ws(
        "|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("?")) for c in df.columns]
    )


def split_by_groups(df: DataFrame, held: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows for a given table of held-out keys.

    Spark broadcasts the keys where their size allows.
    """
    keys = held.select(key).distinct()
    return df.join(keys, key, "left_anti"), df.join(keys, key, "left_semi")


def split_counts(flagged: DataFrame, name: str = "split") -> DataFrame:
    return flagged.groupBy(name).agg(F.count(F.lit(1)).alias("n_rows"))
