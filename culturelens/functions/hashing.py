"""Seeded hashes of keys: the same on every partitioning and every retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from culturelens.functions.numeric import as_column


def seeded_md5(key: Column | str, seed: int) -> Column:
    text = F.coalesce(as_column(key).cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}-"), text))


def falls_in_share(key: Column | str, share: float, seed: int) -> Column:
    """True for about ``share`` of the keys, always the same ones."""
    limit = format(int(share * 2**32), "08x")
    return F.substring(seeded_md5(key, seed), 1, 8) < F.lit(limit)
