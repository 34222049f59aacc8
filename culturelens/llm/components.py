"""Distributed union-find by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from culturelens.llm.common import forget, written


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with m, the least neighbour of u, or u itself."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").withColumn("m", F.least("u", "m"))


def _stars(edges: DataFrame) -> DataFrame:
    """One large and one small star over edges with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = (_with_least(both).where("v > u")
             .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
    small = _with_least(large)
    return (small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) of every node that has an edge; a component is its least node.

    Self-loops, repeated edges and nulls add nothing. Each round is written to the
    shared folder, so lineage stays short; the rounds grow with the logarithm of the
    nodes. Hubs are only joined and reduced with partial aggregation, never collected.
    """
    a, b = F.col(left), F.col(right)
    links = written(
        edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(), "links")
    state = _state(links)
    while state[0]:
        step = written(_stars(links), "links")
        forget(links)
        links, before, state = step, state, _state(step)
        if state == before:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
