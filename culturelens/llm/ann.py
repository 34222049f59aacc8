"""Approximate nearest neighbours by a forest of random-projection trees.

A node splits at the median projection onto the difference of two of its points. A
query searches all trees through one priority queue, least margin on the wrong side first;
what lies in the leaves it meets is ranked again by the exact cosine. How many leaves, and at which
depth the trees are cut, follows from the exact neighbours of at most PROVED queries:
TARGET of these must be met, at least cost, and no query meets fewer than PROBES leaves.

Trees are fitted on at most SAMPLE vectors, and every vector is put into one leaf of
each tree; rows at a threshold divide by a hash, so leaves stay even. Equal vectors
are one entry with its smallest ids, as many as a result can need. Candidates meet
their queries by leaf, in blocks of at most about BLOCK entries and queries, so no group
grows with a hot leaf. Only the forest is broadcast; its size depends on TREES and SAMPLE alone.

Defined cases: vectors that are null, zero, hold null or non-finite components, or
whose dimension is not the most frequent one, and rows with a null id take no part;
rows with the query's id are its own; ties go to the smaller id; repeated rows
count once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from culturelens.llm.common import written

TREES = 8
LEAF = 512           # entries of a leaf of the uncut trees, at most about
PROBES = 100         # least leaves that a query meets, over all trees
TARGET = 0.95        # share of the proved queries' neighbours that must be met
PROVED = 256         # queries whose exact neighbours set the leaves to meet
LEAF_COST = 500      # of meeting a leaf, in comparisons of two vectors
BLOCK = 4096         # entries or queries of a leaf that one task compares
SAMPLE = 32_768
SAMPLE_LEAF = 8      # least sampled vectors of a leaf
SEED = 7


class Forest(NamedTuple):
    directions: np.ndarray    # (trees, nodes, dimension)
    thresholds: np.ndarray    # (trees, nodes)
    depth: int


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def entries(vectors: DataFrame, id_col: str, vector_col: str, every: int, k: int) -> DataFrame:
    """(entry, vector, ids, asked): distinct vectors, least k + 1 ids, whether any is a query."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                          F.col(vector_col).cast("array<float>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"))
    common = sizes.orderBy(F.col("n").desc(), "size").first()
    if common is not None:
        rows = rows.where(F.size("vector") == common["size"])
    rows = rows.distinct()
    order = Window.partitionBy("vector").orderBy("vec_id")
    least = (rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
             .groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("vector").distinct()
    found = least.join(asked.withColumn("asked", F.lit(True)), "vector", "left")
    return written(found.select(
        F.monotonically_increasing_id().alias("entry"), "vector", "ids",
        F.coalesce("asked", F.lit(False)).alias("asked")), "entries")


def _unit(matrix: np.ndarray) -> np.ndarray:
    matrix = matrix.astype(np.float64)
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def grow(points: np.ndarray, trees: int, depth: int) -> Forest:
    """Trees over sampled unit vectors, level by level."""
    rng = np.random.default_rng(SEED)
    directions = np.zeros((trees, (1 << depth) - 1, points.shape[1]), np.float32)
    thresholds = np.zeros((trees, (1 << depth) - 1), np.float32)
    for t in range(trees):
        inside = {0: np.arange(len(points))}
        for node in range((1 << depth) - 1):
            at = inside.pop(node, np.zeros(0, int))
            line = rng.standard_normal(points.shape[1])
            if len(at) > 1:
                a, b = rng.choice(at, 2, replace=False)
                if (points[a] != points[b]).any():
                    line = points[a] - points[b]
            directions[t, node] = line / np.linalg.norm(line)
            value = points[at] @ directions[t, node].astype(float)
            thresholds[t, node] = np.median(value) if len(at) else 0.0
            right = value > thresholds[t, node]
            inside[2 * node + 1], inside[2 * node + 2] = at[~right], at[right]
    return Forest(directions, thresholds, depth)


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float32)
    return flat.reshape(len(column), -1)


def leaves_of(forest: Forest, unit: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Leaf of each vector in each tree; at a threshold the entry's number decides."""
    trees = len(forest.directions)
    out = np.zeros((len(unit), trees), np.int64)
    for t in range(trees):
        node = out[:, t]
        for level in range(forest.depth):
            margin = (np.einsum("ij,ij->i", unit, forest.directions[t, node])
                      - forest.thresholds[t, node])
            coin = (entry * 2654435761 + t * 40503 >> (level + 5)) & 1
            right = (margin > 1e-9) | ((np.abs(margin) <= 1e-9) & (coin == 1))
            node = 2 * node + 1 + right
        out[:, t] = node - ((1 << forest.depth) - 1)
    return out


def best_first(forest: Forest, margins: np.ndarray) -> Iterator[int]:
    """Leaves (tree * leaves + leaf) as one query meets them, from one queue over all trees.

    The node with the least margin on the wrong side is taken out and followed down to the leaf
    on the query's own side; every child passed by goes into the queue with its margin, or its
    parent's if that is greater.
    """
    inner = (1 << forest.depth) - 1
    queue = [(0.0, tree, 0) for tree in range(len(margins))]
    while queue:
        cost, tree, node = heapq.heappop(queue)
        while node < inner:
            margin = margins.item(tree, node)
            left, right = 2 * node + 1, 2 * node + 2
            node, other = (right, left) if margin > 0 else (left, right)
            heapq.heappush(queue, (max(cost, abs(margin)), tree, other))
        yield (tree << forest.depth) + node - inner


def places_met(order: Iterator[int], leaves: np.ndarray) -> list[int]:
    """Places in `order` at which the first leaf of each row of `leaves` is met, ascending."""
    waiting: dict[int, list[int]] = {}
    for row, own in enumerate(leaves.tolist()):
        for leaf in own:
            waiting.setdefault(leaf, []).append(row)
    open_rows, places = set(range(len(leaves))), []
    for place, leaf in enumerate(order):
        for row in open_rows.intersection(waiting.get(leaf, ())):
            open_rows.remove(row)
            places.append(place)
        if not open_rows:
            break
    return places


def exact_neighbours(index: DataFrame, asked: list[tuple], k: int) -> DataFrame:
    """(query, entry, vector): the k nearest other entries of each (entry, vector) asked."""
    own = np.array([r[0] for r in asked], np.int64)
    shared = index.sparkSession.sparkContext.broadcast(
        _unit(np.array([r[1] for r in asked], np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        score, number = np.zeros((len(queries), 0)), np.zeros((len(queries), 0), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                entry = np.asarray(some.column(0))
                near = queries @ _unit(_matrix(some.column(1))).T
                near[own[:, None] == entry] = -np.inf
                score = np.concatenate([score, near], axis=1)
                number = np.concatenate([number, np.broadcast_to(entry, near.shape)], axis=1)
                if score.shape[1] > k:
                    top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                    score = np.take_along_axis(score, top, axis=1)
                    number = np.take_along_axis(number, top, axis=1)
        query, place = np.nonzero(score > -np.inf)
        yield pa.RecordBatch.from_arrays(
            [pa.array(query, pa.int64()), pa.array(number[query, place], pa.int64()),
             pa.array(score[query, place], pa.float64())], names=["query", "entry", "score"])

    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "entry")
    best = (index.select("entry", "vector")
            .mapInArrow(run, "query long, entry long, score double")
            .withColumn("place", F.row_number().over(order)).where(F.col("place") <= k))
    # at most PROVED * k rows
    return index.select("entry", "vector").join(F.broadcast(best.select("query", "entry")), "entry")


def settle(forest: Forest, index: DataFrame, n: int, k: int) -> tuple[Forest, int]:
    """The forest cut to the cheapest depth, and the leaves that queries must meet there."""
    asked = (index.where("asked").orderBy(F.xxhash64("vector")).limit(PROVED)
             .select("entry", "vector").collect())
    found = exact_neighbours(index, asked, k).collect() if asked and n > 1 else []
    if not found:
        return forest, PROBES
    queries = _unit(np.array([r["vector"] for r in asked], np.float32)).astype(np.float32)
    query = np.array([r["query"] for r in found])
    leaf = leaves_of(forest, _unit(np.array([r["vector"] for r in found], np.float32)),
                     np.array([r["entry"] for r in found], np.int64))
    trees = np.arange(len(forest.directions))
    least, chosen = math.inf, (forest, PROBES)
    for depth in range(forest.depth, -1, -1):
        inner = (1 << depth) - 1
        cut = Forest(forest.directions[:, :inner], forest.thresholds[:, :inner], depth)
        at = (trees << depth) + (leaf >> (forest.depth - depth))
        met = []
        for i, q in enumerate(queries):
            met += places_met(best_first(cut, cut.directions @ q - cut.thresholds), at[query == i])
        probes = max(PROBES, int(np.sort(met)[math.ceil(TARGET * len(met)) - 1]) + 1)
        cost = probes * (LEAF_COST + n / (1 << depth))
        if cost < least:
            least, chosen = cost, (cut, probes)
    return chosen


def _rank(k: int):
    """Exact cosine of the queries and entries of one block; a query's best k + 1 stay."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        number, asks = np.asarray(table["number"]), np.asarray(table["asks"])
        vectors = _matrix(table["vector"].chunk(0)).astype(np.float64)
        vectors_unit = _unit(vectors)
        at, other = np.flatnonzero(asks), np.flatnonzero(~asks)
        out = []
        for part in np.array_split(at, -(-len(at) // 256)) if len(at) and len(other) else []:
            near = vectors_unit[part] @ vectors_unit[other].T
            # entries that rounding might place among the best are scored again, pair by pair
            bar = np.partition(near, -min(k + 1, len(other)), axis=1)[:, -min(k + 1, len(other))]
            q, e = np.nonzero(near >= bar[:, None] - 1e-9)
            a, b = vectors[part[q]], vectors[other[e]]
            score = np.einsum("ij,ij->i", a, b) / (
                np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
            out.append((number[part[q]], number[other[e]], score))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
        return pa.table({"query": pa.array(columns[0], pa.int64()),
                         "entry": pa.array(columns[1], pa.int64()),
                         "score": pa.array(columns[2], pa.float64())})

    return run


def _blocks(placed: DataFrame, probed: DataFrame) -> DataFrame:
    """Entries and queries by leaf, in blocks of at most about BLOCK of either."""
    sizes = (placed.groupBy("leaf").agg(F.count("*").alias("n_entries"))
             .join(probed.groupBy("leaf").agg(F.count("*").alias("n_queries")), "leaf"))
    cuts = written(sizes.select(
        "leaf", F.ceil(F.col("n_entries") / BLOCK).cast("int").alias("entry_blocks"),
        F.ceil(F.col("n_queries") / BLOCK).cast("int").alias("query_blocks")), "leaves")
    small = F.broadcast(cuts)       # a row for each leaf of the forest, at most

    def dealt(rows: DataFrame, own: str, other: str, asks: bool) -> DataFrame:
        return rows.join(small, "leaf").select(
            "leaf", F.pmod(F.xxhash64("number"), F.col(own)).alias(own),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other),
            "number", "vector", F.lit(asks).alias("asks"))

    return dealt(placed, "entry_blocks", "query_blocks", False).unionByName(
        dealt(probed, "query_blocks", "entry_blocks", True))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id",
            vector_col: str = "embedding", trees: int = TREES,
            probes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of rows whose id `every` divides, against all others.

    `probes` fixes the leaves that a query meets; None derives them from exact neighbours.
    """
    index = entries(vectors, id_col, vector_col, every, k)
    n = index.count()
    part = index.where(F.pmod(F.xxhash64("entry"), F.lit(1 << 20))
                       < int((1 << 20) * min(1.0, SAMPLE / max(n, 1)) + 1)).select("vector")
    points = [r["vector"] for r in part.limit(2 * SAMPLE).collect()]
    depth = max(0, math.ceil(math.log2(max(1, min(n / LEAF, len(points) / SAMPLE_LEAF)))))
    unit = _unit(np.array(points, np.float32)) if points else np.zeros((0, 1))
    grown = grow(unit, trees, depth)
    cut, leaves = settle(grown, index, n, k) if probes is None else (grown, probes)
    shared = index.sparkSession.sparkContext.broadcast(tuple(cut))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                entry = np.asarray(some.column(0))
                found = leaves_of(forest, _unit(_matrix(some.column(1))), entry)
                rows = np.repeat(np.arange(len(entry)), found.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(found.shape[1]), len(entry)) * (1 << 32)
                              + found.ravel()), pa.array(entry[rows]),
                     some.column(1).take(pa.array(rows))], names=["leaf", "number", "vector"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                query = _unit(_matrix(some.column(1))).astype(np.float32)
                leaf, rows = [], []
                for i, q in enumerate(query):
                    order = best_first(forest, forest.directions @ q - forest.thresholds)
                    met = np.fromiter(itertools.islice(order, leaves), np.int64)
                    tree, x = np.divmod(met, 1 << forest.depth)
                    leaf.append((tree << 32) + x)
                    rows += [i] * len(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(leaf), pa.int64()), some.column(0).take(pa.array(rows, pa.int64())),
                     some.column(1).take(pa.array(rows, pa.int64()))],
                    names=["leaf", "number", "vector"])

    columns = "leaf long, number long, vector array<float>"
    placed = index.select("entry", "vector").mapInArrow(place, columns)
    probed = index.where("asked").select("entry", "vector").mapInArrow(probe, columns)
    scored = (_blocks(placed, probed).groupBy("leaf", "entry_blocks", "query_blocks")
              .applyInArrow(_rank(k), "query long, entry long, score double")
              .groupBy("query", "entry").agg(F.max("score").alias("score")))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    best = written(
        scored.join(index.select("entry", "ids"), "entry")
        .select("query", "score", F.explode("ids").alias("vec_id"))
        .withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
        .drop("place"), "best")
    queries = vectors.select(
        F.col(id_col).cast("long").alias("query_id"),
        F.col(vector_col).cast("array<float>").alias("vector"),
    ).where(F.pmod("query_id", F.lit(every)) == 0).distinct()
    named = queries.join(index.where("asked").select(F.col("entry").alias("query"), "vector"),
                         "vector").select("query_id", "query")
    final = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (named.join(best, "query").where("vec_id != query_id")
            .groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
