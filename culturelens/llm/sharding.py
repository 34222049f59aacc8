"""K-d tree sharding: weighted medians along the widest metadata dimension.

A node that holds k shards is cut where its bytes divide as floor(k/2) to ceil(k/2),
along the dimension with the widest spread. Rows are ordered by that dimension, then
by text hash, so equal texts stay together; the cut is found by counting bytes in
BINS ranges of the ordering key and narrowing to the range that holds it, for all
nodes of a level in one job. Where one key alone is heavier than `slack`, its rows are
divided by row number, so a group of copies of any size spreads over shards. Only the
counts, at most BINS per node, come to the driver. The tree is an expression.

Defined cases: a null text counts no bytes; null metadata sorts first; ties and
repeated rows are ordered by row number; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from culturelens.llm.common import join_side, written

OVERHEAD = 16        # bytes that a row counts besides its text
BINS = 4096
KEY_BITS = 62        # of the ordering key: dimension first, then text hash
DIMENSION_BITS = 30
VALUE_BYTES = 200    # assumed of a metadata value, where its table may be broadcast
SLOT_ROWS = 50_000   # rows of a shard that are numbered together


@dataclass
class Node:
    """Shards `first` to `first + count - 1`, and once cut the order and place of the cut."""

    first: int
    count: int
    dimension: int = 0
    key: int = 0          # rows with a smaller key go left
    row: int = 0          # and of this key those with a smaller row number
    left: Node | None = None
    right: Node | None = None


def value_ranks(docs: DataFrame, name: str) -> DataFrame:
    """(value, unit): the middle rank of each text value among all rows, as a share of them.

    So a dimension is as wide as the rows that its values tell apart. Values are counted by range
    of their order: a range is summed by itself, then starts at the sum of those before it.
    """
    counts = docs.groupBy(F.col(f"`{name}`").cast("string").alias("value")).agg(
        F.count("*").alias("n")).orderBy(F.col("value").asc_nulls_first())
    ranged = written(counts.withColumn("range", F.spark_partition_id()), "values")
    sums = ranged.groupBy("range").agg(F.sum("n").alias("rows"))   # a row for each range
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"),
                         F.sum("rows").over(Window.partitionBy()).alias("total"))
    within = (Window.partitionBy("range").orderBy(F.col("value").asc_nulls_first())
              .rowsBetween(Window.unboundedPreceding, -1))
    place = F.col("start") + F.coalesce(F.sum("n").over(within), F.lit(0)) + F.col("n") / 2
    return written(ranged.join(F.broadcast(starts), "range").select(
        "value", (place / F.col("total")).alias("unit")), "ranks")


def metadata(docs: DataFrame, id_col: str, text_col: str, dimensions: dict[str, str]) -> DataFrame:
    """(doc_id, size, text_crc32, row, k0...): a narrow written table with ordering keys.

    `dimensions` names columns and their kind: `size` (log of the bytes) or `value` (rank).
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + OVERHEAD
    tie = F.shiftrightunsigned(F.xxhash64(text_col), 64 - (KEY_BITS - DIMENSION_BITS))
    top = (1 << DIMENSION_BITS) - 1
    values = [name for name, kind in dimensions.items() if kind != "size"]
    # Texts end here: what follows may shuffle.
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), tie.alias("tie"),
        F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("text_crc32"),
        *[F.col(f"`{name}`").cast("string").alias(f"value_{i}") for i, name in enumerate(values)])
    units = {name: F.col(f"unit_{i}") for i, name in enumerate(values)}
    for i, name in enumerate(values):
        ranks = value_ranks(docs, name).toDF("ranked", f"unit_{i}")
        same = F.col(f"value_{i}").eqNullSafe(F.col("ranked"))
        rows = rows.join(join_side(ranks, VALUE_BYTES), same).drop("ranked")
    places = [units.get(name, F.log2("size") / 64.0) for name in dimensions]
    return written(rows.select(
        "doc_id", "size", "text_crc32", F.monotonically_increasing_id().alias("row"),
        *[F.shiftleft(F.floor(unit * top).cast("long"), KEY_BITS - DIMENSION_BITS)
          .bitwiseOR(F.col("tie")).alias(f"k{k}") for k, unit in enumerate(places)]), "metadata")


def _shard(node: Node) -> Column:
    if node.left is None:
        return F.lit(node.first)
    key = F.col(f"k{node.dimension}")
    goes_left = (key < node.key) | ((key == node.key) & (F.col("row") < node.row))
    return F.when(goes_left, _shard(node.left)).otherwise(_shard(node.right))


PARTS = "node int, whole_key boolean, dimension int, key long, low long, high long, step long"


def _counted(rows: DataFrame, open_cuts: list[list]) -> dict[int, list]:
    """Bytes, least and greatest place of each range of the open cuts, by node."""
    parts = rows.sparkSession.createDataFrame(
        [(n.first, kind == "key", n.dimension, n.key, lo, hi, max(1, -(-(hi - lo) // BINS)))
         for n, kind, lo, hi, _, _ in open_cuts], PARTS)
    keys = F.array(*[c for c in rows.columns if c[0] == "k"])
    chosen = rows.select("node", "size", "row", keys.alias("keys")).join(
        F.broadcast(parts), "node").select(     # a row for each open node, at most `shards`
        "node", "size", "low", "high", "step", "whole_key", "key", "row",
        F.get("keys", F.col("dimension")).alias("own"))
    placed = chosen.where(F.col("whole_key") | (F.col("own") == F.col("key"))).withColumn(
        "place", F.when(F.col("whole_key"), F.col("own")).otherwise(F.col("row")))
    found = (placed.where("place >= low and place < high")
             .groupBy("node", F.floor((F.col("place") - F.col("low")) / F.col("step")).alias("bin"))
             .agg(F.sum("size").alias("bytes"), F.min("place").alias("least"),
                  F.max("place").alias("most")).collect())
    out: dict[int, list] = {}
    for r in sorted(found, key=lambda r: r["bin"]):
        out.setdefault(r["node"], []).append(r)
    return out


def _cut(rows: DataFrame, nodes: list[Node], slack: float) -> None:
    """Find the cuts of all `nodes`; `rows` has their number in `node`."""
    n_keys = sum(c[0] == "k" for c in rows.columns)
    spread = {r["node"]: r for r in rows.groupBy("node").agg(
        F.sum("size").alias("bytes"), F.max("row").alias("rows"),
        *[f(f"k{k}").alias(f"{n}{k}") for k in range(n_keys)
          for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
    todo = []
    for node in nodes:
        stats = spread.get(node.first)
        if stats is None:
            continue
        node.dimension = max(range(n_keys), key=lambda k: stats[f"hi{k}"] - stats[f"lo{k}"])
        # [low, high): where the cut is; `want`: bytes that still go left of it
        todo.append([node, "key", stats[f"lo{node.dimension}"], stats[f"hi{node.dimension}"] + 1,
                     stats["bytes"] * (node.count // 2) / node.count, stats["rows"] + 1])
    while todo:
        counts = _counted(rows, todo)
        left = []
        for t in todo:
            node, kind, lo, hi, want, n_rows = t
            for r in counts.get(node.first, []):
                if r["bytes"] <= want:
                    want -= r["bytes"]
                    lo = r["most"] + 1
                    continue
                lo, hi = r["least"], r["most"] + 1
                if hi - lo == 1 or r["bytes"] <= slack:
                    break
                left.append([node, kind, lo, hi, want, n_rows])
                break
            else:
                hi, want, r = lo, 0, None
            if left and left[-1][0] is node:
                continue
            heavy = 0 if r is None else r["bytes"]
            if kind == "key":
                node.key = lo
                if heavy > slack and hi - lo == 1:      # one key: divide its rows
                    left.append([node, "row", 0, n_rows, want, n_rows])
                elif want > heavy / 2:
                    node.key = hi
            else:
                node.row = hi if want > heavy / 2 else lo
        todo = left


def kd_tree(rows: DataFrame, shards: int, slack: float) -> Node:
    """A tree with `shards` leaves over a `metadata` table; `slack` is in bytes."""
    root = Node(0, shards)
    level = [root] if shards > 1 else []
    while level:
        _cut(rows.withColumn("node", _shard(root)), level, slack)
        below = []
        for node in level:
            half = node.count // 2
            node.left = Node(node.first, half)
            node.right = Node(node.first + half, node.count - half)
            below += [c for c in (node.left, node.right) if c.count > 1]
        level = below
    return root


def with_slots(rows: DataFrame, per_block: int = SLOT_ROWS) -> DataFrame:
    """Number the rows of each `shard` without a gap, in blocks of about `per_block` rows."""
    sizes = rows.groupBy("shard").agg(F.count("*").alias("n_shard"))
    blocked = rows.join(F.broadcast(sizes), "shard").withColumn(
        "block", F.pmod(F.xxhash64("row"), F.ceil(F.col("n_shard") / per_block))).drop("n_shard")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = written(blocked.groupBy("shard", "block").agg(F.count("*").alias("n")).select(
        "shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "starts")
    within = Window.partitionBy("shard", "block").orderBy("row")
    return (blocked.withColumn("place", F.row_number().over(within))
            .join(join_side(starts, 32), ["shard", "block"])
            .withColumn("slot", F.col("start") + F.col("place") - 1)
            .drop("block", "start", "place"))


def shard_documents(docs: DataFrame, shards: int, dimensions: dict[str, str],
                    id_col: str = "doc_id", text_col: str = "text",
                    tolerance: float = 0.001) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; shards have near equal bytes.

    A cut may miss its place by `tolerance` of a shard's bytes, or by one row.
    """
    rows = metadata(docs, id_col, text_col, dimensions)
    total = rows.agg(F.sum("size")).first()[0] or 0
    tree = kd_tree(rows, shards, tolerance * total / shards)
    placed = rows.select("doc_id", "size", "text_crc32", "row", _shard(tree).alias("shard"))
    return with_slots(placed).drop("row")
