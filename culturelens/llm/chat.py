"""Chat formatting: snapshots that a longer logged conversation contains collapse.

A conversation is its (role, text) turns in order of (turn, role, text). Each turn
position is hashed with its role and text; the running XOR of these hashes, in two
independent 64-bit halves, names every turn prefix. A conversation goes if it is a
proper prefix of another, or equal to one with a smaller id; anti-joins keep the
maximal ones, which are rendered as ChatML. Turns are read in blocks of BLOCK turn
numbers, and a block of more than ROWS turns in ranges of (turn, role, text) of at most
ROWS, so one conversation spreads over tasks; rendering gives one row per block.

Defined cases: a null id names one conversation like any other; a null turn
sorts first, a null role renders as `unknown` and a null text as nothing; equal
rows of a conversation are one turn; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from culturelens.llm.common import join_side, written

BLOCK = 256
ROWS = 4096         # turns of a block, at most
SLICES = 2000       # tasks that order the turns of oversized blocks, at most
# The markers of ChatML.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
NO_ROLE = "unknown"


def _same(left: str, right: str, *names: str) -> Column:
    test = F.lit(True)
    for name in names:
        test = test & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return test


def cut_blocks(rows: DataFrame, often: DataFrame) -> DataFrame:
    """`rows` with the cut of their block: 0, or a number in order within an oversized one.

    `often` names the blocks that may be oversized, as repeated rows count in it.
    """
    whole = rows.withColumn("cut", F.lit(0).cast("long"))
    often = written(often, "often")
    if often.isEmpty():
        return whole
    sizes = rows.alias("r").join(
        join_side(often, 32).alias("o"), _same("r", "o", "conv_id", "block"), "left_semi"
    ).groupBy("conv_id", "block").agg(F.count("*").alias("size")).where(F.col("size") > ROWS)
    large = written(sizes, "large")
    total = large.agg(F.sum("size")).first()[0]
    if total is None:
        return whole
    within = _same("r", "o", "conv_id", "block")
    side = join_side(large, 32).alias("o")
    order = ["conv_id", "block", "turn", "role", "text"]
    sliced = written(
        rows.alias("r").join(side, within, "left_semi")
        .repartitionByRange(min(SLICES, -(-total // ROWS)), *order)
        .withColumn("slice", F.spark_partition_id().cast("long")), "slices")
    place = F.row_number().over(
        Window.partitionBy("conv_id", "block", "slice").orderBy("turn", "role", "text"))
    cuts = sliced.withColumn("cut", F.col("slice") * (1 << 32) + F.floor((place - 1) / ROWS))
    return whole.alias("r").join(side, within, "left_anti").unionByName(cuts.drop("slice"))


def turn_prefixes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn",
                  role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, block, n_blocks, pos, role, text, h1, h2): every turn with its prefix hashes."""
    named = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(NO_ROLE)).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.floor(F.col(turn) / BLOCK).cast("long").alias("block"))
    often = named.groupBy("conv_id", "block").agg(F.count("*").alias("size")).where(
        F.col("size") > ROWS)
    rows = cut_blocks(named.distinct(), often)
    within = Window.partitionBy("conv_id", "block", "cut").orderBy("turn", "role", "text")
    ranked = rows.withColumn("place", F.row_number().over(within).cast("long"))
    # blocks are few per conversation; their sizes place each block's turns
    whole = Window.partitionBy("conv_id")
    ordered = whole.orderBy(F.col("block").asc_nulls_first(), "cut")
    starts = rows.groupBy("conv_id", "block", "cut").agg(F.count("*").alias("size")).withColumns({
        "start": F.coalesce(F.sum("size").over(
            ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "number": F.row_number().over(ordered) - 1, "n_blocks": F.count("*").over(whole)})
    placed = (ranked.alias("r").join(starts.alias("s"), _same("r", "s", "conv_id", "block", "cut"))
              .select("r.conv_id", F.col("s.number").alias("block"), "s.n_blocks", "r.role",
                      "r.text", (F.col("s.start") + F.col("r.place") - 1).alias("pos"))
              .withColumns({"e1": F.xxhash64("pos", "role", "text"),
                            "e2": F.xxhash64("text", "role", "pos")}))
    placed = written(placed, "turns")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("conv_id", "block").agg(
        F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2"))
    carried = sums.select(
        "conv_id", "block", *[F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(c)
                              for x, c in (("x1", "c1"), ("x2", "c2"))])
    running = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, 0)
    rolled = placed.select("conv_id", "block", "n_blocks", "pos", "role", "text",
                           F.bit_xor("e1").over(running).alias("r1"),
                           F.bit_xor("e2").over(running).alias("r2"))
    return rolled.alias("r").join(carried.alias("c"), _same("r", "c", "conv_id", "block")).select(
        "r.conv_id", "r.block", "r.n_blocks", "r.pos", "r.role", "r.text",
        F.col("r.r1").bitwiseXOR(F.col("c.c1")).alias("h1"),
        F.col("r.r2").bitwiseXOR(F.col("c.c2")).alias("h2"))


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies) of conversations that no other one contains."""
    lasts = prefixes.groupBy("conv_id").agg(F.max(F.struct("pos", "h1", "h2")).alias("end"))
    whole = lasts.groupBy("end").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    prefix = prefixes.select("conv_id", "pos", "h1", "h2")
    proper = (prefix.alias("p").join(lasts.alias("l"), _same("p", "l", "conv_id"))
              .where(F.col("p.pos") < F.col("l.end.pos"))
              .select("p.pos", "p.h1", "p.h2").distinct())
    kept = whole.select("end.pos", "end.h1", "end.h2", "conv_id", "n_copies").join(
        proper, ["pos", "h1", "h2"], "left_anti")
    return kept.select("conv_id", (F.col("pos") + 1).alias("n_turns"), "n_copies")


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, part, n_parts, n_turns, n_copies, text): maximal conversations, rendered.

    A row renders one block; only conversations over BLOCK turns or ROWS rows have several.
    """
    prefixes = written(turn_prefixes(turns, conv, turn, role, text), "prefixes")
    kept = written(maximal(prefixes), "maximal")
    rendered = F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE))
    chosen = prefixes.alias("p").join(kept.alias("k"), _same("p", "k", "conv_id")).select(
        "p.conv_id", "p.block", "p.n_blocks", "p.pos", "k.n_turns", "k.n_copies",
        rendered.alias("piece"))
    blocks = chosen.groupBy("conv_id", "block", "n_blocks", "n_turns", "n_copies").agg(
        F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("pieces"))
    return blocks.select(
        "conv_id", F.col("block").alias("part"), F.col("n_blocks").cast("int").alias("n_parts"),
        "n_turns", "n_copies", F.array_join(F.col("pieces.piece"), "").alias("text"))
