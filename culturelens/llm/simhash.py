"""SimHash near-duplicates, compared in bit slices.

Fingerprints that differ in at most `radius` of 64 bits agree in two of any
radius + 2 parts, so equal pairs of parts bring every link into a shared bucket.
A bucket over BLOCK fingerprints is cut again by pairs of parts of its free bits;
at most eight free bits are left in the end, so no bucket is large and none is
capped. Inside buckets the fingerprints stand as vertical bit planes.

Defined cases: null and empty texts have fingerprint 0 and link like any other;
a null id takes no part in the smallest id of a component, and a component of
null ids only has a null one; repeated rows come back as often as they came in;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from culturelens.llm.common import join_side, written
from culturelens.llm.components import connected_components

SEED = 42            # of XXH64
BLOCK = 2048         # most fingerprints of a bucket that are compared at once
FREE_BITS = 8        # buckets are not cut below this many free bits
HASHES = 1 << 16     # shingles counted at once
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, width: int) -> int:
    """SimHash of a text's word shingles as a signed 64-bit number."""
    words = (text or "").encode().lower().split()   # both touch ASCII only
    if not words:
        return 0
    spans = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, spans, HASHES):
        some = min(HASHES, spans - at)
        runs = zip(*(words[at + k:at + k + some] for k in range(min(width, len(words)))))
        hashes = np.fromiter(
            (xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, runs)), "<u8", some)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > spans, bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, text_hash, fp) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), width) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps, pa.int64())],
                names=["doc_id", "text_hash", "fp"])

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
        F.col(text_col).cast("string").alias("text"),
    ).mapInArrow(run, "doc_id long, text_hash long, fp long")


def _finer(mask: int, radius: int) -> list[int]:
    """Masks that also hold two of radius + 2 parts of the free bits of `mask`."""
    free = [i for i in range(64) if not mask >> i & 1]
    parts = np.array_split(free, radius + 2)
    bits = [sum(1 << int(i) for i in part) for part in parts]
    return [mask | a | b for a, b in combinations(bits, 2)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _bit_planes(fps: np.ndarray) -> np.ndarray:
    """64 rows of bits, one column word for 64 fingerprints."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    padded = np.zeros((64, -(-len(fps) // 64) * 64), np.uint8)
    padded[:, :len(fps)] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def _beyond(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Where a bit-sliced counter is over `radius`."""
    more, same = np.zeros_like(counter[0]), np.full_like(counter[0], FULL)
    for k in reversed(range(len(counter))):
        if radius >> k & 1:
            same = same & counter[k]
        else:
            more |= same & counter[k]
            same = same & ~counter[k]
    return more


def close_pairs(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of fingerprints that differ in at most `radius` bits."""
    n, planes = len(fps), _bit_planes(fps)
    left, right = [], []
    for start in range(0, n, 64):
        queries = fps[start:start + 64]
        flips = np.where(queries[:, None] >> np.arange(64, dtype="<u8") & np.uint64(1), FULL,
                         np.uint64(0))
        columns = np.arange(start // 64, planes.shape[1])
        over = np.zeros((len(queries), len(columns)), "<u8")
        # in the first column only later fingerprints count: bits up to the own one are over
        own = np.arange(len(queries), dtype="<u8")
        over[:, 0] = FULL >> (np.uint64(63) - own)
        if n % 64:
            over[:, -1] |= FULL << np.uint64(n % 64)
        counter = [np.zeros_like(over) for _ in range(radius.bit_length())]
        for i in range(0, 64, 2):
            one = planes[i, columns] ^ flips[:, i:i + 1]
            two = planes[i + 1, columns] ^ flips[:, i + 1:i + 2]
            if not counter:                       # radius 0
                over |= one | two
            else:                                 # carry-save: three planes to sum and carry
                half = counter[0] ^ one
                carry = (counter[0] & one) | (half & two)
                counter[0] = half ^ two
                for k in range(1, len(counter)):
                    counter[k], carry = counter[k] ^ carry, counter[k] & carry
                over |= carry
            if i % 8 == 6:                        # abandon blocks that are all beyond
                dead = over | _beyond(counter, radius) if counter else over
                alive = (dead != FULL).any(axis=0)
                if not alive.all():
                    columns, over = columns[alive], over[:, alive]
                    counter = [c[:, alive] for c in counter]
                    if not len(columns):
                        break
        if len(columns):
            near = ~(over | _beyond(counter, radius)) if counter else ~over
            bits = np.unpackbits(np.ascontiguousarray(near).view(np.uint8), axis=1,
                                 bitorder="little")
            q, at = np.nonzero(bits)
            left.append(start + q)
            right.append(columns[at // 64] * 64 + at % 64)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges that join what close pairs of one block join."""
    i, j = close_pairs(fps, radius)
    label = np.arange(len(fps))
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(label, before):
            break
    moved = label != np.arange(len(fps))
    return fps[label[moved]], fps[moved]


def _compare(radius: int):
    """Compares buckets that follow each other, several small ones as one block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        size, last = 0, None

        def block() -> pa.RecordBatch:
            a, b = _forest(np.unique(np.concatenate(waiting)).astype("<u8"), radius)
            return pa.RecordBatch.from_arrays(
                [pa.array(a.view("<i8")), pa.array(b.view("<i8"))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            mask, key, fp = (np.asarray(c) for c in batch.columns)
            starts = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            for part in np.split(np.arange(len(fp)), starts):
                bucket = (mask[part[0]], key[part[0]])
                if bucket != last and size >= 512:
                    yield block()
                    waiting, size = [], 0
                waiting.append(fp[part].astype("<i8").view("<u8"))
                size, last = size + len(part), bucket
        if waiting:
            yield block()

    return run


def links(fps: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """(a, b): edges whose components are those of all links between distinct `fp`."""
    below, level = {0: _finer(0, radius)}, [0]
    rows = fps.select("fp", F.lit(0).cast("long").alias("mask"))
    found = None
    while True:
        finer = F.create_map(*[
            x for m in level for x in (
                F.lit(_signed(m)), F.array(*[F.lit(_signed(k)).cast("long") for k in below[m]]))])
        keyed = (rows.select("fp", F.explode(finer[F.col("mask")]).alias("mask"))
                 .withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))).distinct())
        sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
        table = written(keyed.join(sizes, ["mask", "key"]), "buckets")
        level = sorted({k for m in level for k in below[m]})
        below = {m: _finer(m, radius) for m in level}
        free = 64 - min(bin(m).count("1") for m in level)
        last = free <= max(FREE_BITS, radius + 2)
        ready = table if last else table.where(F.col("n") <= block)
        ready = ready.select("mask", "key", "fp")
        found = ready if found is None else found.unionByName(ready)
        rows = table.where(F.col("n") > block).select("fp", "mask")
        if last or rows.isEmpty():
            break
    return (found.repartition("mask", "key").sortWithinPartitions("mask", "key")
            .mapInArrow(_compare(radius), "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    width: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, text_hash, fp, component, component_id) of every row.

    Two rows link if their fingerprints differ in at most `radius` bits. `component`
    is a fingerprint that names the component, `component_id` its smallest id.
    """
    rows = written(with_fingerprints(docs, id_col, text_col, width), "fingerprints")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = connected_components(links(fps, radius), "a", "b")
    named = written(
        fps.join(nodes.withColumnRenamed("node", "fp"), "fp", "left")
        .withColumn("component", F.coalesce("component", "fp")), "members")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    members = written(named.join(least, "component").drop("least"), "members")
    return rows.join(join_side(members, 48), "fp").select(
        "doc_id", "text_hash", "fp", "component", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             width: int = 3, radius: int = 2) -> DataFrame:
    """`docs` with one document of each component: its smallest (id, text hash)."""
    groups = near_duplicates(docs, id_col, text_col, width, radius)
    rows = groups.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    keep = written(
        rows.groupBy("component")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "n"))
             .alias("k")).select("k.doc_id", "k.text_hash", "k.n"), "kept")
    found = docs.select(
        F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text_col).alias("text_hash"))
    same = (F.col("d.doc_id").eqNullSafe(F.col("k.doc_id"))
            & (F.col("d.text_hash") == F.col("k.text_hash")))
    kept = found.alias("d").join(join_side(keep, 40).alias("k"), same).select("d.*", "k.n")
    again = kept.where("n > 1").dropDuplicates(["doc_id", "text_hash"])
    return kept.where("n = 1").unionByName(again).select("row.*")
