r"""Ranked lexical search by scanning the documents with an automaton of all item terms.

Terms are runs of characters other than ASCII ones that are neither letter nor digit;
only A-Z are lower-cased. A text becomes its terms with spaces for everything else, and
every item term enters an Aho-Corasick automaton with a space on both sides, so that one
walk over a text counts the occurrences of all item terms at once and never inside a
longer term. There is no index of the documents: a first scan adds up documents, terms
and document frequencies, a second one counts again, scores and keeps the best `top`
documents of each item per task. What is shuffled is the tasks' bests.

The automaton is sent to the tasks for at most BLOCK_BYTES of item terms at a time; more
items are dealt into blocks by the hash of their id, each with two scans of its own.

Defined cases: a null text has no terms and is not counted; a text without a term is not
counted either; rows with the same item_id are one item with the terms of all; an item
without terms has no rows; equal scores go by ascending id, a null id after all others;
a repeated document row is a document of its own; empty tables give an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from culturelens.llm.common import forget, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP = 10
BLOCK_BYTES = 16 << 20     # of item terms in one automaton
ADDED = 2_000_000          # scores added up at a time in a task
SALT = 64                  # groups in which the bests of tasks meet first

# Lower-cases A-Z and turns every byte outside terms into a space; UTF-8 bytes from 0x80 stay.
SPACED = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def spaced(text: str) -> bytes:
    """The terms of a text, a space before and after each."""
    return b" " + text.encode().translate(SPACED) + b" "


def automaton(terms: list[bytes]) -> ahocorasick.Automaton:
    """Finds term k wherever ` term ` occurs, as the value k."""
    found = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        found.add_word((b" " + term + b" ").decode("latin-1"), k)
    found.make_automaton()
    return found


def term_counts(machine: ahocorasick.Automaton, text: bytes) -> Counter:
    return Counter(map(itemgetter(1), machine.iter(text.decode("latin-1"))))


@dataclass(frozen=True)
class Items:
    """Item terms, and for each the items that hold it, as one run of `items`."""

    terms: list[bytes]
    starts: np.ndarray
    items: np.ndarray
    count: int


def _arranged(pairs: list[tuple[int, str]], count: int) -> Items:
    place = {t: k for k, t in enumerate(sorted({t for _, t in pairs}))}
    links = np.array(sorted((place[t], i) for i, t in pairs), np.int64).reshape(-1, 2)
    starts = np.searchsorted(links[:, 0], np.arange(len(place) + 1))
    return Items([t.encode() for t in place], starts, links[:, 1], count)


def _statistics(docs: DataFrame, sent) -> dict[int, int]:
    """Document frequency of each term, documents under -1 and terms under -2."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(sent.value.terms)
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                text = spaced(text.as_py())
                n = len(text.split())
                if n:
                    seen[-1] += 1
                    seen[-2] += n
                    seen.update(term_counts(machine, text).keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen.keys()), pa.int64()), pa.array(list(seen.values()), pa.int64())],
            names=["term", "n"])

    counted = docs.select("text").mapInArrow(run, "term long, n long")
    return {r.term: r.n for r in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}


class Bests:
    """The best `top` documents of each item among all that were offered."""

    def __init__(self, count: int, top: int) -> None:
        self.top = top
        self.item = np.empty(0, np.int64)
        self.doc = np.empty(0, np.int64)
        self.null = np.empty(0, bool)
        self.score = np.empty(0, np.int64)
        self.least = np.ones(count, np.int64)     # a score below it cannot enter

    def offer(self, docs: np.ndarray, nulls: np.ndarray, scores: np.ndarray) -> None:
        """Scores of some documents, one column per item."""
        row, item = np.nonzero(scores >= self.least)
        self.item = np.concatenate([self.item, item])
        self.doc = np.concatenate([self.doc, docs[row]])
        self.null = np.concatenate([self.null, nulls[row]])
        self.score = np.concatenate([self.score, scores[row, item]])
        if len(self.item) > 4 * self.top * len(self.least):
            self.prune()

    def prune(self) -> None:
        order = np.lexsort((self.doc, self.null, -self.score, self.item))
        item = self.item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        full = order[rank == self.top - 1]
        self.least[self.item[full]] = self.score[full]
        keep = order[rank < self.top]
        for name in ("item", "doc", "null", "score"):
            setattr(self, name, getattr(self, name)[keep])


def _added(found: list[tuple[int, Counter]], held: Items, weights: np.ndarray) -> np.ndarray:
    """Scores of some documents, given as (m, counts), one column per item."""
    sizes = np.array([len(c) for _, c in found])
    total = int(sizes.sum())
    term = np.fromiter((t for _, c in found for t in c), np.int64, total)
    tf = np.fromiter((n for _, c in found for n in c.values()), np.int64, total)
    m = np.repeat(np.array([m for m, _ in found], np.int64), sizes)
    part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
    many = held.starts[term + 1] - held.starts[term]
    first = np.cumsum(many) - many
    link = np.arange(int(many.sum())) - np.repeat(first - held.starts[term], many)
    row = np.repeat(np.repeat(np.arange(len(found)), sizes), many)
    cell = row * held.count + held.items[link]
    part = np.repeat(part, many)
    shape = len(found) * held.count
    # Sums of doubles are exact below 2^53: the two halves of the parts are added apart.
    high = np.bincount(cell, part >> 24, shape).astype(np.int64)
    low = np.bincount(cell, part & 0xFFFFFF, shape).astype(np.int64)
    return ((high << 24) + low).reshape(len(found), held.count)


def _task_bests(docs: DataFrame, sent, weights: np.ndarray, n_docs: int, n_terms: int,
                top: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        machine, bests = automaton(held.terms), Bests(held.count, top)
        ids: list[int | None] = []
        found: list[tuple[int, Counter]] = []
        pending = 0

        def flush() -> None:
            nulls = np.array([i is None for i in ids], bool)
            bests.offer(np.array([i or 0 for i in ids], np.int64), nulls,
                        _added(found, held, weights))
            ids.clear()
            found.clear()

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = spaced(text.as_py())
                counts = term_counts(machine, text)
                if not counts:
                    continue
                n = len(text.split())
                ids.append(doc)
                found.append((10 + (90 * n * n_docs) // n_terms, counts))
                pending += sum(int(held.starts[t + 1] - held.starts[t]) for t in counts)
                if pending >= ADDED or len(found) * held.count >= ADDED:
                    flush()
                    pending = 0
        if found:
            flush()
        bests.prune()
        yield pa.RecordBatch.from_arrays(
            [pa.array(bests.item), pa.array(bests.doc, mask=bests.null), pa.array(bests.score)],
            names=["item", "doc_id", "score"])

    return docs.mapInArrow(run, "item long, doc_id long, score long")


def _ranked(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(
        F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, term), each pair once."""
    lower = F.translate(F.col(text_col), UPPER, LOWER)
    return items.select(F.col(item_col).alias("item_id"), F.explode(
        F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term")).distinct()


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text", top: int = TOP,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the best `top` documents of each item."""
    spark = docs.sparkSession
    pairs = written(item_terms(items, item_col, item_text), "item-terms")
    size = pairs.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.col(text_col).cast("string").alias("text")).where("text is not null")
    parts = [_block(texts, rows, top, spark) for rows in (
        pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) for b in range(blocks))]
    forget(pairs)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _block(texts: DataFrame, pairs: DataFrame, top: int, spark) -> DataFrame:
    rows = pairs.collect()          # at most about BLOCK_BYTES, or one item
    id_type = pairs.schema["item_id"].dataType.simpleString()
    if not rows:
        return spark.createDataFrame(
            [], f"item_id {id_type}, rank int, doc_id long, score long")
    ids = list(dict.fromkeys(r.item_id for r in rows))
    number = {i: k for k, i in enumerate(ids)}
    held = _arranged([(number[r.item_id], r.term) for r in rows], len(ids))
    sent = spark.sparkContext.broadcast(held)
    seen = _statistics(texts, sent)
    n_docs, n_terms = seen.get(-1, 0), seen.get(-2, 0)
    weights = np.array([
        math.floor(1000 * math.log((2 * n_docs + 2) / (2 * seen.get(k, 0) + 1)))
        for k in range(len(held.terms))], np.int64)
    bests = _task_bests(texts, sent, weights, n_docs, n_terms, top)
    salted = _ranked(bests.withColumn("salt", F.spark_partition_id() % SALT),
                     ["item", "salt"], top)
    ranked = _ranked(salted.select("item", "doc_id", "score"), ["item"], top)
    names = spark.createDataFrame(list(enumerate(ids)), f"item long, item_id {id_type}")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
