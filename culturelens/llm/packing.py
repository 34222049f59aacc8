"""Vector bin packing of token pieces by the dot-product heuristic.

A sequence has limits on tokens, segments and loss-bearing tokens. A bin is filled by
taking, again and again, the piece that still fits and whose size vector has the
greatest dot product with what the bin has left; dimensions weigh by their total demand.
Pieces with equal sizes are interchangeable, so the choice is among distinct sizes.

Texts are tokenised and cut where their rows are read; only narrow piece rows are
shuffled. They are dealt at random to groups of about GROUP_TOKENS tokens and at most
about GROUP_ROWS rows, whatever their id, and each group is packed by one task.

Defined cases: null and empty texts have just the closing id; equal sizes are taken in
order of (id, start), ids null first; repeated rows are packed each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from culturelens.llm.common import written

CLOSING_ID = 2
GROUP_TOKENS = 1 << 22
GROUP_ROWS = 1 << 16
CACHE = 400_000
# White space always ends a match in these characters, none of which combine or change
# what precedes them; other texts are tokenised as a whole.
PLAIN = re.compile(r"[\t\n\x0b\x0c\r\x20-\x7e¡-ÿ]*")
# Fixed value: the pattern of the vocabulary file.
MATCH = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss long"


class Limits(NamedTuple):
    tokens: int = 4096
    segments: int = 1024
    loss: int = 4096


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b if b in plain else next(others)) for b in range(0x100)}


class WordTokenizer:
    """Ids of a tokenizers file; plain texts by the words that repeat in them.

    The file's normaliser lower-cases and its pattern ends a match at white space, so a
    plain text is cut at white space, a word by the pattern, and each match goes to the
    file's model alone. The library's own chain of steps encodes all other texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.letters = self.library.model, byte_letters()
        self.words: dict[str, bytes] = {}
        self.matches: dict[str, bytes] = {}

    def _match(self, text: str) -> bytes:
        ids = self.matches.get(text)
        if ids is None:
            if len(self.matches) > CACHE:
                self.matches.clear()
            shown = text if text.isascii() else text.encode().decode("latin-1").translate(
                self.letters)
            ids = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
            self.matches[text] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if "<|" in text or not PLAIN.fullmatch(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
            return np.array(ids, "<u4").tobytes()
        known, out = self.words, []
        if len(known) > CACHE:
            known.clear()
        for word in text.lower().split():
            ids = known.get(word)
            if ids is None:
                ids = known[word] = b"".join(map(self._match, MATCH.findall(word)))
            out.append(ids)
        return b"".join(out)


def token_pieces(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Pieces of at most `limit` ids of every row; a document's first id bears no loss."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = WordTokenizer(path)
        closing = np.array([CLOSING_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_of(text.as_py() or "") + closing
                n = len(ids) // 4
                for start in range(0, n, limit):
                    part = ids[4 * start:4 * (start + limit)]
                    length = len(part) // 4
                    rows.append((doc_id, start, length, zlib.crc32(part), n, length - (not start)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 6)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss"])

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(run, PIECES)


def fill(sizes: np.ndarray, limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """Bin and token offset of each piece; `sizes` has a row (tokens, segments, loss) each."""
    top = np.array(limits, float)
    if (sizes > top).any():
        raise ValueError("a piece is larger than a sequence")
    kinds, kind_of = np.unique(-sizes, axis=0, return_inverse=True)
    kinds = -kinds                                  # largest first
    waiting = np.argsort(kind_of.ravel(), kind="stable")
    counts = np.bincount(kind_of.ravel(), minlength=len(kinds))
    ends = np.cumsum(counts)
    scaled = kinds / top
    weighted = scaled * (scaled * counts[:, None]).sum(axis=0)
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    live = np.arange(len(kinds))
    k, room = 0, top.copy()
    left = len(sizes)
    while left:
        # kinds are in falling order of tokens: earlier ones do not fit
        at = live[np.searchsorted(-kinds[live, 0], -room[0]):]
        at = at[(kinds[at] <= room).all(axis=1)]
        if not len(at):
            k, room = k + 1, top.copy()
            continue
        best = at[np.argmax(weighted[at] @ (room / top))]
        item = waiting[ends[best] - counts[best]]
        bins[item], offsets[item] = k, top[0] - room[0]
        room -= kinds[best]
        counts[best] -= 1
        left -= 1
        if not counts[best]:
            live = live[live != best]
    return bins, offsets


def pack(pieces: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """`pieces` rows with sequence_id and offset."""
    rows = written(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    total, count = rows.agg(F.sum("length"), F.count("*")).first()
    groups = max(1, -(-(total or 0) // GROUP_TOKENS), -(-count // GROUP_ROWS))

    def place(group: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["doc_id", "start"], kind="stable", na_position="first",
                                  ignore_index=True)
        sizes = np.stack([items["length"], np.ones(len(items)), items["loss"]], axis=1)
        bins, offsets = fill(sizes, limits)
        return items.drop(columns="group").assign(
            sequence_id=(int(group[0]) << 32) + bins, offset=offsets)

    dealt = rows.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups))).drop("row")
    return dealt.groupBy("group").applyInPandas(
        place, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, limits: Limits = Limits(),
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's ids in pieces, placed in sequences."""
    return pack(token_pieces(docs, path, limits.tokens, id_col, text_col), limits)
