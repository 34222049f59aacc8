"""Byte-level BPE as a monoid: halves are encoded and joined at their boundary.

Two encoded neighbours join by re-encoding a window of tokens around the boundary.
A sequence is the encoding of its bytes exactly if each token is the encoding of its own
bytes and each neighbouring pair that of its bytes; so once the pairs where the window
meets the rest hold, no token outside can change. Until then the window grows to twice
its size. Decoding concatenates token bytes up a binary tree.

Defined cases: null and empty texts have no ids and decode to nothing; repeated
rows are encoded each; an empty table gives an empty result; other columns are ignored.
Memory is bounded: at most CACHE encoded pieces are kept by a task.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from culturelens.llm.pieces import Cutter

CACHE = 600_000
SHORT = 12           # bytes of a window that is merged without a heap, or of a kept half
LEAF = 4096          # ids that decoding joins at once at the leaves of its tree


class Codec:
    """Encoder and decoder for the ranks of a vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.tokens_of = self.tokens.__getitem__
        self.pairs: dict[int, list[int] | None] = {}
        self.halves: dict[bytes, list[int]] = {}

    def merged(self, data: bytes) -> list[int]:
        """Merge the neighbours with the lowest rank, leftmost first, until none is left."""
        if data in self.ranks:
            return [self.ranks[data]]
        if len(data) <= SHORT:
            return self._merged_short(data)
        n, ranks = len(data), self.ranks
        end = list(range(1, n + 1))          # end[i]: where the part that starts at i ends
        start_before = list(range(-1, n))    # start of the part that ends where one starts
        heap = [(r, i) for i in range(n - 1)
                if (r := ranks.get(data[i:i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            rank, i = heapq.heappop(heap)
            if not alive[i] or end[i] >= n:
                continue
            stop = end[end[i]]
            if ranks.get(data[i:stop]) != rank:
                continue
            alive[end[i]] = False
            end[i] = stop
            if stop < n:
                start_before[stop] = i
                if (r := ranks.get(data[i:end[stop]])) is not None:
                    heapq.heappush(heap, (r, i))
            if i and (r := ranks.get(data[start_before[i]:stop])) is not None:
                heapq.heappush(heap, (r, start_before[i]))
        return [ranks[data[i:end[i]]] for i in range(n) if alive[i]]

    def _merged_short(self, data: bytes) -> list[int]:
        get, none = self.ranks.get, len(self.tokens)
        cuts = list(range(len(data) + 1))
        pairs = [get(data[i:i + 2], none) for i in range(len(data) - 1)]
        while pairs and (rank := min(pairs)) != none:
            i = pairs.index(rank)
            del cuts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(data[cuts[i]:cuts[i + 2]], none)
            if i:
                pairs[i - 1] = get(data[cuts[i - 1]:cuts[i + 1]], none)
        return [self.ranks[data[x:y]] for x, y in pairwise(cuts)]

    def pair(self, a: int, b: int) -> list[int] | None:
        """What two neighbouring tokens become; None if they stay as they are."""
        key = a << 32 | b
        if key in self.pairs:
            return self.pairs[key]
        if len(self.pairs) > CACHE:
            self.pairs.clear()
        found = self.merged(self.tokens[a] + self.tokens[b])
        self.pairs[key] = found = None if found == [a, b] else found
        return found

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of the bytes of `a` followed by those of `b`."""
        if not a or not b:
            return a + b
        window = self.pair(a[-1], b[0])
        if window is None:
            return a + b
        i = j = 1
        while True:
            left = i == len(a) or self.pair(a[len(a) - i - 1], window[0]) is None
            right = j == len(b) or self.pair(window[-1], b[j]) is None
            if left and right:
                return a[:len(a) - i] + window + b[j:]
            i, j = i if left else min(2 * i, len(a)), j if right else min(2 * j, len(b))
            window = self.merged(b"".join(map(self.tokens_of, a[len(a) - i:] + b[:j])))

    def encode(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern, up the tree of its halves."""
        rank = self.ranks.get(data)
        if rank is not None:
            return [rank]
        found = self.halves.get(data)
        if found is None:
            half = len(data) // 2
            found = self.join(self.encode(data[:half]), self.encode(data[half:]))
            if len(data) <= SHORT:
                if len(self.halves) > CACHE:
                    self.halves.clear()
                self.halves[data] = found
        return found

    def decode(self, ids: list[int]) -> bytes:
        parts = [b"".join(map(self.tokens_of, ids[i:i + LEAF])) for i in range(0, len(ids), LEAF)]
        while len(parts) > 1:
            parts = [b"".join(parts[i:i + 2]) for i in range(0, len(parts), 2)]
        return parts[0] if parts else b""


class TextEncoder:
    """Ids of whole texts as little-endian 32-bit numbers, with a bounded memory of pieces."""

    def __init__(self, path: str, pattern: str) -> None:
        self.codec, self.cut = Codec(path), Cutter(pattern)
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        found = self.pieces.get(text)
        if found is None:
            if len(self.pieces) > CACHE:
                self.pieces.clear()
            found = np.array(self.codec.encode(text.encode()), "<u4").tobytes()
            self.pieces[text] = found
        return found

    def __call__(self, text: str) -> bytes:
        out, known = [], self.chunks
        if len(known) > CACHE:
            known.clear()
        for chunk in self.cut.chunks(text):
            ids = known.get(chunk)
            if ids is None:
                ids = b"".join(map(self.piece, self.cut.pieces(chunk)))
                known[chunk] = ids
            out.append(ids)
        return b"".join(out)


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids as binary, little-endian unsigned 32-bit numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = TextEncoder(path, pattern)
        for batch in batches:
            for row in range(0, batch.num_rows, 1000):
                some = batch.slice(row, 1000)
                ids = [encode(t.as_py() or "") for t in some.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(run, "doc_id long, ids binary")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, data): the bytes that `ids` of `encode_texts` stand for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codec(path)
        for batch in batches:
            data = [own.decode(np.frombuffer(x.as_py() or b"", "<u4").tolist())
                    for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(data, pa.binary())], names=["doc_id", "ids", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, data binary")


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of `decode_ids` rows."""
    return decoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))
