r"""Periodic runs of words, found by internal pattern matching, and texts without their repeats.

A run is a stretch of words with smallest period q, at least LEAST words and POWER periods
long, that no neighbouring word extends. Let 2^k <= q < 2^(k+1). The first block of 2^k
words inside a run that starts at a multiple of 2^k occurs again q words later, so every
aligned block asks where it occurs in the neighbouring window of 2^k places from 2^k on.
Blocks are ranked by prefix doubling; those that begin like one are an interval of the
suffix array, and a wavelet tree over that array answers range successor: the first, second
and last place in the window. Occurrences of a block in such a window form an arithmetic
progression. One or two are candidates themselves; of three or more, whose difference is
then the block's own period, only the distances between the ends of the two stretches of
that period can be a period of more. Candidates grow to both sides as far as words q apart
agree, by the stored ranks, and of equal stretches the smallest period is the true one.

Texts are worked on in batches of about WORDS words, with symbols of their own for each
text, so that neither copies nor neighbours in a batch meet. Where `repeated` is given,
words from some place on are first replaced by earlier ones (`periodic_words`).

Defined cases: a null or empty text has no words and no run; of equal exponents the run
that starts first, then the smaller period; repeated rows are worked on alike; a null id
counts as one that changes nothing; an empty table gives an empty result; other columns
are ignored. A text is worked on whole, however long, with memory in proportion to its words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 6           # words of a run, at least
POWER = 4           # periods of a run, at least
WORDS = 1 << 17     # words of a batch of texts; a longer text is a batch of its own

SCHEMA = ("doc_id long, n_runs long, start long, length long, period long,"
          " exponent_milli long, runs_sha256 string, collapsed_sha256 string")


class Run(NamedTuple):
    start: int
    length: int
    period: int


def ranked_blocks(symbols: np.ndarray, longest: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of the blocks of 2^k words from each place, for each k, and the places in order.

    A rank is the number of places that begin with a smaller block, so it is also the start
    of the block's interval in the order. Doubling ends when all blocks differ or
    at `longest` words; only places whose block is not yet unique are sorted again.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    head = np.empty(n, bool)
    head[:1] = True
    np.not_equal(symbols[order][1:], symbols[order][:-1], out=head[1:])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    levels, width = [rank.astype(np.int32)], 1
    while width < longest:
        open_ = ~(head & np.append(head[1:], True))
        at = np.flatnonzero(open_)
        if not len(at):
            break
        place = order[at]
        after = place + width
        follow = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        first = rank[place]
        key = first * (n + 1) + follow
        sort = np.argsort(key, kind="stable")
        order[at] = place[sort]
        key, first = key[sort], first[sort]
        start = np.empty(len(at), bool)
        start[0] = True
        np.not_equal(key[1:], key[:-1], out=start[1:])
        head[at] = start
        rank = rank.copy()
        rank[order[at]] = np.maximum.accumulate(np.where(start, at, 0))
        levels.append(rank.astype(np.int32))
        width *= 2
    return levels, order


class WaveletTree:
    """Counts and quantiles of any interval of a permutation, level by level from the top bit."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(len(values)).bit_length())
        self.zeros: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one, dtype=np.int32)]))
            values = np.concatenate([values[~one], values[one]])

    def below(self, low: np.ndarray, high: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many values in [low, high) are smaller than `limit`."""
        low, high, count = low.copy(), high.copy(), np.zeros(len(low), np.int64)
        for level, zeros in enumerate(self.zeros):
            one = (limit >> (self.bits - 1 - level) & 1).astype(bool)
            zl, zh, all_ = zeros[low], zeros[high], zeros[-1]
            count += np.where(one, zh - zl, 0)
            low = np.where(one, all_ + low - zl, zl)
            high = np.where(one, all_ + high - zh, zh)
        return count

    def quantile(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value (from 0) in [low, high)."""
        low, high, k = low.copy(), high.copy(), k.copy()
        value = np.zeros(len(low), np.int64)
        for zeros in self.zeros:
            zl, zh, all_ = zeros[low], zeros[high], zeros[-1]
            one = k >= zh - zl
            k -= np.where(one, zh - zl, 0)
            value = value * 2 + one
            low = np.where(one, all_ + low - zl, zl)
            high = np.where(one, all_ + high - zh, zh)
        return value


def _agreeing(levels: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> tuple:
    """How many words agree from two places on, and before them (low < high)."""
    n = len(levels[0])
    right, left = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
    top = len(levels) - 1
    for k in range(top, -1, -1):
        rank, width = levels[k], 1 << k
        while True:
            a, b = low + right, high + right
            same = (b + width <= n) & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
            right += np.where(same, width, 0)
            if k < top or not same.any():
                break
        while True:
            a, b = low - left - width, high - left - width
            same = (a >= 0) & (rank[np.maximum(a, 0)] == rank[np.maximum(b, 0)])
            left += np.where(same, width, 0)
            if k < top or not same.any():
                break
    return right, left


def _candidates(k: int, levels, order, tree: WaveletTree) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) to verify for periods from 2^k to 2^(k+1) - 1."""
    n, width = len(order), 1 << k
    rank = levels[k]
    size = np.bincount(rank, minlength=n)
    place = np.arange(0, n, width)
    place = place[(size[rank[place]] > 1) & (place + width < n)]
    if k == 0:      # the window holds one place, which is compared directly
        place = place[rank[place] == rank[place + 1]]
        return place, np.ones(len(place), np.int64)
    low = rank[place].astype(np.int64)
    high = low + size[low]
    before = tree.below(low, high, place + width)
    count = tree.below(low, high, np.minimum(place + 2 * width, n)) - before
    some = count > 0
    place, low, high, before, count = (x[some] for x in (place, low, high, before, count))
    if not len(place):
        return place, place
    first = tree.quantile(low, high, before)
    last = tree.quantile(low, high, before + count - 1)
    out = [(place, first - place), (place, last - place)]
    many = count > 2
    if many.any():
        place, first = place[many], first[many]
        step = tree.quantile(low[many], high[many], before[many] + 1) - first
        own, other = _agreeing(levels, place, place + step), _agreeing(levels, first, first + step)
        shift = first - place
        out += [(place, shift + other[0] - own[0]), (place, shift + own[1] - other[1])]
    place, period = (np.concatenate(x) for x in zip(*out))
    fits = (period >= width) & (period < 2 * width) & (place + period < n)
    return place[fits], period[fits]


def batch_runs(symbols: np.ndarray, longest: int) -> np.ndarray:
    """(start, length, period) of all runs, ordered; `longest` bounds the words of one text."""
    if len(symbols) < LEAST:
        return np.empty((0, 3), np.int64)
    levels, order = ranked_blocks(symbols, max(1, longest // POWER))
    tree = WaveletTree(order) if len(levels) > 1 else None
    found = []
    for k in range(len(levels)):
        place, period = _candidates(k, levels, order, tree)
        right, left = _agreeing(levels, place, place + period)
        length = left + right + period
        true = length >= np.maximum(LEAST, POWER * period)
        found.append(np.column_stack([place - left, length, period])[true])
    # Of equal stretches the first, with the smallest period, is the run.
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def periodic_words(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a periodic tail where the id's CRC-32 says so."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    whole, rest = divmod(n - a, p)
    return words[:a] + words[a:a + p] * whole + words[a:a + rest]


def described(words: list[bytes], runs: list[Run]) -> tuple:
    """The result columns of one text, after its id."""
    lines = "".join(f"{r.start},{r.length},{r.period}\n" for r in runs)
    gone = set()
    best = None
    for r in runs:
        gone.update(range(r.start + r.period, r.start + r.length))
        if best is None or r.length * best.period > best.length * r.period:
            best = r
    kept = [w for i, w in enumerate(words) if i not in gone] if gone else words
    top = (*best, 1000 * best.length // best.period) if best else (None,) * 4
    return (len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(b" ".join(kept)).hexdigest())


def texts_runs(texts: list[list[bytes]]) -> list[list[Run]]:
    """The runs of each text, found together."""
    symbols, starts, base, total = [], [], 0, 0
    for words in texts:
        known: dict[bytes, int] = {}
        symbols.append(np.fromiter((known.setdefault(w, len(known)) for w in words),
                                   np.int64, len(words)) + base)
        starts.append(total)
        base, total = base + len(known), total + len(words)
    rows = batch_runs(np.concatenate(symbols), max(map(len, texts))) if texts else []
    found: list[list[Run]] = [[] for _ in texts]
    if len(rows):
        # Texts without words share their start with the next; the last of equals holds words.
        owner = np.searchsorted(np.array(starts), rows[:, 0], "right") - 1
        for k, (start, length, period) in zip(owner.tolist(), rows.tolist()):
            found[k].append(Run(start - starts[k], length, period))
    return found


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              repeated: bool = False, batch_words: int = WORDS) -> DataFrame:
    """The runs of every text: their number, the one with the greatest exponent, and digests.

    One scan without a shuffle; a text is never split.
    """
    def rows(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        out = [(i, *described(w, r)) for i, w, r in zip(ids, texts, texts_runs(texts))]
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[list[bytes]] = []
        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or "").encode().split()
                if repeated:
                    words = periodic_words(words, doc)
                if held and held + len(words) > batch_words:
                    yield rows(ids, texts)
                    ids, texts, held = [], [], 0
                ids.append(doc)
                texts.append(words)
                held += len(words)
            # bounds the rows that wait, also where texts have no words
            if len(ids) > 20_000:
                yield rows(ids, texts)
                ids, texts, held = [], [], 0
        if ids:
            yield rows(ids, texts)

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(run, SCHEMA)
