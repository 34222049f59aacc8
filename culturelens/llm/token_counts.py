"""Token counts under a unigram model, with forward scores shared along a trie.

A text's pre-tokens are cut by the vocabulary's pattern; the count of a pre-token is
the number of tokens on its best path, the one with the greatest sum of scores and,
among equals, the fewest tokens. Distinct pre-tokens are inserted in a trie in sorted
order; the forward score of a trie node depends on its prefix alone and is computed
once, and terminal counts are kept. Scores are whole numbers, so sums are exact.

The public rank files hold no probabilities, so a token's score is the Zipf law of its
rank: -ln(rank + SHIFT) in millionths.

Defined cases: null and empty texts have no tokens; ties are broken as above;
repeated rows are counted each; an empty table gives an empty result; other columns
are ignored. Texts are counted whole, in the order of their rows, with bounded memory:
at most CACHE counts are kept.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from culturelens.llm.pieces import Cutter

SHIFT = 2.7
SCALE = 1_000_000
WHOLE = 1 << 32      # a path's value is its score in WHOLEs, less one for each token
CACHE = 250_000      # counts kept by a task
TEXTS = 256          # texts whose new pre-tokens form one trie


def unigram_scores(path: str) -> tuple[dict[bytes, int], int]:
    """Token scores of a rank file, and the length of its longest token."""
    scores = {}
    with open(path, "rb") as lines:
        for line in lines:
            token, rank = line.split()
            scores[base64.b64decode(token)] = -round(math.log(int(rank) + SHIFT) * SCALE)
    return scores, max(map(len, scores))


def all_endings(scores: dict[bytes, int]) -> dict[bytes, int | None]:
    """Every ending of a token, and what a path gains by it if it is a token itself."""
    found = {token[at:]: None for token in scores for at in range(1, len(token))}
    found.update((token, score * WHOLE - 1) for token, score in scores.items())
    return found


def trie_counts(words: Iterable[bytes], scores: dict[bytes, int], longest: int,
                endings: dict[bytes, int | None] | None = None) -> dict[bytes, int]:
    """Token count of each distinct word; sorted words walk the trie depth first.

    A token that ends at a node is looked for backwards, as far as bytes end some token.
    """
    endings = all_endings(scores) if endings is None else endings
    counts = {}
    best: list[int | None] = [0]     # the value at each node of the path
    gain_of = endings.get
    path = b""
    for word in sorted(set(words)):
        shared = 0
        for x, y in zip(path, word):
            if x != y:
                break
            shared += 1
        del best[shared + 1:]
        for end in range(shared + 1, len(word) + 1):
            top = None
            for start in range(end - 1, max(0, end - longest) - 1, -1):
                gain = gain_of(word[start:end], False)
                if gain is False:
                    break
                if gain is not None:
                    found = best[start] + gain
                    if top is None or found > top:
                        top = found
            best.append(top)
        path = word
        counts[word] = -best[-1] % WHOLE
    return counts


def count_tokens(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, n_tokens) of every row, in one pass without a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, longest = unigram_scores(path)
        endings = all_endings(scores)
        cut = Cutter(pattern)
        known: dict[str, tuple[int, int]] = {}      # chunk: its pre-tokens and tokens
        words: dict[str, int] = {}                  # pre-token: its tokens
        for batch in batches:
            pieces, tokens = [], []
            for at in range(0, batch.num_rows, TEXTS):
                chunks = [cut.chunks(t.as_py() or "") for t in batch.column(1).slice(at, TEXTS)]
                if len(known) > CACHE or len(words) > CACHE:
                    known, words = {}, {}
                new = {c: cut.pieces(c) for c in set().union(*chunks) - known.keys()}
                unseen = {p for found in new.values() for p in found} - words.keys()
                counts = trie_counts([p.encode() for p in unseen], scores, longest, endings)
                words.update((p, counts[p.encode()]) for p in unseen)
                known.update((c, (len(f), sum(map(words.__getitem__, f)))) for c, f in new.items())
                for some in chunks:
                    found = [known[c] for c in some]
                    pieces.append(sum(f[0] for f in found))
                    tokens.append(sum(f[1] for f in found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(pieces, pa.int64()), pa.array(tokens, pa.int64())],
                names=["doc_id", "n_pieces", "n_tokens"])

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(run, "doc_id long, n_pieces long, n_tokens long")
