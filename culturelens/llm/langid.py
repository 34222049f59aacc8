r"""Language identification by words first, then shorter and shorter character n-grams.

A word (a lower-case run of \p{L}) that the model knows scores by its log frequency in
each language. An unseen word scores by the mean over its known n-grams of the longest
order of which it has any, from ORDERS down; with none it says nothing. A
text's language has the greatest sum over its words.

The model is fitted on a bounded sample: of each language the SAMPLE documents with the
smallest hash of their id. It keeps the WORDS most frequent words and the GRAMS most
frequent n-grams of each order per language. Words are counted in Spark.

Defined cases: a null text, or one without a letter, gives `und` and score 0; rows with a
null language are not learnt from; ties go to the alphabetically first language;
repeated rows are predicted each; without labelled rows every text gives `und`; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from culturelens.llm.common import join_side, written

SAMPLE = 2000
WORDS = 20_000
GRAMS = 10_000
ORDERS = (4, 3, 2, 1)
UNSEEN = 0.5          # count that a language is given for what it lacks
CACHE = 300_000      # scored words that a task keeps
TEXTS = 512          # texts whose new words are scored together
UNKNOWN = "und"
LETTERS = regex.compile(r"\p{L}+")


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int] = field(default_factory=dict)
    grams: dict[str, int] = field(default_factory=dict)      # of `^word$`, all orders
    word_scores: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    gram_scores: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def scores(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word."""
        tables = np.concatenate([self.word_scores, self.gram_scores,
                                 np.zeros((1, len(self.languages)))])
        first, nothing = len(self.word_scores), len(tables) - 1
        rows, sizes = [], []
        for word in words:
            row = self.words.get(word)
            found = [nothing] if row is None else [row]
            if row is None:
                marked = f"^{word}$"
                for n in ORDERS:
                    known = [first + r for i in range(len(marked) - n + 1)
                             if (r := self.grams.get(marked[i:i + n])) is not None]
                    if known:
                        found = known
                        break
            rows += found
            sizes.append(len(found))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)
        return np.add.reduceat(tables[rows], starts, axis=0) / np.array(sizes)[:, None]


def _table(counts: list[tuple[str, str, int]], totals: dict[str, int],
           languages: list[str]) -> tuple[dict[str, int], np.ndarray]:
    rows = {k: i for i, k in enumerate(sorted({key for _, key, _ in counts}))}
    column = {lang: i for i, lang in enumerate(languages)}
    table = np.full((len(rows), len(languages)), UNSEEN)
    for lang, key, n in counts:
        table[rows[key], column[lang]] = n
    return rows, np.log(table / np.array([totals.get(lang, 1) for lang in languages]))


def fit(labelled: DataFrame, id_col: str, text_col: str, lang_col: str) -> Model:
    """A model from the rows of `labelled`, whose size has a fixed bound per language."""
    key = F.xxhash64(F.col(id_col), F.lit(1))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    chosen = written(
        labelled.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"),
                key.alias("key")).distinct()
        .withColumn("rank", rank).where(F.col("rank") <= SAMPLE).select("id", "lang"), "chosen")
    texts = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"),
                            F.col(text_col).alias("text"))
    words = written(
        texts.join(join_side(chosen, 40), ["id", "lang"], "left_semi")
        .select("lang", F.explode(F.regexp_extract_all(
            F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
        .groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    marked = F.concat(F.lit("^"), "word", F.lit("$"))

    def cut(order: int) -> Column:
        starts = F.slice(F.sequence(F.lit(1), F.length(marked)), F.lit(1),
                         F.greatest(F.length(marked) - (order - 1), F.lit(0)))
        return F.transform(starts, lambda i: F.substring(marked, i, F.lit(order)))

    grams = words.select("lang", "n", F.explode(F.concat(*map(cut, ORDERS))).alias("gram")).groupBy(
        "lang", "gram").agg(F.sum("n").alias("n"))

    def most(counts: DataFrame, key: str, limit: int, *within: Column) -> list[tuple]:
        order = Window.partitionBy("lang", *within).orderBy(F.col("n").desc(), key)
        kept = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
        return [tuple(r) for r in kept.select("lang", key, "n").collect()]

    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    word_rows, word_scores = _table(most(words, "word", WORDS), totals, languages)
    gram_rows, gram_scores = _table(
        most(grams, "gram", GRAMS, F.length("gram")), totals, languages)
    return Model(languages, word_rows, gram_rows, word_scores, gram_scores)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """Every row as `row`, with lang_pred and score, its share of a mean word's likelihood."""
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.languages, model.words, model.grams, model.word_scores, model.gram_scores))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        known: dict[str, int] = {}
        scores = np.zeros((0, len(own.languages)))
        for batch in batches:
            names, shares = [], []
            texts = batch.column(batch.num_columns - 1)
            for at in range(0, batch.num_rows, TEXTS):
                found = [LETTERS.findall((t.as_py() or "").lower()) for t in texts.slice(at, TEXTS)]
                if len(known) > CACHE:
                    known, scores = {}, scores[:0]
                new = list(set().union(*found) - known.keys()) if own.languages else []
                if new:
                    known.update(zip(new, range(len(known), len(known) + len(new))))
                    scores = np.concatenate([scores, own.scores(new)])
                for words in found:
                    if not words or not own.languages:
                        names.append(UNKNOWN)
                        shares.append(0.0)
                        continue
                    mean = scores[[known[w] for w in words]].mean(axis=0)
                    best = int(mean.argmax())
                    names.append(own.languages[best])
                    shares.append(float(1 / np.exp(mean - mean[best]).sum()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(shares, pa.float64())],
                names=[*batch.schema.names[:-1], "lang_pred", "score"])

    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {schema}, lang_pred string, score double")
