r"""Quality rules: a threshold table compiled into one projection.

Words are runs of other characters than \x20 and \x09-\x0D. Every count is a
built-in expression over the row's own text, so the operator is one scan without
a shuffle. Rules compare counts in thousandths, in whole numbers.

Defined cases: a null or empty text has no words and fails the base rules; ties
and repeated rows are judged alike, row by row; an empty table gives an empty
result; other columns, whatever their names, are ignored by `quality_counts` and
`judged` and returned untouched by `keep_good`.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culturelens.llm.common import text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
NOT_SYMBOL = r"[^#*$%&|<>]+"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for on with as are was be by an at this from or not "
    "der die das und ist nicht mit von den ein eine zu auf im dem des sich als auch für "
    "le la les et est des de un une dans que qui pour sur pas avec au du en il "
    "el los las y se no del por con una su para lo como al es"
).split()


class Rule(NamedTuple):
    """Passes if least <= 1000 * top / bottom <= most; a None bound is open."""

    name: str
    top: str
    bottom: str | None   # None: the count itself, not a ratio
    least: int | None
    most: int | None


RULES = (
    Rule("length", "n_words", None, LEAST_WORDS, 1_000_000),
    Rule("word_length", "word_chars", "n_words", 2_000, 12_000),
    Rule("symbols", "n_symbols", "n_words", None, 100),
    Rule("stop_words", "n_stop_words", "n_words", 20, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 700),
    Rule("line_length", "n_words", "n_lines", 1_500, None),
)


def passes(rule: Rule) -> Column:
    top = F.col(rule.top) if rule.bottom is None else F.col(rule.top) * 1000
    bottom = F.lit(1) if rule.bottom is None else F.col(rule.bottom)
    bounds = [F.lit(True)]
    if rule.least is not None:
        bounds.append(top >= F.lit(rule.least) * bottom)
    if rule.most is not None:
        bounds.append(top <= F.lit(rule.most) * bottom)
    return reduce(Column.__and__, bounds)


def rule_sql(rule: Rule) -> str:
    """The same test as SQL text."""
    top = rule.top if rule.bottom is None else f"{rule.top} * 1000"
    bottom = rule.bottom or "1"
    return " and ".join(
        ["true"] + [f"{top} {sign} {bound} * {bottom}"
                    for sign, bound in ((">=", rule.least), ("<=", rule.most))
                    if bound is not None])


def window_hash(*words: Column) -> Column:
    return F.xxhash64(*words)


def _windows() -> Column:
    """Each window of three words with its hash, which comes first, and its position."""
    w = F.col("words")
    count = F.size(w) - 2
    at = F.slice(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), F.lit(1),
                 F.greatest(count, F.lit(0)))
    return F.transform(at, lambda i: F.struct(
        window_hash(w[i], w[i + 1], w[i + 2]).alias("h"), w[i].alias("a"),
        w[i + 1].alias("b"), w[i + 2].alias("c"), i.alias("p")))


def _repeated() -> Column:
    """Positions of the sorted windows that equal a neighbour; equal ones stand together."""
    s = F.col("windows")

    def same(x: Column, y: Column) -> Column:
        return ((x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"])
                & (x["c"] == y["c"]))

    hits = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
    return F.transform(hits, lambda x: x["p"])


def quality_counts(docs: DataFrame, text: str = "text", carry: tuple[Column, ...] = ()) -> DataFrame:
    """`carry` columns and the counts that the rules name, one row per row of `docs`."""
    names = [f"carry_{i}" for i in range(len(carry))]
    split = docs.select(
        *[c.alias(n) for c, n in zip(carry, names)], text_or_empty(text).alias("text")
    ).select(
        *names, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", NOT_SYMBOL, "")).cast("long").alias("n_symbols"),
    )
    counted = split.select(
        *names, "words", "word_chars", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda x: x.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
    )
    counts = [*names, "word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines",
              "n_stop_words"]
    ordered = counted.select(*counts, F.sort_array(_windows()).alias("windows"))
    found = ordered.select(*counts, _repeated().alias("hits"))
    covered = F.flatten(F.transform("hits", lambda p: F.array(p, p + 1, p + 2)))
    return found.select(*counts, F.size(F.array_distinct(covered)).cast("long")
                        .alias("n_repeat_words"))


def judged(docs: DataFrame, text: str = "text", carry: tuple[Column, ...] = (),
           rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`quality_counts` with base_failed, failed_rules and kept."""
    counts = quality_counts(docs, text, carry)
    base = ((F.col("n_words") < LEAST_WORDS)
            | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT))
    failed = F.concat_ws(",", *[F.when(~passes(r), F.lit(r.name)) for r in rules])
    return counts.withColumns({"base_failed": base, "failed_rules": failed}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` without the rows that the rules reject."""
    found = judged(docs, text, (F.struct("*"),), rules).select(
        "carry_0", "kept", F.monotonically_increasing_id().alias("place"))
    # the row number keeps the filter above the counts; below, it would repeat them
    return found.where(F.col("kept") & (F.col("place") >= 0)).select("carry_0.*")
