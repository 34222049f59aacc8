"""Exact quantiles of many columns without sorting, exploding or collecting the data.

A first wide aggregate builds one mergeable KLL sketch per column, which brackets every
wanted order statistic. Each further pass counts the rows below the open brackets and, where
a bracket still holds many values, sketches these alone; where it holds few, it lists them and
picks the wanted ones by their exact rank. So a bracket shrinks about a hundredfold a pass
and the result is exact at any size, along one path. Tasks' partial results meet in SALTS
groups first, so that no reducer holds the sketches of all tasks, and brackets are literals:
no row is multiplied or joined.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH = 4096            # size of a sketch: its ranks err by about MARGIN / 3 at most
MARGIN = 4e-3            # bracket half-width in ranks, relative to the row count
LISTED = 20_000          # most values of one bracket that are listed in one task
GRID = 256               # marks of a narrowing sketch
SALTS = 32
PARTS = ("under", "upto_low", "under_high", "upto", "v0_", "v1_", "marks")


@dataclass
class _Target:
    """An order statistic pair (ranks k0 <= k1) and the bracket it lies in."""

    k0: int
    k1: int
    weight: float
    low: float
    high: float
    inside: float
    value: float | None = None


def _interpolate(v0: float, v1: float, weight: float) -> float:
    return v0 if weight == 0 or v0 == v1 else v0 + (v1 - v0) * weight


def quantile_ranks(probabilities: Sequence[float]) -> Callable[[int], list[tuple]]:
    """Linear interpolation between the neighbours of position p * (n - 1)."""

    def ranks(n: int) -> list[tuple]:
        found = []
        for p in probabilities:
            position = p * (n - 1)
            k0 = int(position)
            found.append((k0, min(k0 + 1, n - 1), position - k0))
        return found

    return ranks


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    accuracy: int | None = None,
) -> dict[str, list[float | None]]:
    """Quantiles per column, nulls skipped; NaN must already be null.

    ``accuracy`` switches to the one-pass approximate sketch.
    """
    if not columns:
        return {}
    if accuracy is not None:
        marks = F.array(*map(F.lit, probabilities))
        row = df.agg(*[F.percentile_approx(_number(c), marks, accuracy).alias(f"m{i}")
                       for i, c in enumerate(columns)]).first()
        return {c: row[f"m{i}"] or [None] * len(probabilities) for i, c in enumerate(columns)}
    return _select(df, columns, quantile_ranks(probabilities), list(probabilities))


def kth_smallest(df: DataFrame, column: str, k: int, n: int) -> float:
    """The k-th smallest value (from 1) of a column with n non-null values."""
    fraction = (k - 1) / max(n - 1, 1)
    return _select(df, [column], lambda _: [(k - 1, k - 1, 0.0)], [fraction])[column][0]


def _number(name: str) -> Column:
    return F.col(f"`{name}`").cast("double")


def _marks(sketch: str, n: str, ranks: Sequence[float]) -> Column:
    found = F.kll_sketch_get_quantile_double(F.col(sketch), F.array(*map(F.lit, ranks)))
    return F.when(F.col(n) > 0, found)


def _two_step(df: DataFrame, sums: dict[str, Column], sketches: dict[str, Column],
              lists: dict[str, Column], least: dict[str, Column], most: dict[str, Column]):
    """One row of wide aggregates, merged in groups of tasks first."""
    salted = df.withColumn("_salt", F.spark_partition_id() % SALTS).groupBy("_salt").agg(*[
        c.alias(n) for n, c in [
            *((n, F.count_if(c)) for n, c in sums.items()),
            *((n, F.kll_sketch_agg_double(c, SKETCH)) for n, c in sketches.items()),
            *((n, F.collect_list(c)) for n, c in lists.items()),
            *((n, F.min(c)) for n, c in least.items()), *((n, F.max(c)) for n, c in most.items())]])
    return salted.agg(*[
        c.alias(n) for n, c in [
            *((n, F.sum(n)) for n in sums), *((n, F.kll_merge_agg_double(n)) for n in sketches),
            *((n, F.sort_array(F.flatten(F.collect_list(n)))) for n in lists),
            *((n, F.min(n)) for n in least), *((n, F.max(n)) for n in most)]])


def _select(df, columns, ranks, fractions) -> dict[str, list[float | None]]:
    def clamped(p: float) -> float:
        return min(max(p, 0.0), 1.0)

    wanted = sorted({clamped(p + side) for p in fractions for side in (-MARGIN, MARGIN)})
    numbers = {str(i): _number(c) for i, c in enumerate(columns)}
    first = _two_step(
        df, {f"n{i}": x.isNotNull() for i, x in numbers.items()},
        {f"s{i}": x for i, x in numbers.items()}, {},
        {f"least{i}": x for i, x in numbers.items()}, {f"most{i}": x for i, x in numbers.items()})
    row = first.select(
        *[F.col(f"{part}{i}") for i in numbers for part in ("n", "least", "most")],
        *[_marks(f"s{i}", f"n{i}", wanted).alias(f"marks{i}") for i in numbers]).first()
    targets: dict[str, list[_Target]] = {}
    limits: dict[str, tuple[float, float]] = {}
    for i, c in enumerate(columns):
        n, least, most = (row[f"{part}{i}"] for part in ("n", "least", "most"))
        if not n:
            continue
        at = dict(zip(wanted, row[f"marks{i}"]))
        limits[c] = (least, most)
        targets[c] = [
            _Target(
                k0, k1, weight,
                least if p - MARGIN <= 0 else at[clamped(p - MARGIN)],
                most if p + MARGIN >= 1 else at[clamped(p + MARGIN)],
                min(n, n * 3 * MARGIN + 2),
            )
            for p, (k0, k1, weight) in zip(fractions, ranks(n))
        ]
        for target in targets[c]:
            if target.low == target.high == least == most:
                target.value = least
    while any(t.value is None for found in targets.values() for t in found):
        _resolve(df, targets, limits)
    return {
        c: [t.value for t in targets[c]] if c in targets else [None] * len(fractions)
        for c in columns
    }


def _resolve(df, targets, limits) -> None:
    """One pass: settle the brackets that hold few values, narrow the others."""
    open_ = {f"{i}_{j}": (c, t) for i, c in enumerate(targets)
             for j, t in enumerate(targets[c]) if t.value is None}
    sums, sketches, lists = {}, {}, {}
    for key, (c, t) in open_.items():
        x, low, high = _number(c), F.lit(t.low), F.lit(t.high)
        sums |= {f"under{key}": x < low, f"upto_low{key}": x <= low,
                 f"under_high{key}": x < high, f"upto{key}": x <= high}
        (lists if t.inside <= LISTED else sketches)[f"in{key}"] = F.when((x > low) & (x < high), x)
    found = _two_step(df, sums, sketches, lists, {}, {})
    chosen = [F.col(name) for name in sums]
    for key, (c, t) in open_.items():
        before = F.col(f"upto_low{key}")
        if f"in{key}" in lists:
            chosen += [F.get(f"in{key}", (F.lit(k) - before).cast("int")).alias(f"{name}{key}")
                       for name, k in (("v0_", t.k0), ("v1_", t.k1))]
        else:
            marks = F.array(*[F.lit(g / GRID) for g in range(GRID + 1)])
            chosen.append(F.when(F.col(f"under_high{key}") > before,
                                 F.kll_sketch_get_quantile_double(F.col(f"in{key}"), marks))
                          .alias(f"marks{key}"))
    row = found.select(*chosen).first().asDict()
    for key, (c, t) in open_.items():
        _settle(t, {part: row.get(part + key) for part in PARTS}, limits[c])


def _settle(t: _Target, seen: dict, limits: tuple[float, float]) -> None:
    under, upto_low = seen["under"], seen["upto_low"]
    under_high, upto = seen["under_high"], seen["upto"]
    if t.k0 < under or t.k1 >= upto:
        # The sketch missed: widen to the whole range on that side.
        t.low = limits[0] if t.k0 < under else t.low
        t.high = limits[1] if t.k1 >= upto else t.high
        t.inside = max(under_high - upto_low, under, float(upto))
        return

    def at(k: int, listed: float | None) -> float | None:
        if k < upto_low:
            return t.low
        return t.high if k >= under_high else listed

    v0, v1 = at(t.k0, seen["v0_"]), at(t.k1, seen["v1_"])
    if v0 is not None and v1 is not None:
        t.value = _interpolate(v0, v1, t.weight)
        return
    held = under_high - upto_low
    marks = seen["marks"]
    below = int((t.k0 - upto_low) / held * GRID) - 1
    above = int((t.k1 - upto_low) / held * GRID) + 2
    t.low = marks[below] if t.k0 >= upto_low and below > 0 else t.low
    t.high = marks[above] if t.k1 < under_high and above < GRID else t.high
    t.inside = min(held, held * 5 / GRID + 2)
