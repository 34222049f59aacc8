"""Column helpers for invalid numbers and correlations that may be undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def finite(value: Column | str) -> Column:
    """The value as a double, or null where it is NaN or infinite.

    Spark orders NaN above infinity, so one comparison finds both.
    """
    number = as_column(value).cast("double")
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def zero_filled(value: Column | str) -> Column:
    return F.coalesce(finite(value), F.lit(0.0))


def guarded_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation over complete pairs; null where a side is constant.

    The built-in ``corr`` raises on a zero variance under ANSI mode, and merged
    partial sums can leave a tiny variance for a constant, so min < max decides.
    """
    x, y = as_column(x), as_column(y)
    paired_x = F.when(y.isNotNull(), x)
    paired_y = F.when(x.isNotNull(), y)
    varies = (F.min(paired_x) < F.max(paired_x)) & (F.min(paired_y) < F.max(paired_y))
    spread = F.stddev_pop(paired_x) * F.stddev_pop(paired_y)
    return F.when(varies, F.try_divide(F.covar_pop(x, y), spread))


def rounded(value: Column | str, digits: int = 6) -> Column:
    """Rounded half away from zero, for comparison between engines.

    Done on scaled doubles, because ``round`` goes through a decimal per value;
    adding zero removes a minus zero.
    """
    scaled = as_column(value) * F.lit(10.0**digits)
    whole = F.floor(F.abs(scaled) + F.lit(0.5)).cast("double")
    return F.signum(scaled) * whole / F.lit(10.0**digits) + F.lit(0.0)
