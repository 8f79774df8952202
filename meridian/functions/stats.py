"""Columns with the null rules of the engine: a result that has no value is NULL or a stated constant, never NaN or an error."""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

YEAR = 252


def finite(c: Column | str) -> Column:
    """A double, or NULL where it is not finite or cannot be cast."""
    x = F.expr(f"try_cast({c} as double)") if isinstance(c, str) else c.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(a, b)


def clip(c: Column, lo: float, hi: float) -> Column:
    """``c`` within its bounds; of equal values the bound is taken, so -0.0 at a bound of 0 is 0.0, as in SQL engines."""
    return F.least(F.lit(hi), F.greatest(F.lit(lo), c))


def rounded_half(c: Column, places: int) -> Column:
    """``c`` to so many places as SQL engines round binary numbers: the product, halves away from zero, divided again; a small negative number stays -0.0."""
    scale = float(10**places)
    y = c * scale
    out = F.round(y, 0) / scale
    return F.when(F.abs(y) == float("inf"), c).when(out == 0, F.signum(c) * 0.0).otherwise(out)


def fixed(c: Column, places: int) -> Column:
    """The text of a double to so many places as C's printf has it: rounded by its binary value, an exact half to the even digit."""
    x = c.cast("double")
    text = F.call_function("format_number", x, F.lit("0." + "0" * places))
    return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise(text)


def exact_sum(c: Column) -> Column:
    """The sum of a column of doubles to about 2^-85 a row, whatever the order of its rows.

    Each value is split into whole units of 2^-32 and of 2^-92, and both are added as whole numbers. With a value of 2^30
    or more, or one that is not finite, it is the plain sum.
    """
    fits = F.abs(c) < float(2**30)
    y = F.when(fits, c * float(2**32))
    high, low = F.floor(y), F.floor((y - F.floor(y)) * float(2**60))
    whole = lambda x, unit: F.sum(x.cast("decimal(20,0)")).cast("double") / float(unit)
    return F.when(F.bool_and(fits), whole(high, 2**32) + whole(low, 2**92)).otherwise(F.sum(c))


def over_series(key: str | list[str], t: str = "t") -> WindowSpec:
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(t)


def rolling(fn, c: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    """``fn`` of the last n rows, NULL until ``least`` (n) of them have values."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(frame) >= (least or n), fn(c).over(frame))


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def compounded(c: Column, w: WindowSpec) -> Column:
    """The running product of 1 + ``c``, whatever its sign."""
    x, over = 1 + c, running(w)
    sign = 1 - 2 * (F.sum((x < 0).cast("int")).over(over) % 2)
    size = F.exp(F.sum(F.log(F.nullif(F.abs(x), F.lit(0.0)))).over(over))
    return F.when(F.max((x == 0).cast("int")).over(over) == 1, 0.0).otherwise(sign * F.coalesce(size, F.lit(1.0)))


def average_rank(c: Column, keys: list[Column | str]) -> Column:
    """Ranks from 1, ties averaged, among the rows with a value."""
    by = Window.partitionBy(*keys, c.isNull())
    rank = F.rank().over(by.orderBy(c))
    return F.when(c.isNotNull(), rank + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / F.lit(2.0))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's, of the rows where both have values; NULL where one does not vary."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > 1e-15, F.try_divide(F.covar_pop(a, b), spread))


def plain_stddev(c: Column) -> Column:
    """stddev_pop as SQL engines give it: infinite where the squares of finite values pass the doubles. Spark has NaN there, as it multiplies them by an empty part's 0 rows."""
    sd, small = F.stddev_pop(c), F.stddev_pop(c * 2.0**-600) * 2.0**600
    over = small * F.sqrt(F.count(c)) > math.sqrt(sys.float_info.max)
    return F.when(F.isnan(sd) & ~F.isnan(small), F.when(over, float("inf")).otherwise(small)).otherwise(sd)


def plain_correlation(x: Column, y: Column) -> Column:
    """Pearson's as SQL engines give it, of the rows where both have values: NaN where one does not vary, 0 where the variance of one alone is infinite, NULL without such rows."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    value = F.try_divide(F.covar_pop(a, b), plain_stddev(a) * plain_stddev(b))
    return F.when(F.count(a) > 0, F.coalesce(value, F.lit(float("nan"))))


def sharpe(c: Column, least: int = 5) -> Column:
    sd = F.stddev_samp(c)
    return F.when((F.count(c) >= least) & (sd > 0), F.avg(c) / sd * F.sqrt(F.lit(float(YEAR)))).otherwise(0.0)


# --- arrays of doubles ---


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    """Of the known elements; NULL where none is known, 0 of an empty array."""
    known = F.array_compact(a)
    return F.when(F.size(a) > 0, F.try_divide(total(known), F.size(known))).otherwise(0.0)


def spread(a: Column, ddof: int = 1) -> Column:
    """Standard deviation of the known elements; 0 with too few of them."""
    m, known = mean(a), F.array_compact(a)
    square = F.aggregate(known, F.lit(0.0), lambda s, x: s + (x - m) * (x - m))
    return F.when(F.size(known) > ddof, F.sqrt(square / F.greatest(F.size(known) - ddof, F.lit(1)))).otherwise(0.0)


def positive_share(a: Column) -> Column:
    return F.size(F.filter(a, lambda x: x > 0)) / F.size(a)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 1e-15, clip(dot(a, b) / n, -1.0, 1.0)).otherwise(0.0)
