"""Rounding of doubles by their value, as C and SQL engines round them.

Spark's ``round``, ``bround`` and ``format_string`` round the shortest decimal
that stands for a double, which is a tie more often than the double is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = 46


def half_even(v: Column, digits: int) -> Column:
    """The scaled value to the nearest whole number, ties to the even one."""
    return F.rint(v * float(10 ** digits)) / float(10 ** digits)


def half_up(v: Column, digits: int) -> Column:
    """The scaled value of a number from 0 on to the nearest whole number, ties upwards."""
    y = v * float(10 ** digits)
    return (F.floor(y) + F.when(y - F.floor(y) >= 0.5, 1).otherwise(0)) / float(10 ** digits)


def one_decimal(v: Column) -> Column:
    """A number in [0, 100] printed with one decimal, as ``%.1f`` does in C: exact value, ties to even."""
    scaled = v * float(2 ** _BITS)
    n = F.floor(scaled).cast("bigint")
    tenths = F.shiftright(n * 10, _BITS)
    short = (tenths * 2 + 1) * (2 ** _BITS) - n * 20  # of the middle between two tenths, in twentieths
    rest = (scaled - n) * 20
    up = (rest > short) | ((rest == short) & (tenths % 2 == 1))
    t = tenths + F.when(up, 1).otherwise(0)
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))


def stddev_pop(values: Column) -> Column:
    """Population deviation of an array in one pass with a running mean, which loses no digits to large sums."""
    def step(s: Column, x: Column) -> Column:
        n = s["n"] + 1
        mean = s["mean"] + (x - s["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["m2"] + (x - mean) * (x - s["mean"])).alias("m2"))
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(values, zero, step, lambda s: F.when(s["n"] > 0, F.sqrt(s["m2"] / s["n"])))
