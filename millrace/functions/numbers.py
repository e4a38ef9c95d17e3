"""Arithmetic as Column builders: safe ratios, distributions, calibration."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), F.when(b != 0, b).cast("double")), F.lit(default))


def share(c: Column) -> Column:
    """The share of rows for which c holds; 0 without rows."""
    return F.coalesce(F.avg(c.cast("int")), F.lit(0.0))


def softmax(c: Column, window: Window, temperature: float = 1.0) -> Column:
    e = F.exp((c - F.max(c).over(window)) / temperature)
    return e / F.sum(e).over(window)


def min_max(c: Column, window: Window, default: float = 0.0) -> Column:
    low, high = F.min(c).over(window), F.max(c).over(window)
    return F.when(high > low, (c - low) / (high - low)).otherwise(F.lit(default))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers; 0 when a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def bucket(p: Column, buckets: int) -> Column:
    """The calibration bucket of a probability: the last one holds 1."""
    return F.least(F.lit(buckets - 1), F.floor(clamp(p) * buckets)).cast("int")


def running_at_most(c: Column, limit: float, window: Window) -> Column:
    """Whether the running sum of doubles is at most a limit, by their exact sum: added as doubles, 1000.00 in cents can come out above 1000.

    Doubles that a decimal of 10 places holds are added as such; once one is met that it does not hold (NaN, 1e-12, 1e300), the sum of doubles decides.
    """
    near = c.try_cast("decimal(28,10)")
    exact = F.when(near.cast("double") == c, near)
    whole = F.count(exact).over(window) == F.count(c).over(window)
    return F.when(whole, F.sum(exact).over(window) <= F.lit(limit).cast("decimal(28,10)")).otherwise(F.sum(c).over(window) <= limit)


def salted_unit(salt: str, c: Column) -> Column:
    """A number in [0, 1] that is a pure function of salt and c."""
    return F.conv(F.substring(F.sha1(F.concat(F.lit(f"{salt}::"), c.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967295.0
