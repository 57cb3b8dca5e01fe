"""Scalar and array expressions that stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column | str) -> Column:
    """Null, NaN and infinities become 0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def clamp(c: Column, low: float, high: float) -> Column:
    """Nearest bound; NaN becomes the midpoint."""
    return F.least(F.greatest(F.nanvl(c, F.lit((low + high) / 2)), F.lit(low)), F.lit(high))


def erf(x: Column) -> Column:
    """Winitzki's closed form of the error function."""
    a = 0.147
    s = x * x
    return F.signum(x) * F.sqrt(1 - F.exp(-s * (4 / math.pi + a * s) / (1 + a * s)))


def hann(i: Column, n: Column) -> Column:
    return F.when(n < 2, 1.0).otherwise(0.5 * (1 - F.cos(2 * math.pi * i / (n - 1))))


def hamming(i: Column, n: Column) -> Column:
    return F.when(n < 2, 1.0).otherwise(0.54 - 0.46 * F.cos(2 * math.pi * i / (n - 1)))


def huber_weight(e: Column, c: float = 1.345) -> Column:
    a = F.abs(e)
    return F.when(e.isNull() | F.isnan(e), 0.0).when(a <= c, 1.0).otherwise(c / (a + 1e-30))


def safe_log(x: Column) -> Column:
    return F.when(x > 0, F.log(x)).otherwise(0.0)


def norm_sq(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + clean(x) * clean(x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def first9_median(a: Column) -> Column:
    """The upper median of the first nine elements."""
    head = F.slice(a, 1, 9)
    return F.element_at(F.array_sort(head), (F.floor(F.size(head) / 2) + 1).cast("int"))


def incomplete_beta_kernel(x: Column, a: float, b: float) -> Column:
    """x**a (1-x)**b, held in 0..1."""
    return clamp(F.pow(x, a) * F.pow(1 - x, b), 0.0, 1.0)
