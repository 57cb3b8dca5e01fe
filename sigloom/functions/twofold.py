"""Double-double numbers as STRUCT<hi, lo>: error-free transforms in plain expressions (no fused multiply-add needed)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

_SPLIT = 134217729.0  # 2**27 + 1


def make(hi: Column, lo: Column | float = 0.0) -> Column:
    return F.struct(hi.cast("double").alias("hi"), (F.lit(lo) if isinstance(lo, float) else lo).cast("double").alias("lo"))


def _bound(f, *args: Column) -> Column:
    """f of the arguments, each worked out once: without names, nested arithmetic would repeat its operands."""
    return F.transform(F.array(F.struct(*(a.alias(f"v{k}") for k, a in enumerate(args)))), lambda v: f(*(v[f"v{k}"] for k in range(len(args)))))[0]


def _quick(a: Column, b: Column) -> Column:
    return _bound(lambda s, x, y: make(s, y - (s - x)), a + b, a, b)


def add(a: Column, b: Column) -> Column:
    return _bound(lambda x, y: _bound(lambda s, t: _quick(s, (x.hi - (s - t)) + (y.hi - t) + x.lo + y.lo), x.hi + y.hi, (x.hi + y.hi) - x.hi), a, b)


def sub(a: Column, b: Column) -> Column:
    return add(a, _bound(lambda y: make(-y.hi, -y.lo), b))


def mul(a: Column, b: Column) -> Column:
    def split(x: Column) -> Column:
        return _SPLIT * x - (_SPLIT * x - x)

    def whole(x: Column, y: Column, xh: Column, yh: Column) -> Column:
        p = x.hi * y.hi
        e = ((xh * yh - p) + xh * (y.hi - yh) + (x.hi - xh) * yh) + (x.hi - xh) * (y.hi - yh)
        return _quick(p, e + x.hi * y.lo + x.lo * y.hi)

    return _bound(lambda x, y: _bound(lambda xh, yh: whole(x, y, xh, yh), split(x.hi), split(y.hi)), a, b)


def div(a: Column, b: Column) -> Column:
    def corrected(x: Column, y: Column, q: Column) -> Column:
        return _bound(lambda r: _quick(q, (r.hi + r.lo) / y.hi), sub(x, mul(make(q), y)))

    return _bound(lambda x, y: _bound(lambda q: corrected(x, y, q), x.hi / y.hi), a, b)


def absolute(a: Column) -> Column:
    return _bound(lambda x: F.when(x.hi < 0, make(-x.hi, -x.lo)).otherwise(x), a)


def _hi_lo(f_hi, f_lo):
    """A function of a double-double: the double result h of `f_hi`, and as the low part what `f_lo` says of x and h."""
    return lambda x: _bound(lambda h: make(h, f_lo(x, h)), f_hi(x))


def sqrt(a: Column) -> Column:
    """0 below 0; one Newton step from the double root."""
    root = _hi_lo(lambda x: F.sqrt(x.hi), lambda x, h: value(sub(x, mul(make(h), make(h)))) / (2 * h))
    return _bound(lambda x: F.when(x.hi > 0, root(x)).otherwise(make(F.lit(0.0))), a)


def exp(a: Column) -> Column:
    return _bound(_hi_lo(lambda x: F.exp(x.hi), lambda x, h: h * x.lo), a)


def log(a: Column) -> Column:
    """0 at 0 and below."""
    return _bound(lambda x: F.when(x.hi > 0, _hi_lo(lambda x: F.log(x.hi), lambda x, h: x.lo / x.hi)(x)).otherwise(make(F.lit(0.0))), a)


def sin(a: Column) -> Column:
    return _bound(_hi_lo(lambda x: F.sin(x.hi), lambda x, h: F.cos(x.hi) * x.lo), a)


def cos(a: Column) -> Column:
    return _bound(_hi_lo(lambda x: F.cos(x.hi), lambda x, h: -F.sin(x.hi) * x.lo), a)


def less(a: Column, b: Column) -> Column:
    """By the high part, then by the low."""
    return _bound(lambda x, y: (x.hi < y.hi) | ((x.hi == y.hi) & (x.lo < y.lo)), a, b)


def descending(a: Column) -> Column:
    """An array of double-doubles in falling order of (hi, lo)."""
    return F.sort_array(a, asc=False)


def value(a: Column) -> Column:
    return _bound(lambda x: x.hi + x.lo, a)


def is_small(a: Column, eps: float = 1e-9) -> Column:
    return F.abs(a.hi) <= eps


def compensated_sum(df: DataFrame, keys: list[str], value_col: str, name: str = "total") -> DataFrame:
    """Sum per key, correctly rounded within a task: partial sums as double-double, two shuffled numbers a key and task."""
    schema = df.select(*keys).schema.add("hi", "double").add("lo", "double")
    arrow = to_arrow_schema(schema)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import math

        held: dict[tuple, list[float]] = {}
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(keys))]
            for key, x in zip(zip(*columns, strict=True), batch.column(len(keys)).to_pylist(), strict=True):
                held.setdefault(key, []).append(x or 0.0)
            for key, xs in held.items():
                if len(xs) > 4096:
                    hi = math.fsum(xs)
                    held[key] = [hi, math.fsum([*xs, -hi])]
        rows = []
        for key, xs in held.items():
            hi = math.fsum(xs)
            rows.append((*key, hi, math.fsum([*xs, -hi])))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    parts = df.select(*keys, F.col(value_col).cast("double")).mapInArrow(partial, schema)
    folded = F.aggregate(F.array_sort(F.collect_list(F.struct("hi", "lo"))), make(F.lit(0.0)), add)
    return parts.groupBy(*keys).agg(folded.alias("s")).select(*keys, value(F.col("s")).alias(name))
