"""Dominant frequencies of series: grid scans as aggregates, golden-section refinement as repeated aggregates.

Time runs over 0..30 in a series. The angular scan has phase w t and leaves the end of its grid out; the cyclic scan has phase
2 pi f t and includes it. Scans are matrix sums on the map side, so what is shuffled is a row per series and grid point from
each task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sigloom.config import Frequency
from sigloom.session import written

SPAN = 30.0
PHI = (1 + math.sqrt(5)) / 2
#: Samples in one matrix of a scan.
_STRETCH = 4096


def _time() -> Column:
    return F.when(F.col("n") > 1, F.lit(SPAN) * F.col("i") / (F.col("n") - 1)).otherwise(0.0)


def _scanned(s: DataFrame, keys: list[str], values: list[float], turn: float) -> DataFrame:
    """keys, k, f, ys, yc, ss, cc: sums of y and 1 times sine and cosine (squared) of turn f t, by grid point.

    A task adds up a matrix of samples by grid points for each stretch of samples of one series, and hands on one row a
    stretch and grid point."""
    schema = StructType([*s.select(*keys).schema.fields, *StructType.fromDDL("ys array<double>, yc array<double>, ss array<double>, cc array<double>").fields])
    width, grid = len(keys), turn * np.array(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, _STRETCH):
                part = b.slice(at, _STRETCH)
                code = np.zeros(part.num_rows, np.int64)
                for column in part.columns[:width]:
                    code = code * (part.num_rows + 1) + (column.dictionary_encode(null_encoding="encode").indices.to_numpy() if part.num_rows else 0)
                    code = np.unique(code, return_inverse=True)[1]
                t, y = part.column(width).to_numpy(), part.column(width + 1).to_numpy()
                order = np.argsort(code, kind="stable")
                begin = np.flatnonzero(np.concatenate(([True], np.diff(code[order]) > 0)))
                phase = t[order, None] * grid
                sine, cosine = np.sin(phase), np.cos(phase)
                sums = [np.add.reduceat(x, begin, axis=0) for x in (y[order, None] * sine, y[order, None] * cosine, sine * sine, cosine * cosine)]
                offsets = pa.array(np.arange(0, len(begin) * len(grid) + 1, len(grid), dtype=np.int32))
                heads = pa.array(order[begin])
                yield pa.RecordBatch.from_arrays([*(c.take(heads) for c in part.columns[:width]), *(pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in sums)], names=schema.names)

    parts = s.select(*keys, _time().alias("t"), "y").mapInArrow(run, schema)
    each = parts.select(*keys, F.posexplode(F.arrays_zip("ys", "yc", "ss", "cc")).alias("k", "v"))
    f = F.element_at(F.array(*(F.lit(float(v)) for v in values)), F.col("k") + 1)
    return each.groupBy(*keys, "k").agg(*(F.sum(f"v.{c}").alias(c) for c in ("ys", "yc", "ss", "cc"))).select(*keys, "k", f.alias("f"), "ys", "yc", "ss", "cc")


def angular_grid(p: Frequency) -> list[float]:
    return [p.low + k * (p.high - p.low) / p.points for k in range(p.points)]


def cyclic_grid(p: Frequency) -> list[float]:
    return [p.low + (p.high - p.low) * k / (p.points - 1) for k in range(p.points)]


def angular_scan(s: DataFrame, keys: list[str], p: Frequency | None = None) -> DataFrame:
    """keys, k, w, energy: squared projections on sine and cosine over their norms; -1 where a norm vanishes."""
    sums = _scanned(s, keys, angular_grid((p or Frequency()).validate()), 1.0)
    energy = F.when((F.col("ss") <= 1e-12) | (F.col("cc") <= 1e-12), -1.0).otherwise(F.col("ys") ** 2 / F.col("ss") + F.col("yc") ** 2 / F.col("cc"))
    return sums.select(*keys, "k", F.col("f").alias("w"), energy.alias("energy"))


def array_dominant(y: np.ndarray, p: Frequency) -> np.ndarray:
    """`dominant_frequency` of each row of y, a series of its own."""
    n = y.shape[1]
    if n < 4:
        return np.zeros(len(y))
    grid = np.array(angular_grid(p))
    phase = SPAN * np.arange(n)[:, None] / (n - 1) * grid
    sine, cosine = np.sin(phase), np.cos(phase)
    ss, cc = (sine * sine).sum(0), (cosine * cosine).sum(0)
    usable = (ss > 1e-12) & (cc > 1e-12)
    energy = np.where(usable, (y @ sine) ** 2 / np.where(usable, ss, 1) + (y @ cosine) ** 2 / np.where(usable, cc, 1), -1.0)
    return grid[energy.argmax(1)]


def dominant(scan: DataFrame, keys: list[str], name: str = "w") -> DataFrame:
    """The grid value of the greatest energy, the first among equals."""
    return scan.groupBy(*keys).agg(F.max_by(name, F.struct("energy", -F.col("k"))).alias(name))


def dominant_frequency(s: DataFrame, keys: list[str], p: Frequency | None = None) -> DataFrame:
    """Angular scan and its maximum; 0 for series below four samples."""
    best = dominant(angular_scan(s.where("n >= 4"), keys, p), keys)
    return best.unionByName(s.where("n < 4").select(*keys).distinct().withColumn("w", F.lit(0.0)))


def _cyclic_energy(f: Column) -> Column:
    phase = 2 * math.pi * f * F.col("t")
    ys, yc, m = F.sum(F.col("y") * F.sin(phase)), F.sum(F.col("y") * F.cos(phase)), F.max("n")
    return (ys**2 + yc**2) / (m * m / 4)


def cyclic_scan(s: DataFrame, keys: list[str], p: Frequency | None = None) -> DataFrame:
    """keys, k, f, energy with phase 2 pi f t, over n**2 / 4."""
    sums = _scanned(s, keys, cyclic_grid((p or Frequency()).validate()), 2 * math.pi)
    n = s.groupBy(*keys).agg(F.max("n").alias("n"))
    return sums.join(n, keys).select(*keys, "k", "f", ((F.col("ys") ** 2 + F.col("yc") ** 2) / (F.col("n") * F.col("n") / 4)).alias("energy"))


def refined_frequency(s: DataFrame, keys: list[str], p: Frequency | None = None, previous: DataFrame | None = None) -> DataFrame:
    """Coarse cyclic maximum, golden section around it, then inertia towards `previous` (keys, f_prev).

    The indexed samples are written once; a section is one aggregate over them, joined to two bounds a series."""
    p = (p or Frequency()).validate()
    s = written(s.select(*keys, "i", "n", "y"), "indexed-samples")
    delta = (p.high - p.low) / (p.points - 1)
    at = dominant(cyclic_scan(s, keys, p), keys, "f").select(*keys, F.greatest(F.lit(p.low), F.col("f") - delta).alias("a"), F.least(F.lit(p.high), F.col("f") + delta).alias("b"))
    timed = s.withColumn("t", _time())
    for _ in range(p.refine):
        inner = at.withColumn("c", F.col("b") - (F.col("b") - F.col("a")) / PHI).withColumn("d", F.col("a") + (F.col("b") - F.col("a")) / PHI)
        both = timed.join(inner, keys).groupBy(*keys, "a", "b", "c", "d").agg(_cyclic_energy(F.col("c")).alias("ec"), _cyclic_energy(F.col("d")).alias("ed"))
        up = F.col("ec") < F.col("ed")
        at = both.select(*keys, F.when(up, F.col("c")).otherwise(F.col("a")).alias("a"), F.when(up, F.col("b")).otherwise(F.col("d")).alias("b"))
    found = at.select(*keys, ((F.col("a") + F.col("b")) / 2).alias("f"))
    if previous is not None:
        mixed = F.when(F.col("f_prev") > 0, p.inertia * F.col("f") + (1 - p.inertia) * F.col("f_prev")).otherwise(F.col("f"))
        found = found.join(previous, keys, "left").select(*keys, mixed.alias("f"))
    return found.select(*keys, F.greatest(F.lit(p.low), F.least(F.lit(p.high), F.col("f"))).alias("f"))
