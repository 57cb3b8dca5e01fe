"""Power spectra by averaged, windowed segments, and whitening filters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sigloom.functions.scalar import hamming

from .series import frames, padded, windowed

#: Samples that a filter takes at once.
BLOCK = 4096


@dataclass(frozen=True)
class Welch:
    segment: int = 256
    overlap: int = 128
    fft: int = 512
    taps: int = 64
    epsilon: float = 1e-12

    def validate(self) -> "Welch":
        if not (0 < self.segment <= self.fft and 0 <= self.overlap < self.segment and 0 < self.taps <= self.fft and self.fft % 2 == 0):
            raise ValueError("a segment must fit the transform, overlap less than itself, and taps must fit the transform")
        return self


def welch_psd(s: DataFrame, keys: list[str], p: Welch | None = None) -> DataFrame:
    """keys, bin, psd: mean of squared magnitudes over segments and transform size, doubled but for the first and last bin.
    Series shorter than a segment give no rows. Frames are transformed in batches; sums are partial on the map side."""
    p = (p or Welch()).validate()
    f = frames(s.where(F.col("n") >= p.segment), keys, p.segment, p.segment - p.overlap)
    w = padded(windowed(f, hamming), p.fft).select(*keys, "y")
    schema = StructType([*w.select(*keys).schema.fields, *StructType.fromDDL("power array<double>").fields])
    width, fft = len(keys), p.fft

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(width).flatten().to_numpy().reshape(-1, fft)
            power = np.abs(np.fft.rfft(y, axis=1)) ** 2
            offsets = pa.array(np.arange(0, power.size + 1, fft // 2 + 1, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.ListArray.from_arrays(offsets, pa.array(power.ravel()))], names=schema.names)

    bins = w.mapInArrow(run, schema).select(*keys, F.posexplode("power").alias("bin", "v"))
    twice = F.when((F.col("bin") > 0) & (F.col("bin") < p.fft // 2), 2.0).otherwise(1.0)
    return bins.groupBy(*keys, "bin").agg((F.sum("v") / (F.count(F.lit(1)) * p.fft)).alias("m")).select(*keys, "bin", (F.col("m") * twice).alias("psd"))


def response(psd: DataFrame, epsilon: float = 1e-12) -> DataFrame:
    return psd.withColumn("h", 1 / F.sqrt(F.col("psd") + epsilon))


def whitening_taps(psd: DataFrame, keys: list[str], p: Welch | None = None) -> DataFrame:
    """keys, taps: the inverse transform of the response, cut, Hamming-weighted and scaled to sum 1."""
    p = (p or Welch()).validate()
    gathered = response(psd, p.epsilon).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "h"))).alias("g")).select(*keys, F.col("g.h").alias("h"))
    schema = StructType([*gathered.select(*keys).schema.fields, *StructType.fromDDL("taps array<double>").fields])
    width, n = len(keys), p.taps

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i = np.arange(n)
        window = 0.54 - 0.46 * np.cos(2 * np.pi * i / (n - 1)) if n > 1 else np.ones(1)
        for b in batches:
            taps = []
            for h in b.column(width).to_pylist():
                x = np.fft.irfft(np.array(h)) * (2 * (len(h) - 1))
                x = x[:n] * window
                taps.append((x / x.sum() if abs(x.sum()) > 1e-30 else x).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(taps, pa.list_(pa.float64()))], names=schema.names)

    return gathered.mapInArrow(run, schema)


def fir(s: DataFrame, keys: list[str], taps: DataFrame, length: int | None = None) -> DataFrame:
    """keys, i, y: causal filter with taps (keys, taps), of at most `length`; before the start the series is mirrored, beyond its
    length its last sample stands in. A series is cut into blocks that begin with the samples before them which the filter
    needs; a block is filtered at once."""
    if length is None:
        length = taps.agg(F.max(F.size("taps"))).first()[0] or 1
    block = max(BLOCK, length)
    first, last = F.floor(F.col("i") / block), F.least(F.floor((F.col("i") + length - 1) / block), F.floor((F.col("n") - 1) / block))
    dealt = s.select(*keys, "i", "n", "y", F.explode(F.sequence(first, last)).alias("block"))
    gathered = dealt.groupBy(*keys, "block", "n").agg(F.array_sort(F.collect_list(F.struct("i", "y"))).alias("g"))
    x = gathered.select(*keys, "block", "n", F.col("g.y").alias("y")).join(taps, keys)
    schema = StructType([*x.select(*keys).schema.fields, *StructType.fromDDL("first long, out array<double>").fields])
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns, out, begin = (b.column(width + k).to_pylist() for k in range(4)), [], []
            for k, n, y, h in zip(*columns, strict=True):
                y, h, start = np.array(y, dtype=float), np.array(h, dtype=float), k * block
                before = min(length - 1, start)
                if not start:
                    mirrored = y[np.minimum(np.arange(len(h) - 1), n - 1)][::-1]
                    y, before = np.concatenate((mirrored, y)), len(h) - 1
                out.append(np.convolve(y, h)[before : len(y)].tolist())
                begin.append(start)
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(begin, pa.int64()), pa.array(out, pa.list_(pa.float64()))], names=schema.names)

    return x.select(*keys, "block", "n", "y", "taps").mapInArrow(run, schema).select(*keys, "first", F.posexplode("out").alias("at", "y")).select(*keys, (F.col("first") + F.col("at")).alias("i"), "y")


def whiten(s: DataFrame, keys: list[str], p: Welch | None = None) -> DataFrame:
    """Whitened samples; series too short for a spectrum stay as they are."""
    p = (p or Welch()).validate()
    done = fir(s.where(F.col("n") >= p.segment), keys, whitening_taps(welch_psd(s, keys, p), keys, p), p.taps)
    return done.unionByName(s.where(F.col("n") < p.segment).select(*keys, "i", "y"))
