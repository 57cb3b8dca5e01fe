"""Robust noise levels of series: differences, mean deviation, and block quartiles at several scales.

Block quartiles are discrete (no interpolation): of n values in falling order, those at floor(n/4) and floor(3n/4). For
series, all of it is Catalyst expressions over gathered blocks of bounded size. `array_sigmas` does the same to frames that
are rows already, inside the Arrow batch that pursuit works on.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.config import EPSILON, Noise
from sigloom.functions.scalar import clean

from .series import numbered, with_blocks

IQR, MAD = 1.349, 0.67448975


def exact_median(df: DataFrame, keys: list[str], value: str, name: str, spread: bool = False) -> DataFrame:
    """Median per key by rank, which spills, where an aggregate would hold all values of a key; `spread` as in `numbered`."""
    ranked = numbered(df.select(*keys, value), keys, [value], spread)
    middle = (F.col("i") + 1 == F.floor((F.col("n") + 1) / 2)) | (F.col("i") == F.floor(F.col("n") / 2))
    return ranked.where(middle).groupBy(*keys).agg(F.avg(value).alias(name))


def difference_sigma(s: DataFrame, keys: list[str]) -> DataFrame:
    """Median absolute first difference over 0.67448975 sqrt 2; 1e-9 if that median is below 1e-12. Series of one sample give no row."""
    step = F.col("y") - F.lag("y").over(Window.partitionBy(*keys).orderBy("i"))
    d = s.select(*keys, F.abs(step).alias("d")).where("d is not null").select(*keys, F.nanvl("d", F.lit(0.0)).alias("d"))
    return exact_median(d, keys, "d", "m").select(*keys, F.when(F.col("m") < 1e-12, EPSILON).otherwise(F.col("m") / (MAD * math.sqrt(2))).alias("sigma"))


def mean_deviation_sigma(s: DataFrame, keys: list[str]) -> DataFrame:
    """Mean absolute deviation from the median over 0.6745; 1e-9 for fewer than two samples."""
    m = exact_median(s, keys, "y", "med")
    return s.join(m, keys).groupBy(*keys).agg((F.avg(F.abs(F.col("y") - F.col("med"))) / 0.6745).alias("a"), F.count(F.lit(1)).alias("c")).select(*keys, F.when(F.col("c") < 2, EPSILON).otherwise(F.col("a")).alias("sigma"))


def _at(a: Column, part: Column) -> Column:
    return F.element_at(a, (F.floor(part) + 1).cast("int"))


def _quartile_sigma(a: Column) -> Column:
    n = F.size(a)
    return F.abs(_at(a, 0.25 * n) - _at(a, 0.75 * n)) / IQR


def block_sigmas(s: DataFrame, keys: list[str], block: int, overlap: int, refine: int = 0) -> DataFrame:
    """keys, block, sigma: quartile sigma of each block, then `refine` times again on what lies within three sigma of the
    block's median. A block left with fewer than four values falls back to its first sigma."""
    parts = with_blocks(s, block, block - overlap, partial=True)
    b = parts.groupBy(*keys, "block").agg(F.sort_array(F.collect_list("y"), asc=False).alias("a"))
    first = F.when(F.size("a") < 4, EPSILON).otherwise(F.greatest(_quartile_sigma(F.col("a")), F.lit(EPSILON)))
    b = b.withColumn("first", first).withColumn("sigma", F.col("first")).withColumn("ok", F.size("a") >= 4)
    for _ in range(refine):
        b = b.withColumn("mid", F.when(F.col("ok"), _at(F.col("a"), F.size("a") / 2)))
        b = b.withColumn("a", F.when(F.col("ok"), F.filter("a", lambda x: F.abs(x - F.col("mid")) < 3.0 * F.col("sigma"))).otherwise(F.col("a")))
        b = b.withColumn("ok", F.col("ok") & (F.size("a") >= 4))
        b = b.withColumn("new", F.when(F.col("ok"), _quartile_sigma(F.col("a"))))
        b = b.withColumn("sigma", F.when(~F.col("ok"), F.col("first")).when(F.col("new") > EPSILON, F.col("new")).otherwise(F.col("sigma")))
    return b.select(*keys, "block", "sigma")


def scale_sizes(p: Noise) -> list[int]:
    """Block sizes 8, 32, 128, the first and last replaced by the least and most; neighbours overlap by half."""
    sizes = [8, 32, 128][: p.scales]
    sizes[0] = p.min_block
    if p.scales > 1:
        sizes[-1] = p.max_block
    return sizes


def _refined(a: Column, refine: int) -> Column:
    """The sigma of a block sorted in falling order, refined as in `block_sigmas`, as one expression."""
    first = F.when(F.size(a) < 4, EPSILON).otherwise(F.greatest(_quartile_sigma(a), F.lit(EPSILON)))
    state = F.struct(a.alias("a"), first.alias("sigma"), (F.size(a) >= 4).alias("ok"))

    def step(s: Column, first: Column) -> Column:
        mid = _at(s["a"], F.size(s["a"]) / 2)
        kept = F.when(s["ok"], F.filter(s["a"], lambda x: F.abs(x - mid) < 3.0 * s["sigma"])).otherwise(s["a"])
        return F.transform(F.array(kept), lambda k: F.struct(k.alias("a"), _next(s, k, first).alias("sigma"), (s["ok"] & (F.size(k) >= 4)).alias("ok")))[0]

    def _next(s: Column, k: Column, first: Column) -> Column:
        new = F.when(F.size(k) >= 4, _quartile_sigma(k))
        return F.when(~s["ok"] | (F.size(k) < 4), first).when(new > EPSILON, new).otherwise(s["sigma"])

    return F.transform(F.array(state), lambda s: F.aggregate(F.sequence(F.lit(1), F.lit(refine)), s, lambda acc, _: step(acc, s["sigma"]))["sigma"])[0] if refine else first


def _with_scale(scale: Column):
    return lambda block: F.struct(scale, block.alias("block"))


def multiscale_sigma(s: DataFrame, keys: list[str], p: Noise | None = None) -> DataFrame:
    """keys, sigma: blocks weigh 1/(sigma**2 + 1e-9) in a scale, scales 1/(sigma + 1e-9); series below four samples get 1e-9.

    Blocks longer than a series are cut to it. A sample goes to the blocks of all scales at once, numbered by (scale, block),
    so the samples are read and grouped once."""
    p = (p or Noise()).validate()
    if p.fixed_sigma is not None:
        return s.select(*keys).distinct().withColumn("sigma", F.lit(float(p.fixed_sigma)))
    places = []
    for k, size in enumerate(scale_sizes(p)):
        hop = size - size // 2
        last = F.greatest(F.floor((F.col("n") - size + hop) / hop), F.lit(1)) - 1
        low, high = F.greatest(F.lit(0).cast("long"), F.floor((F.col("i") - size) / hop) + 1), F.least(last, F.floor(F.col("i") / hop)).cast("long")
        blocks = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
        scale = F.lit(k).alias("scale")
        places.append(F.transform(blocks, _with_scale(scale)))
    dealt = s.where("n >= 4").select(*keys, "y", F.explode(F.concat(*places)).alias("at")).select(*keys, "at.scale", "at.block", "y")
    b = dealt.groupBy(*keys, "scale", "block").agg(F.sort_array(F.collect_list("y"), asc=False).alias("a")).select(*keys, "scale", _refined(F.col("a"), p.refine).alias("sigma"))
    w = 1 / (F.col("sigma") * F.col("sigma") + EPSILON)
    every = b.groupBy(*keys, "scale").agg(F.greatest(F.sum(w * F.col("sigma")) / F.sum(w), F.lit(EPSILON)).alias("sigma"))
    w = 1 / (F.col("sigma") + EPSILON)
    joined = every.groupBy(*keys).agg(((EPSILON + F.sum(F.col("sigma") * w)) / F.sum(w)).alias("sigma"))
    short = s.where("n < 4").select(*keys).distinct().withColumn("sigma", F.lit(EPSILON))
    return joined.select(*keys, F.greatest("sigma", F.lit(EPSILON)).alias("sigma")).unionByName(short)


def array_sigmas(y: np.ndarray, p: Noise) -> np.ndarray:
    """`multiscale_sigma` of each row of y, a series of its own, without leaving the batch."""
    m, n = y.shape
    if p.fixed_sigma is not None:
        return np.full(m, float(p.fixed_sigma))
    if n < 4:
        return np.full(m, EPSILON)
    scales = []
    for size in scale_sizes(p):
        hop, width = size - size // 2, min(size, n)
        starts = np.arange(max(1, (n - size + hop) // hop)) * hop
        blocks = -np.sort(-y[:, starts[:, None] + np.arange(width)], axis=2).reshape(-1, width)
        sigma = _sorted_sigmas(blocks, p.refine).reshape(m, -1)
        w = 1 / (sigma * sigma + EPSILON)
        scales.append(np.maximum((w * sigma).sum(1) / w.sum(1), EPSILON))
    sigma = np.stack(scales, 1)
    w = 1 / (sigma + EPSILON)
    return np.maximum((EPSILON + (sigma * w).sum(1)) / w.sum(1), EPSILON)


def _sorted_sigmas(a: np.ndarray, refine: int) -> np.ndarray:
    """Refined quartile sigmas of rows in falling order. What is near a row's median is a stretch of it, so a step only moves
    where the stretch begins and ends."""
    rows, width = a.shape
    k = np.arange(width)
    begin, count = np.zeros(rows, int), np.full(rows, width)
    at = lambda part: a[np.arange(rows), np.minimum(begin + np.floor(part * count).astype(int), width - 1)]
    quartiles = lambda: np.abs(at(0.25) - at(0.75)) / IQR
    ok = count >= 4
    first = np.where(ok, np.maximum(quartiles(), EPSILON), EPSILON)
    sigma = first.copy()
    for _ in range(refine):
        inside = (np.abs(a - at(0.5)[:, None]) < 3.0 * sigma[:, None]) & (k >= begin[:, None]) & (k < (begin + count)[:, None])
        begin, count = np.where(ok, inside.argmax(1), begin), np.where(ok, inside.sum(1), count)
        ok = ok & (count >= 4)
        new = quartiles()
        sigma = np.where(ok, np.where(new > EPSILON, new, sigma), first)
    return sigma


def floored_sigma(s: DataFrame, keys: list[str], p: Noise | None = None) -> DataFrame:
    """The multi-scale sigma, at least a hundredth of the population standard deviation, at least 1e-9."""
    spread = s.groupBy(*keys).agg(F.stddev_pop("y").alias("sd"))
    return multiscale_sigma(s, keys, p).join(spread, keys).select(*keys, F.greatest("sigma", 0.01 * F.col("sd"), F.lit(EPSILON)).alias("sigma"))


def flatness(psd: DataFrame, keys: list[str]) -> DataFrame:
    """Spectral flatness of a PSD, geometric over arithmetic mean: near 1 for white, near 0 for coloured noise."""
    p = clean("psd") + 1e-300
    return psd.groupBy(*keys).agg((F.exp(F.avg(F.log(p))) / F.avg(p)).alias("flatness"))


def is_coloured(psd: DataFrame, keys: list[str], least: float = 0.3) -> DataFrame:
    """keys, flatness, coloured (flatness below `least`), confidence (how far below, from 0 to 1)."""
    f = flatness(psd, keys)
    return f.withColumn("coloured", F.col("flatness") < least).withColumn("confidence", F.greatest(F.lit(0.0), 1 - F.col("flatness") / least))
