"""Whole decompositions: samples or ticks to events and coefficients."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.config import Config
from sigloom.operators import bars, basis, detrend, learning, pursuit, series
from sigloom.session import written

from .dictionary import Dictionary, build, default_specs, learned_specs


def decompose(s: DataFrame, keys: list[str], cfg: Config | None = None, dictionary: Dictionary | None = None) -> DataFrame:
    """Events of indexed samples: keys, frame_start and pursuit.EVENT.

    Each frame is a series of its own for the noise estimator, which reads the unmodified frame, so on strong signals it is an
    upper estimate. Noise, frequency and pursuit take a frame in one pass; nothing is shuffled once frames are gathered."""
    cfg = (cfg or Config()).validate()
    if cfg.detrend.enable:
        s = detrend.detrended(s, keys, cfg.detrend).withColumn("y", F.col("residual")).join(s.select(*keys, "i", "n"), [*keys, "i"])
    f = series.frames(s, keys, cfg.frame_size, cfg.hop)
    if cfg.learning.enable:
        dictionary = trained(s, keys, cfg)
    d = dictionary or build(default_specs(), cfg.frame_size)
    return pursuit.pursue_frames(f, [*keys, "frame_start"], d, cfg.pursuit, cfg.frequency if cfg.frequency.enable else None, cfg.noise)


def trained(s: DataFrame, keys: list[str], cfg: Config, atoms: int = 0, start: np.ndarray | None = None) -> Dictionary:
    """A dictionary learnt from the samples' frames at the learning hop. Fewer than two frames' worth of samples, or no whole
    frame, leave the start as it is. `atoms` is the frame size where not given; `start` is noise with a fixed seed."""
    p, size = cfg.learning, cfg.frame_size
    begin = learning.initial_atoms(atoms or size, size) if start is None else start
    f = written(series.frames(s.where(F.col("n") >= 2 * size), keys, size, p.hop).select("y"), "learning-frames")
    found, _ = learning.learn(f, begin, p)
    return Dictionary(found, np.ones(len(found)), learned_specs(found))


def coefficients(s: DataFrame, keys: list[str], cfg: Config | None = None) -> DataFrame:
    """keys, frame_start, coeff: projections of whole frames on the orthonormalised basis. With the frequency scan, a frame's
    harmonics follow its dominant frequency."""
    cfg = (cfg or Config()).validate()
    tune = cfg.frequency if cfg.frequency.enable else None
    return basis.coefficients(series.frames(s, keys, cfg.frame_size, cfg.hop), [*keys, "frame_start"], cfg.frame_size, cfg.basis, tune)


def bar_samples(ticks: DataFrame, keys: list[str], order: list[str], cfg: Config | None = None) -> DataFrame:
    """Closing prices of volume bars as samples."""
    cfg = (cfg or Config()).validate()
    return series.samples(bars.volume_bars(ticks, keys, order, cfg.bars), keys, ["bar_idx"], "close")


def decompose_ticks(ticks: DataFrame, keys: list[str], order: list[str], cfg: Config | None = None) -> DataFrame:
    """Events of volume bars; series with too few bars for a frame give none."""
    cfg = (cfg or Config()).validate()
    s = bar_samples(ticks, keys, order, cfg)
    return decompose(s.where(F.col("n") >= cfg.frame_size), keys, cfg)


def events_json(events: DataFrame, keys: list[str]) -> DataFrame:
    """A JSON text a series: num_events and events in frame and pick order, as a document for export."""
    fields = ["frame_start", "pick", "atom_index", "atom_type", "atom_params", F.abs("amplitude").alias("amplitude"), "phase", "energy"]
    gathered = F.array_sort(F.collect_list(F.struct(*fields)))
    return events.groupBy(*keys).agg(gathered.alias("e")).select(*keys, F.to_json(F.struct(F.size("e").alias("num_events"), F.col("e").alias("events"))).alias("json"))
