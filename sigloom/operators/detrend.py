"""Trends: recursive least squares along a series, and piecewise polynomials with robust weights."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.config import Detrend

from .series import folded


def rls_start(p: int) -> dict:
    return {"theta": np.zeros(p), "P": 1e6 * np.eye(p)}


def rls_step(state: dict, x: np.ndarray, y: float, forgetting: float) -> float:
    """One sample; returns the error of the prediction made before it. Values that are not finite count as 0."""
    e = y - float(state["theta"] @ x)
    if not np.isfinite(e):
        return 0.0
    s = state["P"] @ x
    d = forgetting + float(x @ s)
    k = s / (d if np.isfinite(d) and abs(d) >= 1e-30 else 1e-6)
    state["theta"] = np.nan_to_num(state["theta"] + k * e, nan=0.0, posinf=0.0, neginf=0.0)
    state["P"] = np.nan_to_num(np.minimum((state["P"] - np.outer(k, s)) / forgetting, 1e9), nan=0.0, posinf=0.0, neginf=0.0)
    return e


def rls(s: DataFrame, keys: list[str], order: int = 1, p: Detrend | None = None, scale: float = 100.0) -> DataFrame:
    """keys, i, y, trend, residual: the trend is predicted from earlier samples; regressors are powers of i / scale."""
    p = (p or Detrend()).validate()

    def step(state: dict, row: tuple) -> list[tuple]:
        i, y = row
        e = rls_step(state, (i / scale) ** np.arange(order + 1), y, p.forgetting)
        return [(i, y, y - e, e)]

    return folded(s, keys, ["i"], ["i", "y"], "i long, y double, trend double, residual double", lambda _: rls_start(order + 1), step)


def huber_fit(y: np.ndarray, order: int, p: Detrend) -> tuple[np.ndarray, float]:
    """Polynomial coefficients in t = 0..1 by reweighted least squares, and the robust sum of squares."""
    x = np.vander(np.linspace(0, 1, len(y)), order + 1, increasing=True)
    w = np.ones(len(y))
    for _ in range(max(1, p.huber_iterations)):
        weighed = x.T * w
        try:
            c = np.linalg.solve(weighed @ x, weighed @ y)
        except np.linalg.LinAlgError:
            c = np.linalg.lstsq(x.T @ weighed.T, weighed @ y, rcond=None)[0]
        e = np.abs(y - x @ c)
        middle = np.partition(e, (k := len(e) // 2, k - (len(e) % 2 == 0)))
        limit = p.huber * ((middle[k] + middle[k - (len(e) % 2 == 0)]) / 2 / 0.6745 + 1e-30)
        before, w = w, np.where(e <= limit, 1.0, limit / (e + 1e-30))
        if np.abs(w - before).max() < 1e-9:
            break
    return c, float((w * e * e).sum())


def segment(y: np.ndarray, p: Detrend) -> list[tuple[int, int, int, np.ndarray, float]]:
    """(start, stop, order, coefficients, squares): split where the information criterion gains most, stop when none gains,
    then join neighbours whose common fit is no worse by an F ratio below `stitch`."""

    def best(a: int, b: int) -> tuple[float, int, np.ndarray, float]:
        n = b - a
        fits = []
        for order in range(min(p.max_order, n - 2) + 1):
            c, sse = huber_fit(y[a:b], order, p)
            fits.append((n * np.log(sse / n + 1e-30) + p.bic * (order + 1) * np.log(n), order, c, sse))
        return min(fits, key=lambda f: f[0])

    parts = [(0, len(y), best(0, len(y)))]
    while len(parts) < p.max_segments:
        gains = []
        for k, (a, b, whole) in enumerate(parts):
            for at in np.unique(np.linspace(a + p.min_length, b - p.min_length, 24).astype(int)) if b - a >= 2 * p.min_length else []:
                left, right = best(a, at), best(at, b)
                gains.append((whole[0] - left[0] - right[0] - p.bic * np.log(b - a), k, int(at)))
        if not gains or max(gains)[0] <= 0:
            break
        _, k, at = max(gains)
        a, b, _ = parts[k]
        width = (b - a) // 24
        while True:  # the places around the best, ever closer
            low, high = max(a + p.min_length, at - width), min(b - p.min_length, at + width)
            places = np.unique(np.linspace(low, high, 25).astype(int)).tolist()
            at = min(places, key=lambda m: sum(np.log(huber_fit(y[u:v], p.max_order, p)[1] / (v - u) + 1e-30) * (v - u) for u, v in ((a, m), (m, b))))
            if width <= 12:
                break
            width = -(-width // 12)
        parts[k : k + 1] = [(a, at, best(a, at)), (at, b, best(at, b))]
    k = 0
    while k + 1 < len(parts):
        (a, m, x), (_, b, z) = parts[k], parts[k + 1]
        both = best(a, b)
        spare = max(1, b - a - x[1] - z[1] - 2)
        if (both[3] - x[3] - z[3]) / (x[1] + 1) / ((x[3] + z[3]) / spare + 1e-30) < p.stitch:
            parts[k : k + 2] = [(a, b, both)]
        else:
            k += 1
    return [(a, b, f[1], f[2], f[3]) for a, b, f in parts]


def _whole(state: array, row: tuple) -> list[tuple]:
    state.append(np.nan if row[1] is None else row[1])
    return []


def piecewise(s: DataFrame, keys: list[str], p: Detrend | None = None) -> DataFrame:
    """keys, segment, start, stop, n, order, coefficients, sse. A series is segmented whole, so its task holds all its
    samples; one of fewer than 4 has no segment."""
    p = (p or Detrend()).validate()

    def finish(state: array) -> Iterator[tuple]:
        if len(state) >= 4:
            for k, (a, b, order, c, sse) in enumerate(segment(np.array(state), p)):
                yield (k, a, b, b - a, order, c.tolist(), sse)

    schema = "segment long, start long, stop long, n long, order int, coefficients array<double>, sse double"
    return folded(s, keys, ["i"], ["i", "y"], schema, lambda _: array("d"), _whole, finish)


def segment_stats(segments: DataFrame, keys: list[str]) -> DataFrame:
    """keys, segments, samples, sse, highest order and shortest segment: one row a series, to write as JSON or to watch."""
    return segments.groupBy(*keys).agg(F.count("*").alias("segments"), F.sum("n").alias("samples"), F.sum("sse").alias("sse"), F.max("order").alias("highest_order"), F.min("n").alias("shortest"))


def predicted(t: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    """The polynomial with coefficients from the constant on, at t in 0..1 of its segment, or beyond."""
    return np.polynomial.polynomial.polyval(t, coefficients)


def detrended(s: DataFrame, keys: list[str], p: Detrend | None = None) -> DataFrame:
    """keys, i, y, trend, residual; i counts from 0 without gaps. The trend is the piecewise fit, worked out by the fold that
    fitted it; samples of series too short to fit keep a trend of 0. With `causal`, it is predicted from earlier samples."""
    p = (p or Detrend()).validate()
    if p.causal:
        return rls(s, keys, p=p)

    def finish(state: array) -> Iterator[tuple]:
        y = np.array(state)
        parts = segment(y, p) if len(y) >= 4 else [(0, len(y), 0, np.zeros(1), 0.0)]
        for a, b, _, c, _ in parts:
            trend = predicted(np.arange(b - a) / max(1, b - a - 1), c)
            yield from zip(range(a, b), y[a:b].tolist(), trend.tolist(), (y[a:b] - trend).tolist(), strict=True)

    return folded(s, keys, ["i"], ["i", "y"], "i long, y double, trend double, residual double", lambda _: array("d"), _whole, finish)
