"""Atom families in closed form over t = i / (n - 1), as NumPy vectors; a dictionary is small and built once a session."""

from __future__ import annotations

import math

import numpy as np

#: The order of atom types is their wire code.
TYPES = ["QUASI", "CHIRP", "MORLET", "DAMPED", "STEP", "BSPLINE", "ANTI_DAMPED", "SIGMOID", "LEARNED", "CHEBYSHEV", "DOUBLE_SIGMOID",
         "GAUSSIAN", "ERF", "DAMPED_CHIRP", "SIGMOID_OSC", "EXP_GROWTH", "EXP_DECAY", "TANH", "LORENTZIAN", "POWER", "HAAR", "BESSEL"]
#: What parameters are clamped to when an atom is built.
BOUNDS = {
    "CHIRP": {"f0": (0.001, 0.49), "beta": (-0.01, 0.01)},
    "MORLET": {"sigma": (0.001, 0.5), "mu": (0.0, 1.0), "w": (1.0, 50.0)},
    "DAMPED": {"alpha": (0.0, 5.0), "f0": (0.001, 0.49)},
    "ANTI_DAMPED": {"alpha": (0.0, 5.0), "f0": (0.001, 0.49)},
    "QUASI": {"theta": (-10.0, 10.0)},
    "STEP": {"position": (0.0, 1.0)},
    "BSPLINE": {"scale": (0.01, 2.0), "position": (0.0, 1.0)},
    "SIGMOID": {"k": (0.1, 50.0), "t0": (0.0, 1.0)},
    "CHEBYSHEV": {"order": (1, 5)},
    "BESSEL": {"order": (0, 5)},
}
_TABLE = 1024


def clamp(x: float, low: float, high: float) -> float:
    return (low + high) / 2 if math.isnan(x) else min(max(x, low), high)


def spline_table(order: int) -> np.ndarray:
    u = np.arange(_TABLE) / (_TABLE - 1)
    if order == 1:
        return np.where(u < 0.5, 2 * u, 2 * (1 - u))
    if order == 2:
        x = 2 * u
        return np.where(x < 1, 0.5 * x * x, np.where(x < 2, 0.5 * (2 - x) ** 2, 0.0))
    x = np.abs(4 * u - 2)
    return np.where(x < 1, 2 / 3 - x * x + 0.5 * x**3, np.where(x < 2, (2 - x) ** 3 / 6, 0.0))


def _spline(t: np.ndarray, scale: float, position: float, order: int) -> np.ndarray:
    at = (t - position) / scale * (_TABLE - 1)
    low = np.floor(at).astype(int)
    inside = (low >= 0) & (low + 1 < _TABLE)
    low, table = np.where(inside, low, 0), spline_table(order)
    part = at - low
    return np.where(inside, (1 - part) * table[low] + part * table[low + 1], 0.0)


def _bessel(order: int, x: np.ndarray, two_terms: bool) -> np.ndarray:
    term = (x / 2) ** order / math.factorial(order)
    total = term.copy()
    for k in range(1, 2 if two_terms else 40):
        term = term * -((x / 2) ** 2) / (k * (k + order))
        total += term
    return total


def _logistic(t: np.ndarray, k: float, t0: float) -> np.ndarray:
    return 1 / (1 + np.exp(-k * (t - t0)))


def _erf(x: np.ndarray) -> np.ndarray:
    s = x * x
    return np.sign(x) * np.sqrt(1 - np.exp(-s * (4 / math.pi + 0.147 * s) / (1 + 0.147 * s)))


def raw_atom(kind: str, params: dict[str, float], n: int, use_sin: bool = True, two_term_bessel: bool = False) -> np.ndarray:
    """An atom before normalisation. Unknown types raise."""
    if n < 2:
        raise ValueError("atoms need at least two samples")
    p = {k: clamp(v, *BOUNDS[kind][k]) if k in BOUNDS.get(kind, {}) else v for k, v in params.items() if v is not None}
    i = np.arange(n)
    t = i / (n - 1)
    wave = np.sin if use_sin else np.cos
    match kind:
        case "CHIRP":
            return wave(2 * np.pi * (p["f0"] * t + p["beta"] * t * t))
        case "MORLET":
            return np.exp(-(((t - p["mu"]) / p["sigma"]) ** 2) / 2) * wave(2 * np.pi * p["w"] * (t - p["mu"]))
        case "DAMPED":
            return np.exp(-p["alpha"] * t) * wave(2 * np.pi * p["f0"] * t)
        case "ANTI_DAMPED":
            return np.exp(p["alpha"] * t) * wave(2 * np.pi * p["f0"] * t)
        case "QUASI":
            return wave(2 * np.pi * p["theta"] ** p.get("k", 1) * i / n)
        case "STEP":
            return (t >= p["position"]).astype(float)
        case "BSPLINE":
            return _spline(t, p["scale"], p["position"], int(p.get("order", 3)) if p.get("order", 3) in (1, 2) else 3)
        case "SIGMOID":
            up = _logistic(t, p["k"], p["t0"])
            return up if p.get("up", 1) else 1 - up
        case "CHEBYSHEV":
            return np.polynomial.chebyshev.chebval(2 * t - 1, [0] * int(p["order"]) + [1])
        case "DOUBLE_SIGMOID":
            return _logistic(t, p["k"], p["t0"]) - _logistic(t, p["k"], p["t1"])
        case "GAUSSIAN":
            return np.exp(-(((t - p["mu"]) / p["sigma"]) ** 2) / 2)
        case "ERF":
            return 0.5 * (1 + _erf((t - p["mu"]) / (p["sigma"] * math.sqrt(2))))
        case "DAMPED_CHIRP":
            return np.exp(-p["alpha"] * t) * wave(2 * np.pi * (p["f0"] * t + 0.5 * p["beta"] * t * t))
        case "SIGMOID_OSC":
            return _logistic(t, p["k"], p["t0"]) * wave(2 * np.pi * p["f"] * t)
        case "EXP_GROWTH":
            return np.exp(p["alpha"] * t)
        case "EXP_DECAY":
            return np.exp(-p["alpha"] * t)
        case "TANH":
            return np.tanh(p["k"] * (t - p["t0"]))
        case "LORENTZIAN":
            return p["gamma"] / ((t - p["mu"]) ** 2 + p["gamma"] ** 2)
        case "POWER":
            return np.maximum(t, 1e-12) ** p["alpha"]
        case "HAAR":
            return np.where(t < 0.5, 1.0, -1.0)
        case "BESSEL":
            return _bessel(int(p["order"]), 20 * t, two_term_bessel)
    raise ValueError(f"no atom of type {kind}")


def normalised(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit length and the length before; a degenerate vector becomes the unit impulse with norm 1."""
    x = np.where(np.isfinite(x), x, 0.0)
    s = float(x @ x)
    if not s >= 1e-12:
        return np.eye(1, len(x))[0], 1.0
    return x / math.sqrt(s), math.sqrt(s)
