"""The default atom set and dictionaries built from specs. Everything here is a value: no global state, any frame size."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import lru_cache
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from sigloom.functions import atoms as A

PARAMETERS = ["alpha", "beta", "f", "f0", "gamma", "k", "mu", "order", "position", "scale", "sigma", "t0", "t1", "up", "w", "theta"]
SPEC_SCHEMA = "atom_index int, atom_type string, is_pair boolean, use_sin boolean, " + ", ".join(f"{p} double" for p in PARAMETERS)

#: The default parameter grids, outer parameter first; `pair` families have a sine and a cosine each.
GRIDS: list[tuple[str, bool, dict[str, list[float]]]] = [
    ("CHIRP", True, {"f0": [0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.7], "beta": [-0.005, -0.001, 0.0, 0.001, 0.005]}),
    ("MORLET", True, {"sigma": [0.03, 0.07, 0.15], "mu": [0.2, 0.4, 0.6, 0.8], "w": [10.0, 18.0, 26.0]}),
    ("DAMPED", True, {"alpha": [0.05, 0.15, 0.3, 0.6, 1.2], "f0": [0.03, 0.06, 0.12, 0.25]}),
    ("BSPLINE", False, {"scale": [0.05, 0.1, 0.2, 0.4], "position": [0.1, 0.25, 0.4, 0.55, 0.7, 0.85], "order": [3.0]}),
    ("ANTI_DAMPED", True, {"alpha": [0.05, 0.15, 0.3], "f0": [0.05, 0.1, 0.2]}),
    ("SIGMOID", False, {"k": [5.0, 10.0, 20.0], "t0": [0.2, 0.5, 0.8], "up": [1.0, 0.0]}),
    ("CHEBYSHEV", False, {"order": [1.0, 2.0, 3.0, 4.0, 5.0]}),
    ("DOUBLE_SIGMOID", False, {"k": [5.0, 10.0, 20.0], "t0": [0.2, 0.4, 0.6, 0.8], "t1": [0.3, 0.5, 0.7, 0.9]}),
    ("GAUSSIAN", False, {"mu": [0.1, 0.3, 0.5, 0.7, 0.9], "sigma": [0.03, 0.06, 0.1, 0.15, 0.2]}),
    ("ERF", False, {"mu": [0.2, 0.4, 0.6, 0.8], "sigma": [0.05, 0.1, 0.2, 0.3]}),
    ("DAMPED_CHIRP", True, {"alpha": [0.1, 0.5, 1.0, 2.0], "f0": [0.01, 0.05, 0.1, 0.2, 0.4], "beta": [-0.01, -0.005, 0.0, 0.005, 0.01]}),
    ("SIGMOID_OSC", True, {"k": [5.0, 10.0, 20.0], "t0": [0.2, 0.5, 0.8], "f": [0.05, 0.1, 0.2, 0.3]}),
    ("EXP_GROWTH", False, {"alpha": [0.1, 0.5, 1.0, 2.0]}),
    ("EXP_DECAY", False, {"alpha": [0.1, 0.5, 1.0, 2.0, 5.0]}),
    ("TANH", False, {"k": [5.0, 10.0, 20.0, 50.0], "t0": [0.2, 0.5, 0.8]}),
    ("LORENTZIAN", False, {"mu": [0.2, 0.4, 0.6, 0.8], "gamma": [0.02, 0.05, 0.1, 0.15]}),
    ("POWER", False, {"alpha": [-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0]}),
    ("HAAR", False, {}),
    ("BESSEL", False, {"order": [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]}),
]


@dataclass(frozen=True)
class Spec:
    index: int
    kind: str
    pair: bool
    params: tuple[tuple[str, float], ...]
    vector: tuple[float, ...] | None = field(default=None, repr=False)  # of a learned atom

    @property
    def use_sin(self) -> bool:
        return not self.pair or self.index % 2 == 0

    @property
    def label(self) -> str:
        return " ".join(f"{k}={v:g}" for k, v in self.params)


@lru_cache(maxsize=2)
def default_specs(aliased: bool = False) -> tuple[Spec, ...]:
    """641 atoms in their fixed order. `aliased` reproduces two families whose first parameter is overwritten by the
    frequency."""
    specs: list[Spec] = []
    for kind, pair, grid in GRIDS:
        for values in product(*grid.values()):
            p = dict(zip(grid, values, strict=True))
            if kind == "DOUBLE_SIGMOID" and p["t1"] <= p["t0"]:
                continue
            if aliased and kind == "DAMPED_CHIRP":
                p["alpha"] = p["f0"]
            if aliased and kind == "SIGMOID_OSC":
                p["k"] = p["f"]
            specs += [Spec(len(specs) + m, kind, pair, tuple(p.items())) for m in range(1 + pair)]
    return tuple(specs)


def retuned(specs: tuple[Spec, ...], frequency: float, cycles: bool = True) -> tuple[Spec, ...]:
    """Specs with their frequency set to the dominant one wherever that changes it by more than a tenth.

    `frequency` is in cycles per unit of t; a Morlet carrier follows as 2 pi times it, within 5..80."""
    chirp = min(max(frequency, 0.001), 0.49)
    carrier = min(max(2 * np.pi * frequency if cycles else frequency, 5.0), 80.0)
    to = {"CHIRP": ("f0", chirp), "DAMPED_CHIRP": ("f0", chirp), "SIGMOID_OSC": ("f", chirp), "MORLET": ("w", carrier)}
    out = []
    for s in specs:
        if s.kind in to:
            name, new = to[s.kind]
            old = dict(s.params)[name]
            if abs(new - old) / (old + 1e-12) > 0.1:
                s = replace(s, params=tuple((k, new if k == name else v) for k, v in s.params))
        out.append(s)
    return tuple(out)


@dataclass(frozen=True)
class Dictionary:
    atoms: np.ndarray  # one row an atom, unit length
    norms: np.ndarray
    specs: tuple[Spec, ...]

    @property
    def gram(self) -> np.ndarray:
        return self.atoms @ self.atoms.T


@lru_cache(maxsize=8)
def build(specs: tuple[Spec, ...], frame_size: int, two_term_bessel: bool = False) -> Dictionary:
    """Normalised atoms for a frame size; kept for the eight latest (specs, size) pairs."""
    rows = [A.normalised(np.array(s.vector) if s.kind == "LEARNED" and s.vector else A.raw_atom(s.kind, dict(s.params), frame_size, s.use_sin, two_term_bessel)) for s in specs]
    atoms = np.array([r[0] for r in rows]).reshape(-1, frame_size)
    if not np.isfinite(atoms).all():
        raise ValueError("the dictionary holds values that are not finite")
    return Dictionary(atoms, np.array([r[1] for r in rows]), specs)


def learned_specs(atoms: np.ndarray) -> tuple[Spec, ...]:
    return tuple(Spec(k, "LEARNED", False, (), tuple(map(float, a))) for k, a in enumerate(atoms))


def specs_frame(spark: SparkSession, specs: tuple[Spec, ...]) -> DataFrame:
    rows = [(s.index, s.kind, s.pair, s.use_sin, *(dict(s.params).get(p) for p in PARAMETERS)) for s in specs]
    return spark.createDataFrame(rows, SPEC_SCHEMA)


def dictionary_frame(spark: SparkSession, d: Dictionary) -> DataFrame:
    """atom_index, atom_type, norm and atom, one row an atom."""
    rows = [(s.index, s.kind, float(n), [float(v) for v in a]) for s, n, a in zip(d.specs, d.norms, d.atoms, strict=True)]
    return spark.createDataFrame(rows, "atom_index int, atom_type string, norm double, atom array<double>")


def subset(d: Dictionary, indices: list[int]) -> Dictionary:
    return Dictionary(d.atoms[indices], d.norms[indices], tuple(d.specs[i] for i in indices))
