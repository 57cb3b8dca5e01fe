"""Coherence-penalised greedy pursuit of frames over a dictionary.

A pick maximises E = p**2 / (1 + alpha C): p is the atom's projection on the residual, C the sum of its absolute inner products
with the atoms picked so far (repeats count again). It takes p / (1 + alpha C) of the atom from the residual. With the Gram
matrix at hand a pick costs one row of it. Ties go to the lowest index. It stops when E < gamma sigma**2, and from the second
pick on when the residual's relative decrease fell below theta sigma**2, which is not scale-free.

Frames are rows, so nothing is shuffled; the dictionary (its size depends on atoms and frame size only) goes to each task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sigloom.config import Frequency, Noise, Pursuit
from sigloom.plans.dictionary import Dictionary, build, retuned

from .frequency import array_dominant
from .noise import array_sigmas

EVENT = "pick long, atom_index int, atom_type string, atom_params string, amplitude double, phase double, energy double"
_REFRESH = 8
#: Frames that take their picks together.
_TOGETHER = 256


def pursue_many(y: np.ndarray, d: np.ndarray, gram: np.ndarray, sigma: np.ndarray, p: Pursuit) -> tuple[list[list[tuple[int, float, float]]], np.ndarray]:
    """Picks (atom, amplitude, energy) of each row of y, and what is left of the rows. All rows take a pick at a time."""
    y, floor = np.asarray(y, dtype=float), np.asarray(sigma, dtype=float) ** 2
    residual, coherence = y.copy(), np.zeros((len(y), len(d)))
    projection, overlap = residual @ d.T, np.abs(gram)
    picks: list[list[tuple[int, float, float]]] = [[] for _ in y]
    before, alive = np.zeros(len(y)), np.arange(len(y)) if len(d) else np.zeros(0, int)
    for k in range(p.max_iterations or 1000):
        energy = projection[alive] ** 2 / (1 + p.alpha * coherence[alive])
        best = energy.argmax(1) if alive.size else alive
        energy = energy[np.arange(len(alive)), best]
        now = (residual[alive] ** 2).sum(1)
        goes = (energy >= p.gamma * floor[alive]) & (energy != 0)
        if k:
            goes &= ~(1 - now / (before[alive] + 1e-30) < p.theta * floor[alive])
        alive, best, energy = alive[goes], best[goes], energy[goes]
        if not alive.size:
            break
        before[alive] = now[goes]
        amount = projection[alive, best] / (1 + p.alpha * coherence[alive, best])
        residual[alive] -= amount[:, None] * d[best]
        projection[alive] = projection[alive] - amount[:, None] * gram[best] if (k + 1) % _REFRESH else residual[alive] @ d.T
        coherence[alive] += overlap[best]
        for r, *pick in zip(alive.tolist(), best.tolist(), amount.tolist(), energy.tolist(), strict=True):
            picks[r].append(tuple(pick))
    if p.refit:
        for r, found in enumerate(picks):
            if found:
                chosen = sorted({a for a, _, _ in found})
                x = np.linalg.solve(gram[np.ix_(chosen, chosen)] + p.gamma_global * np.eye(len(chosen)), d[chosen] @ y[r])
                energies = {a: e for a, _, e in reversed(found)}
                picks[r] = [(a, float(v), energies[a]) for a, v in zip(chosen, x, strict=True)]
                residual[r] = y[r] - x @ d[chosen]
    return picks, residual


def pursue(y: np.ndarray, d: np.ndarray, gram: np.ndarray, sigma: float, p: Pursuit) -> tuple[list[tuple[int, float, float]], np.ndarray]:
    """`pursue_many` of one frame."""
    picks, residual = pursue_many(np.asarray(y, dtype=float)[None], d, gram, np.array([sigma]), p)
    return picks[0], residual[0]


def events_of(picks: list[tuple[int, float, float]], d: Dictionary) -> list[tuple]:
    """EVENT rows; the phase is known where both members of a sine-cosine pair were picked."""
    sums: dict[int, float] = {}
    for a, v, _ in picks:
        sums[a] = sums.get(a, 0.0) + v
    rows = []
    for k, (a, v, e) in enumerate(picks):
        s = d.specs[a]
        partner = next((j for j in (a - 1, a + 1) if s.pair and 0 <= j < len(d.specs) and d.specs[j].params == s.params and d.specs[j].kind == s.kind and d.specs[j].use_sin != s.use_sin), None)
        phase = 0.0
        if partner in sums:
            phase = math.atan2(sums[partner], sums[a]) if s.use_sin else math.atan2(sums[a], sums[partner])
        rows.append((k, s.index, s.kind, s.label, v, phase, e))
    return rows


def _mapped(f: DataFrame, columns: list[str], ddl: str, one, d: Dictionary, p: Pursuit, tune: Frequency | None = None, noise: Noise | None = None) -> DataFrame:
    """`one(picks, residual, dictionary)` gives rows for a frame. f has columns and y, and sigma unless `noise` says how to find
    it. With `tune`, a frame's dictionary follows its `frequency`, which is found in the frame if f has no such column."""
    schema = StructType([*f.select(*columns).schema.fields, *StructType.fromDDL(ddl).fields])
    arrow, width = to_arrow_schema(schema), len(columns)
    specs, given = d.specs, [c for c in ("sigma", "frequency") if c in f.columns and (c == "frequency" if noise else c == "sigma" or tune)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Dictionary, np.ndarray]] = {}
        base = (d, d.gram)

        def dictionary_of(size: int, w: float | None) -> tuple[Dictionary, np.ndarray]:
            if w is None and size == d.atoms.shape[1]:
                return base
            if (size, w) not in held:
                if len(held) > 16:
                    held.clear()
                made = build(retuned(specs, w) if w else specs, size)
                held[size, w] = (made, made.gram)
            return held[size, w]

        for b in batches:
            ys, out = b.column(width).to_pylist(), []
            extra = dict(zip(given, (np.array(b.column(width + 1 + k).to_pylist(), dtype=float) for k in range(len(given))), strict=True))
            sizes = np.array([len(y) for y in ys], dtype=int)
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                y = np.array([ys[r] for r in rows.tolist()], dtype=float)
                sigma = array_sigmas(y, noise) if noise else extra["sigma"][rows]
                w = None
                if tune:
                    w = np.round(extra["frequency"][rows] if "frequency" in extra else array_dominant(y, tune), 4)
                for v in [None] if w is None else np.unique(w).tolist():
                    own = np.arange(len(rows)) if v is None else np.flatnonzero(w == v)
                    used, gram = dictionary_of(size, v)
                    for at in range(0, len(own), _TOGETHER):
                        part = own[at : at + _TOGETHER]
                        picks, residual = pursue_many(y[part], used.atoms, gram, sigma[part], p)
                        out += [(rows[r], row) for r, found, left in zip(part.tolist(), picks, residual, strict=True) for row in one(found, left, used)]
            heads = pa.array([int(r) for r, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(heads) for i in range(width)), *(pa.array([row[i] for _, row in out], arrow[width + i].type) for i in range(len(arrow) - width))], schema=arrow)

    return f.select(*columns, "y", *given).where(F.size("y") >= 2).mapInArrow(run, schema)


def pursue_frames(f: DataFrame, columns: list[str], d: Dictionary, p: Pursuit | None = None, tune: Frequency | None = None, noise: Noise | None = None) -> DataFrame:
    """Events of frames (columns, y, sigma): columns and EVENT. With `noise`, sigma is found in each frame, in the same pass;
    with `tune`, each frame has its own retuned dictionary. Frames of another length get a dictionary of their size."""
    return _mapped(f, columns, EVENT, lambda picks, _, used: events_of(picks, used), d, (p or Pursuit()).validate(), tune, noise)


def residuals(f: DataFrame, columns: list[str], d: Dictionary, p: Pursuit | None = None, noise: Noise | None = None) -> DataFrame:
    """columns, picks, residual (array), energy: what pursuit leaves of each frame."""
    return _mapped(f, columns, "picks long, residual array<double>, energy double", lambda picks, r, _: [(len(picks), r.tolist(), float(r @ r))], d, (p or Pursuit()).validate(), None, noise)


def projections(f: DataFrame, columns: list[str], d: Dictionary) -> DataFrame:
    """columns, atom_index, p: inner product of each frame with each atom, as a matrix product a batch."""
    schema = StructType([*f.select(*columns).schema.fields, *StructType.fromDDL("p array<double>").fields])
    width, atoms = len(columns), d.atoms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(width).flatten().to_numpy(zero_copy_only=False).reshape(-1, atoms.shape[1]).astype(float)
            p = y @ atoms.T
            offsets = pa.array(np.arange(0, p.size + 1, max(1, len(atoms)), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.ListArray.from_arrays(offsets, pa.array(p.ravel()))], names=schema.names)

    index = F.array(*(F.lit(s.index) for s in d.specs))
    return f.select(*columns, "y").mapInArrow(run, schema).select(*columns, F.posexplode("p").alias("k", "p")).select(*columns, F.element_at(index, F.col("k") + 1).alias("atom_index"), "p")


def coherence(d: Dictionary, selected: list[int]) -> np.ndarray:
    """Per atom the sum of absolute inner products with the selected ones."""
    return np.abs(d.atoms @ d.atoms[selected].T).sum(1)
