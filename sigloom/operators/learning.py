"""Dictionary learning by pursuit and gradient steps.

Per iteration one pass over the frames: each task pursues its frames and adds up, per atom, the products of coefficients and
residuals, which are summed place by place; the driver gets one number a place of an atom, whatever the number of frames. The
frames should be a written or cached table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.config import Learning, Pursuit
from sigloom.functions.atoms import normalised

from .pursuit import pursue


def initial_atoms(atoms: int, size: int, seed: int = 0) -> np.ndarray:
    x = np.random.default_rng(seed).standard_normal((atoms, size))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def gradient_sums(frames: DataFrame, atoms: np.ndarray, p: Pursuit, sigma: float, sum_repeats: bool = True) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Per atom the sums of x R and x**2 over all frames; the squared error; the number of frames."""
    gram = atoms @ atoms.T
    count, size = atoms.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xr, xx, error, n = np.zeros((count, size)), np.zeros(count), 0.0, 0
        for b in batches:
            for y in b.column(0).to_pylist():
                y = np.array(y, dtype=float)
                picks, _ = pursue(y, atoms, gram, sigma, p)
                x = np.zeros(count)
                for a, v, _ in picks:
                    x[a] = x[a] + v if sum_repeats else v
                r = y - x @ atoms
                used = np.abs(x) > 1e-12
                xr[used] += x[used, None] * r
                xx += x * x
                error += float(r @ r)
                n += 1
        if n:
            yield pa.RecordBatch.from_pydict({"atom": pa.array(range(-1, count), pa.int32()), "xr": pa.array([[], *xr.tolist()], pa.list_(pa.float64())), "xx": pa.array([error, *xx.tolist()]), "n": pa.array([n] * (count + 1), pa.int64())})

    parts = frames.select("y").where(F.size("y") == size).mapInArrow(run, "atom int, xr array<double>, xx double, n long")
    # one number a place of an atom, so that what is added up never grows with the tasks
    added = parts.select("atom", "n", F.posexplode(F.concat(F.array("xx"), "xr")).alias("at", "v")).groupBy("atom", "at").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    sums, total, n = np.zeros((count, 1 + size)), 0.0, 0
    for r in added.collect():
        if r["atom"] < 0:
            total, n = float(r["v"]), int(r["n"])
        else:
            sums[r["atom"], r["at"]] = r["v"]
    return sums[:, 1:], sums[:, 0], total, n


def learn(frames: DataFrame, start: np.ndarray, p: Learning | None = None, pursuit: Pursuit | None = None) -> tuple[np.ndarray, list[float]]:
    """The atoms of least error among those measured, and the error of each iteration (root mean square)."""
    p = (p or Learning()).validate()
    picks = pursuit or Pursuit(max_iterations=p.atoms_per_frame)
    d, best, trace = np.array(start, dtype=float), None, []
    for it in range(p.iterations):
        xr, xx, error, n = gradient_sums(frames, d, picks, p.sigma, p.sum_repeats)
        if not n:
            break
        rmse = float(np.sqrt(error / (n * d.shape[1])))
        if best is None or rmse < best[0]:
            best = (rmse, d.copy())
        trace.append(rmse)
        if it and abs(trace[-2] - rmse) / (trace[-2] + 1e-30) < p.tolerance:
            break
        d = d + p.rate / (1 + 0.01 * it) * 2 * (xr + xx[:, None] * d) - p.decay * d
        d = np.array([normalised(a)[0] if a @ a > 1e-24 else a for a in d])
    return (best[1] if best else d), trace
