"""Polynomial, harmonic and wavelet bases, orthonormalisation, projection. Bases are small matrices; frames stay distributed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sigloom.config import Basis, Frequency
from sigloom.functions.scalar import norm_sq

from .frequency import array_dominant

SPAN, MORLET_SIGMA, MORLET_CARRIER, MOST = 30.0, 1.5, 15.0, 300


def build_basis(n: int, p: Basis | None = None) -> np.ndarray:
    """Rows: polynomials in 2 i/(n-1) - 1, sine and cosine pairs of k w t, Morlet waves; t runs over 0..30."""
    p = (p or Basis()).validate()
    if n < 2:
        return np.zeros((0, n))
    u = np.arange(n) / (n - 1)
    x, t = 2 * u - 1, SPAN * u
    poly = np.polynomial.legendre if p.legendre else np.polynomial.chebyshev
    value = poly.legval if p.legendre else poly.chebval
    rows = [value(x, [0] * k + [1]) for k in range(p.poly)]
    for k in range(1, p.harm // 2 + 1):
        rows += [np.sin(k * p.frequency * t), np.cos(k * p.frequency * t)]
    centres = np.linspace(0, SPAN, p.morlet) if p.morlet > 1 else np.array([SPAN / 2] * p.morlet)
    rows += [np.exp(-(((t - m) / MORLET_SIGMA) ** 2) / 2) * np.cos(MORLET_CARRIER * (t - m)) for m in centres]
    return np.array(rows[: min(MOST, len(rows))]).reshape(-1, n)


def orthonormalise(a: np.ndarray, tolerance: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """Rows made orthonormal by two passes of modified Gram-Schmidt, by QR where that misses the tolerance, and R = Q A'.
    Rows that depend on earlier ones become zero."""
    q = np.array(a, dtype=float)
    for _ in range(2):
        for k in range(len(q)):
            before = np.linalg.norm(q[k])
            for j in range(k):
                q[k] -= (q[j] @ q[k]) * q[j]
            size = np.linalg.norm(q[k])
            q[k] = q[k] / size if size > 1e-10 * max(before, 1e-30) and size > 1e-30 else 0.0
    if orthogonality_error(q) > tolerance:
        full, r = np.linalg.qr(np.asarray(a, dtype=float).T)
        keep = np.abs(np.diag(r)) > 1e-10 * np.abs(np.diag(r)).max(initial=1e-30)
        q = (full * keep).T
    return q, q @ np.asarray(a, dtype=float).T


def orthogonality_error(q: np.ndarray) -> float:
    """Greatest departure of Q Q' from the unit matrix; zero rows are left out."""
    q = q[np.linalg.norm(q, axis=1) > 0]
    return float(np.abs(q @ q.T - np.eye(len(q))).max(initial=0.0))


def condition_estimate(a: np.ndarray) -> float:
    """Greatest over least row norm; 1e15 if degenerate."""
    norms = np.linalg.norm(a, axis=1)
    return float(norms.max() / norms.min()) if len(norms) and norms.min() > 1e-30 else 1e15


def condition_estimates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, condition: `condition_estimate` of each basis given as rows (keys, y), as one aggregate."""
    norm = F.sqrt(norm_sq(F.col("y")))
    sized = rows.groupBy(*keys).agg(F.max(norm).alias("most"), F.min(norm).alias("least"))
    return sized.select(*keys, F.when(F.col("least") > 1e-30, F.col("most") / F.col("least")).otherwise(1e15).alias("condition"))


def regularised(a: np.ndarray, reg: float) -> np.ndarray:
    rows, cols = np.indices(a.shape)
    return a + reg * (rows + 1) * (cols + 1) * 1e-6


def orthonormal_stats(a: np.ndarray, q: np.ndarray, r: np.ndarray) -> dict[str, float]:
    """What to log of an orthonormalisation: sizes, dependent rows, error, row norm ratio, what Q and R give back, odd values."""
    given = np.asarray(a, dtype=float)
    return {
        "rows": len(given), "size": given.shape[1], "dependent": int((np.linalg.norm(q, axis=1) == 0).sum()), "error": orthogonality_error(q),
        "condition": condition_estimate(given), "rebuilt": float(np.abs(r.T @ q - given).max(initial=0.0)), "not_finite": int((~np.isfinite(given)).sum()),
    }


def project(f: DataFrame, columns: list[str], q: np.ndarray) -> DataFrame:
    """columns, coeff (array): inner products of each frame with the rows of q, a matrix product a batch."""
    schema = StructType([*f.select(*columns).schema.fields, *StructType.fromDDL("coeff array<double>").fields])
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(width).flatten().to_numpy(zero_copy_only=False).reshape(-1, q.shape[1]).astype(float)
            c = np.where(np.isfinite(y), y, 0.0) @ q.T
            offsets = pa.array(np.arange(0, c.size + 1, max(1, len(q)), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.ListArray.from_arrays(offsets, pa.array(c.ravel()))], names=schema.names)

    return f.where(F.size("y") == q.shape[1]).select(*columns, "y").mapInArrow(run, schema)


def coefficients(f: DataFrame, columns: list[str], size: int, p: Basis, tune: Frequency | None = None) -> DataFrame:
    """`project` on the orthonormalised basis of a size. With `tune`, harmonics follow each frame's dominant frequency (0 keeps
    that of p)."""
    if tune is None:
        return project(f, columns, orthonormalise(build_basis(size, p))[0])
    schema = StructType([*f.select(*columns).schema.fields, *StructType.fromDDL("coeff array<double>").fields])
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[float, np.ndarray] = {}
        for b in batches:
            y = b.column(width).flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(float)
            w, out = array_dominant(y, tune), [[] for _ in range(len(y))]
            for v in np.unique(w).tolist():
                if v not in held:
                    held[v] = orthonormalise(build_basis(size, replace(p, frequency=v or p.frequency)))[0]
                for r, c in zip(np.flatnonzero(w == v).tolist(), (y[w == v] @ held[v].T).tolist(), strict=True):
                    out[r] = c
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(out, pa.list_(pa.float64()))], names=schema.names)

    return f.where(F.size("y") == size).select(*columns, "y").mapInArrow(run, schema)


def orthonormalise_groups(rows: DataFrame, keys: list[str], chosen: list[int] | None = None) -> DataFrame:
    """keys, basis_index, q for bases given as rows (keys, basis_index, y); a basis has at most 300 rows. With `chosen`, only
    rows with these indices make up a basis."""
    rows = rows if chosen is None else rows.where(F.col("basis_index").isin(chosen))
    gathered = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("basis_index", "y"))).alias("b"))
    schema = StructType([*gathered.select(*keys).schema.fields, *StructType.fromDDL("basis_index int, q array<double>").fields])
    arrow, width = to_arrow_schema(schema), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in range(b.num_rows):
                base = b.column(width)[r].as_py()
                q, _ = orthonormalise(np.array([x["y"] for x in base]))
                out += [(*(b.column(i)[r].as_py() for i in range(width)), x["basis_index"], v.tolist()) for x, v in zip(base, q, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t.type) for i, t in enumerate(arrow)], schema=arrow)

    return gathered.mapInArrow(run, schema)
