"""Many small dense systems at once: one row a system, `a` an array of rows, `b` the right side."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sigloom.functions.scalar import is_finite


def gauss(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Elimination with partial pivoting; least squares if not square; None if singular or not finite."""
    if not (np.isfinite(a).all() and np.isfinite(b).all()):
        return None
    if not a.size:
        return np.zeros(0)
    if a.shape[0] != a.shape[1]:
        return np.linalg.lstsq(a, b, rcond=None)[0]
    a, b, n = a.astype(float).copy(), b.astype(float).copy(), len(b)
    least = 1e-14 * max(1.0, float(np.abs(a).max()))
    for k in range(n):
        p = k + int(np.abs(a[k:, k]).argmax())
        if abs(a[p, k]) < least:
            return None
        a[[k, p]], b[[k, p]] = a[[p, k]], b[[p, k]]
        f = a[k + 1 :, k] / a[k, k]
        a[k + 1 :] -= f[:, None] * a[k]
        b[k + 1 :] -= f * b[k]
    x = np.zeros(n)
    for k in range(n - 1, -1, -1):
        x[k] = (b[k] - a[k, k + 1 :] @ x[k + 1 :]) / a[k, k]
    return x


def conjugate_gradients(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-13, restarts: int = 3) -> np.ndarray | None:
    """Least squares by conjugate gradients on the normal equations (Hestenes and Stiefel), columns scaled to unit length.

    Directions are built from A'r, so A'A is never formed. After as many steps as there are columns, or once A'r is
    `tolerance` of its start, it starts anew from the true residual, which takes back what rounding lost. Columns of zeros
    get 0; None if something is not finite."""
    if not (np.isfinite(a).all() and np.isfinite(b).all()):
        return None
    size = np.sqrt((a * a).sum(0))
    unit = a / np.where(size > 0, size, 1.0)
    x, goal = np.zeros(a.shape[1]), tolerance * np.linalg.norm(unit.T @ b)
    for _ in range(1 + restarts):
        left = b - unit @ x
        slope = unit.T @ left
        direction, power = slope, slope @ slope
        for _ in range(2 * len(x)):
            if power <= goal * goal:
                break
            image = unit @ direction
            length = power / (image @ image)
            x = x + length * direction
            left = left - length * image
            slope = unit.T @ left
            power, before = slope @ slope, power
            direction = slope + power / before * direction
    x = x / np.where(size > 0, size, 1.0)
    return x if np.isfinite(x).all() else None


def solve(systems: DataFrame, keys: list[str], method: Callable[[np.ndarray, np.ndarray], np.ndarray | None] = gauss) -> DataFrame:
    """keys, x (null where there is no solution), residual: the norm of a x - b."""

    def one(a: np.ndarray, b: np.ndarray) -> tuple:
        x = method(a, b)
        return (None, None) if x is None else (x.tolist(), float(np.linalg.norm(a @ x - b)))

    return per_matrix(systems, keys, "x array<double>, residual double", one)


def condition_number(a: np.ndarray) -> float:
    return float(np.linalg.cond(a))


def power_norm(a: np.ndarray, rounds: int = 200, tolerance: float = 1e-13) -> float:
    """The greatest singular value, by power iteration with x -> A'(A x), normalised each round."""
    x = normalised(np.ones(a.shape[1]) + np.arange(a.shape[1]) / (1 + a.shape[1]))
    value = 0.0
    for _ in range(rounds):
        y = a.T @ (a @ x)
        before, value = value, float(np.linalg.norm(y))
        if value == 0 or abs(value - before) <= tolerance * value:
            break
        x = y / value
    return float(np.sqrt(value))


def normalised(x: np.ndarray) -> np.ndarray:
    """x over its length; as it is if that vanishes or is not finite."""
    size = float(np.linalg.norm(x))
    return x / size if size > 1e-30 and np.isfinite(size) else x


def ridge(a: np.ndarray, b: np.ndarray, weight: float) -> np.ndarray:
    return np.linalg.solve(a.T @ a + weight * np.eye(a.shape[1]), a.T @ b)


def row_scaled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows over their diagonal (nudged off zero)."""
    s = np.diag(a) + 1e-28
    return a / s[:, None], b / s


def transposed_and_scaled(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The transpose of the row-scaled matrix, and the squared length of each of its columns."""
    t = (a / (np.diag(a) + 1e-28)[:, None]).T
    return t, (t * t).sum(1)


def jacobi_svd(a: np.ndarray, sweeps: int = 30, tolerance: float = 1e-14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """U, singular values (falling) and V' by one-sided Jacobi rotations: pairs of columns are turned until orthogonal."""
    u, v = np.array(a, dtype=float), np.eye(a.shape[1])
    for _ in range(sweeps):
        turned = False
        for p in range(u.shape[1] - 1):
            for q in range(p + 1, u.shape[1]):
                x, y, z = u[:, p] @ u[:, p], u[:, q] @ u[:, q], u[:, p] @ u[:, q]
                if abs(z) <= tolerance * np.sqrt(x * y) or x * y == 0:
                    continue
                turned = True
                angle = 0.5 * np.arctan2(2 * z, x - y)
                turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
                u[:, [p, q]] = u[:, [p, q]] @ turn
                v[:, [p, q]] = v[:, [p, q]] @ turn
        if not turned:
            break
    size = np.linalg.norm(u, axis=0)
    order = np.argsort(-size, kind="stable")
    size, u, v = size[order], u[:, order], v[:, order]
    return u / np.where(size > 0, size, 1.0), size, v.T


def householder_qr(a: np.ndarray, block: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Q and R by Householder reflections, gathered by blocks of columns as I - V T V'; R's diagonal is not negative."""
    r = np.array(a, dtype=float)
    m, n = r.shape
    q = np.eye(m)
    for start in range(0, min(m, n), block):
        stop = min(start + block, m, n)
        v, t = np.zeros((m, stop - start)), np.zeros((stop - start, stop - start))
        for k in range(start, stop):
            x = r[k:, k].copy()
            x[0] += np.copysign(np.linalg.norm(x), x[0])
            size = float(x @ x)
            beta = 2 / size if size > 0 else 0.0
            r[k:, k:stop] -= beta * np.outer(x, x @ r[k:, k:stop])
            j = k - start
            v[k:, j] = x
            t[:j, j] = -beta * t[:j, :j] @ (v[:, :j].T @ v[:, j])
            t[j, j] = beta
        r[:, stop:] -= v @ (t.T @ (v.T @ r[:, stop:]))
        q -= (q @ v) @ t @ v.T
    sign = np.where(np.diag(r)[: min(m, n)] < 0, -1.0, 1.0)
    return q[:, : min(m, n)] * sign, np.triu(r[: min(m, n)]) * sign[:, None]


def per_matrix(systems: DataFrame, keys: list[str], ddl: str, f: Callable[[np.ndarray, np.ndarray], tuple]) -> DataFrame:
    """keys and what `f` gives for each system's a and b, a row a system."""
    schema = StructType([*systems.select(*keys).schema.fields, *StructType.fromDDL(ddl).fields])
    arrow, width = to_arrow_schema(schema), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f(np.array(a, dtype=float), np.array(b, dtype=float)) for a, b in zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *(pa.array([x[k] for x in found], arrow[width + k].type) for k in range(len(arrow) - width))], schema=arrow)

    return systems.select(*keys, "a", "b").mapInArrow(run, schema)


def matvec(entries: DataFrame, x: DataFrame) -> DataFrame:
    """row, y of a matrix (row, col, v) times a vector (col, x); entries that are missing count as zero."""
    return entries.join(x, "col").groupBy("row").agg(F.sum(F.col("v") * F.col("x")).alias("y"))


def transposed_matvec(entries: DataFrame, y: DataFrame) -> DataFrame:
    """col, x of the transposed matrix times a vector (row, y)."""
    return entries.join(y, "row").groupBy("col").agg(F.sum(F.col("v") * F.col("y")).alias("x"))


def normal_matvec(entries: DataFrame, x: DataFrame) -> DataFrame:
    """col, x of A'A x; a row's entries meet once, no square matrix is formed."""
    return transposed_matvec(entries, matvec(entries, x))


def matrix_stats(entries: DataFrame) -> DataFrame:
    """One row: the greatest absolute value of finite entries, and how many are NaN or infinite."""
    v, odd = F.col("v"), ~is_finite(F.col("v"))
    return entries.agg(F.max(F.when(~odd, F.abs(v))).alias("max_abs"), F.count_if(F.isnan(v)).alias("nan"), F.count_if(odd & ~F.isnan(v) & v.isNotNull()).alias("infinite"))


def line_rows(s: DataFrame, keys: list[str]) -> DataFrame:
    """Whole observations of y on (1, i) per series: keys, a (n x 2), b; for series that fit a row."""
    gathered = F.array_sort(F.collect_list(F.struct("i", "y")))
    g = s.groupBy(*keys).agg(gathered.alias("g"))
    return g.select(*keys, F.transform("g", lambda x: F.array(F.lit(1.0), x["i"].cast("double"))).alias("a"), F.col("g.y").alias("b"))


def line_systems(s: DataFrame, keys: list[str]) -> DataFrame:
    """Normal equations of y on (1, i) per series: keys, a (2 x 2), b."""
    i, y = F.col("i").cast("double"), F.col("y")
    sums = s.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(i).alias("si"), F.sum(i * i).alias("sii"), F.sum(y).alias("sy"), F.sum(i * y).alias("siy"))
    return sums.select(*keys, F.array(F.array("n", "si"), F.array("si", "sii")).alias("a"), F.array("sy", "siy").alias("b"))


def solver_advice(log: DataFrame) -> DataFrame:
    """Recommendations from a solver's log (run, rate, omega, cond, avg_ms, final_residual), as projections only. The limits are
    fixed values."""
    rate, cond, ms = F.col("rate"), F.col("cond"), F.col("avg_ms")
    extreme, ill = cond > 1e12, cond > 1e8
    omega = F.when(rate > 0.5, F.least(F.lit(1.9), F.col("omega") * F.when(rate > 0.9, 1.5).otherwise(1.2))).when(rate < 0.1, F.greatest(F.lit(0.5), F.col("omega") * 0.8)).otherwise(F.col("omega"))
    return log.select(
        "run", omega.alias("omega"), ((rate > 0.9) | ((ms > 100) & (rate > 0.5)) | extreme).alias("direct"), (ill | extreme).alias("regularise"),
        F.when(extreme, 1e-6).when(ill, F.greatest(1e-8 * cond / 1e8, F.lit(1e-12))).otherwise(0.0).alias("lambda"),
        (extreme & (F.col("final_residual") >= 1e-12)).alias("refine"), (ms > 1000).alias("spread_out"), (ms < 10).alias("keep_local"),
        F.when(cond < 1e6, "well").when(extreme, "extreme").when(ill, "ill").otherwise("fair").alias("conditioning"),
    )
