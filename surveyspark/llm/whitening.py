"""Whitening of embeddings on the leading eigenvectors of their covariance, found by spectrum slicing.

Components become whole numbers x = floor(scale * c) + shift. Sums are exact integers. Rows are centred
before anything is multiplied: x less a whole number near the mean (exact), less the rest of the mean. Each
task adds up the products of its own rows and one d x d matrix a task is summed, so the driver holds d x d
numbers whatever the number of rows.

The number of negative pivots of an LDL^T factorisation of V - sigma I is the number of eigenvalues below
sigma (Sylvester's law of inertia; symmetric pivoting with 1 x 1 and 2 x 2 blocks keeps it stable). Counts
halve an interval until it holds one eigenvalue only; inverse iteration at its middle and then Rayleigh
quotient iteration, which converges cubically, give the eigenvector; a count on either side of the value
certifies its number. Eigenvalues that no interval of working precision separates form one group: its vectors
are found orthogonally to each other, and the counts around the whole group certify it.

A count costs d^3 / 3 operations on the driver, so d is meant to stay below about a thousand.

Odd input. Rows whose vector is null, empty or holds nulls or non-finite entries take no part; of vectors of
several lengths the length that most rows have stands (the longer on a tie) and the others take no part.
Repeated rows and ids count each for themselves; a null id stays null. Entries whose scaled value exceeds
2^50 and deviations beyond 64 bits raise an error, since they would be wrong as longs. Directions without variance (up to
rounding) can't be whitened and have no component; with no rows, or equal rows only, the result is empty.
Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.llm.common import finite_vectors

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
EPS = float(np.finfo(float).eps)


def ldl_negatives(a: np.ndarray) -> int:
    """Negative eigenvalues of a symmetric matrix: negative pivots of its LDL^T factorisation (Bunch-Parlett)."""
    a = a.copy()
    n, k, below = len(a), 0, 0
    alpha = (1 + math.sqrt(17)) / 8
    while k < n:
        rest = a[k:, k:]
        diag = np.abs(np.diagonal(rest))
        r = int(np.argmax(diag))
        size = np.abs(rest).max()
        if size == 0:
            break
        if diag[r] >= alpha * size:
            _swap(rest, 0, r)
            pivot = rest[0, 0]
            below += pivot < 0
            col = rest[1:, 0].copy()
            rest[1:, 1:] -= np.outer(col / pivot, col)
            k += 1
        else:
            i, j = divmod(int(np.argmax(np.abs(rest))), len(rest))
            i, j = min(i, j), max(i, j)
            _swap(rest, 0, i)
            _swap(rest, 1, j)
            block = rest[:2, :2].copy()
            below += 1 if block[0, 0] * block[1, 1] - block[0, 1] ** 2 < 0 else 2 * (block[0, 0] + block[1, 1] < 0)
            cols = rest[2:, :2].copy()
            rest[2:, 2:] -= cols @ np.linalg.solve(block, cols.T)
            k += 2
    return below


def _swap(a: np.ndarray, i: int, j: int) -> None:
    if i != j:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]


def above(v: np.ndarray, sigma: float) -> int:
    """Eigenvalues of ``v`` that are greater than or equal to sigma."""
    return len(v) - ldl_negatives(v - sigma * np.eye(len(v)))


def _polish(v: np.ndarray, lo: float, hi: float, found: list[np.ndarray], seed: int) -> tuple[float, np.ndarray]:
    """The eigenpair inside [lo, hi]: inverse iteration at the middle, then Rayleigh quotient iteration."""
    d, norm = len(v), max(abs(hi), np.abs(v).sum(axis=1).max())
    basis = np.array(found).T if found else np.zeros((d, 0))

    def unit(x):
        for _ in range(2):
            x = x - basis @ (basis.T @ x)
        return x / np.linalg.norm(x)

    def solve(shift, x):
        for nudge in (0.0, 4 * EPS * norm):
            try:
                y = np.linalg.solve(v - (shift + nudge) * np.eye(d), x)
            except np.linalg.LinAlgError:
                continue
            if np.all(np.isfinite(y)):
                return y
        return x

    x = unit(np.random.default_rng(seed).standard_normal(d))
    for _ in range(4):
        x = unit(solve((lo + hi) / 2, x))
    best = (np.inf, x)
    for _ in range(8):
        rho = float(x @ v @ x)
        residual = float(np.linalg.norm(v @ x - rho * x))
        if residual >= best[0]:
            break
        best = (residual, x)
        if residual <= EPS * norm:
            break
        x = unit(solve(min(max(rho, lo), hi), x))
    x = best[1]
    return float(x @ v @ x), x


def leading(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues (falling) and their unit eigenvectors as columns, by spectrum slicing.

    Only eigenvalues above d * eps * the largest row sum are given. A count that doesn't fit raises an error.
    """
    d = len(v)
    norm = float(np.abs(v).sum(axis=1).max()) if d else 0.0
    if norm == 0.0 or count < 1:
        return np.zeros(0), np.zeros((d, 0))
    floor, top = d * EPS * norm, norm * (1 + 4 * EPS)
    width = 16 * EPS * norm
    want = min(count, above(v, floor))
    values: list[float] = []
    vectors: list[np.ndarray] = []
    # (lo, hi, eigenvalues >= lo, eigenvalues >= hi): slices still to cut, highest last
    todo = [(floor, top, above(v, floor), above(v, top))]
    while todo and len(values) < want:
        lo, hi, n_lo, n_hi = todo.pop()
        inside = n_lo - n_hi
        if inside == 0:
            continue
        alone = inside == 1 and hi - lo <= 1e-3 * hi
        if alone or hi - lo <= width:
            slice_values, slice_vectors = [], []
            for i in range(inside):
                rho, x = _polish(v, lo, hi, vectors + slice_vectors, len(values) + i)
                slice_values.append(rho)
                slice_vectors.append(x)
            slack = width if inside == 1 else 4 * width
            ok = (min(slice_values) >= lo - slack and max(slice_values) <= hi + slack
                  and above(v, min(slice_values) - slack) >= n_lo and above(v, max(slice_values) + slack) <= n_hi)
            if ok:
                order = np.argsort(slice_values)[::-1]
                values += [slice_values[i] for i in order]
                vectors += [slice_vectors[i] for i in order]
                continue
            if hi - lo <= width:
                raise ArithmeticError(f"eigenvalues {len(values) + 1} to {len(values) + inside} can't be certified")
        mid = (lo + hi) / 2
        n_mid = min(max(above(v, mid), n_hi), n_lo)
        todo += [(lo, mid, n_lo, n_mid), (mid, hi, n_mid, n_hi)]
    return np.array(values[:want]), np.array(vectors[:want]).T.reshape(d, want)


def whole(batch, d: int, scale: int, shift: int) -> np.ndarray:
    """The whole-number vectors of an Arrow batch, n x d."""
    col = batch.column("vec")
    c = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), d)
    scaled = np.floor(scale * c)
    if scaled.size and np.abs(scaled).max() > 2.0 ** 50:
        raise ValueError("a component is too large for a whole number of 64 bits")
    return scaled.astype(np.int64) + shift


def _partial_sums(d: int, scale: int, shift: int):
    """One row a task: count and per-dimension sums of x - shift, as decimal text (no overflow)."""
    def run(batches):
        n, s = 0, [0] * d
        for batch in batches:
            x = whole(batch, d, scale, 0)
            n += len(x)
            # high and low halves can't overflow in one batch
            hi, lo = (x >> 20).sum(axis=0), (x & 0xFFFFF).sum(axis=0)
            s = [a + (int(h) << 20) + int(b) for a, h, b in zip(s, hi, lo)]
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "s": pa.array([[str(a) for a in s]], pa.list_(pa.string()))})
    return run


def _partial_products(centred):
    """One row a task: the sum of the outer products (and of the values) of its centred rows."""
    def run(batches):
        total, line = None, None
        for batch in batches:
            c = centred(batch)
            if len(c):
                total = c.T @ c + (0 if total is None else total)
                line = c.sum(axis=0) + (0 if line is None else line)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"line": [line], "row": pa.array([total.ravel()], pa.list_(pa.float64()))})
    return run


def _tree_sum(parts: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums over all tasks: sixteen tasks add up the partial matrices before the driver adds theirs."""
    def add(batches):
        total, line = np.zeros(d * d), np.zeros(d)
        for batch in batches:
            for row, values in zip(batch.column("row"), batch.column("line")):
                total += row.values.to_numpy(zero_copy_only=False)
                line += values.values.to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_pydict({"line": [line], "row": [total]})

    held = parts.repartition(16).mapInArrow(add, "line array<double>, row array<double>").collect()
    return (sum((np.array(r["row"]) for r in held), np.zeros(d * d)).reshape(d, d), sum((np.array(r["line"]) for r in held), np.zeros(d)))


class Whitener:
    """Fitted whitening: sums, covariance and certified components."""

    def __init__(self, n, sums, base, rest, values, vectors, trace, scale, shift):
        self.n, self.sums, self.base, self.rest = n, sums, base, rest
        self.values, self.vectors, self.trace = values, vectors, trace
        self.scale, self.shift, self.d = scale, shift, len(sums)

    def centred(self, batch) -> np.ndarray:
        """x - S / n: a whole part that is exact, less the fraction of the mean."""
        return (whole(batch, self.d, self.scale, self.shift) - self.base) - self.rest

    def project(self, batch) -> np.ndarray:
        return (self.centred(batch) @ self.vectors) / np.sqrt(self.values)

    def deviation(self, batch) -> np.ndarray:
        """Sum of (n x - S)^2 per row, exact; an error where it passes 64 bits."""
        y = whole(batch, self.d, self.scale, self.shift) - self.base
        frac = [int(s) - self.n * int(b) for s, b in zip(self.sums, self.base)]      # n * rest, whole
        peak = max((int(np.abs(y).max()) if y.size else 0) * self.n + max((abs(f) for f in frac), default=0), 1)
        if peak * peak * max(self.d, 1) < 2 ** 63:
            z = y * self.n - np.array(frac, np.int64)
            return (z * z).sum(axis=1)
        out = [sum((int(a) * self.n - f) ** 2 for a, f in zip(row, frac)) for row in y]
        if max(out, default=0) >= 2 ** 63:
            raise OverflowError("a deviation passes 64 bits")
        return np.array(out, np.int64)


def usable(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """Rows that take part, as (vec_id, vec), and their length; 0 if there are none."""
    with_id = df.select(F.struct(F.col(id_col).alias("id")).alias("key"), F.col(vec_col).alias("vec"))
    rows = finite_vectors(with_id, "key", "vec").select(F.col("vec_id.id").alias("vec_id"), F.col("vec"))
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).filter("d > 0")
    best = sizes.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = best[0]["d"] if best else 0
    return rows.filter(F.size("vec") == d), d


def fit(rows: DataFrame, d: int, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> Whitener:
    """Sums, covariance and components of usable rows (vec_id, vec) of length ``d``."""
    vecs = rows.select("vec")
    sums = vecs.mapInArrow(_partial_sums(d, scale, shift), "n long, s array<string>")
    total = sums.select("n", F.posexplode("s").alias("i", "v")).groupBy("i").agg(
        F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).orderBy("i").collect()
    n = total[0]["n"] if total else 0
    s = [int(r["v"]) + n * shift for r in total] if total else [0] * d
    if n == 0:
        return Whitener(0, [0] * d, np.zeros(d, np.int64), np.zeros(d), np.zeros(0), np.zeros((d, 0)), 0.0, scale, shift)
    base = np.array([a // n for a in s], np.int64)
    rest = np.array([(a % n) / n for a in s])
    fitted = Whitener(n, s, base, rest, np.zeros(0), np.zeros((d, 0)), 0.0, scale, shift)
    products, line = _tree_sum(vecs.mapInArrow(_partial_products(fitted.centred), "line array<double>, row array<double>"), d)
    cov = products / n - np.outer(line / n, line / n)
    cov = (cov + cov.T) / 2
    values, vectors = leading(cov, min(components, d))
    return Whitener(n, s, base, rest, values, vectors, float(np.trace(cov)), scale, shift)


def identity_error(rows: DataFrame, fitted: Whitener) -> float:
    """Largest entry of the covariance of the whitened rows, less the identity; measured over all rows."""
    k = len(fitted.values)
    if k == 0:
        return 0.0
    products, line = _tree_sum(rows.select("vec").mapInArrow(_partial_products(fitted.project), "line array<double>, row array<double>"), k)
    cov = products / fitted.n - np.outer(line / fitted.n, line / fitted.n)
    return float(np.abs(cov - np.eye(k)).max())


def whiten(df: DataFrame, id_col: str, vec_col: str, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every usable row and component."""
    rows, d = usable(df, id_col, vec_col)
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = (f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, "
              "eigenvalue double, identity_error double")
    if d == 0:
        return df.sparkSession.createDataFrame([], schema)
    fitted = fit(rows, d, components, scale, shift)
    error = identity_error(rows, fitted)
    k = len(fitted.values)

    def run(batches):
        for batch in batches:
            m = len(batch.column("vec"))
            if m == 0 or k == 0:
                continue
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays([
                pc.take(batch.column("vec_id"), pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, fitted.n)),
                pa.array(fitted.deviation(batch)[each]),
                pa.array(fitted.project(batch).ravel()),
                pa.array(np.tile(fitted.values / fitted.trace, m)),
                pa.array(np.tile(fitted.values, m)),
                pa.array(np.full(m * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "eigenvalue", "identity_error"])
    return rows.mapInArrow(run, schema)
