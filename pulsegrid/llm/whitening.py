"""Embedding whitening: a distributed covariance, its leading eigenvectors by Householder, Sturm and inverse iteration, and a broadcast projection.

Vectors become whole numbers, each distinct one once: this fit list is written, and every statistic is a sum over it. Tasks
add up their rows with numpy and send sums of dimensions (whole numbers, exact) or of products (centred before they are multiplied); Spark adds up the
tasks' sums. Only one number for each pair of dimensions reaches the driver, whatever the number of rows. There the covariance is made tridiagonal by Householder
reflections, its leading eigenvalues are bisected by Sturm counts, and inverse iteration gives their vectors, made orthogonal
again within clusters of close eigenvalues. Mean, components and eigenvalues are broadcast, and every row is projected where it is read. The whitened fit list
is measured once more: its covariance, centred, against the identity.

Rows whose vector is null or holds null or non-finite entries are dropped, equal rows come out one by one, and a null id stays null. Vectors
shorter than the longest count as ending in zeros. Entries beyond 2^34 in size count as 2^34: the deviation of larger ones would not fit a long; a
deviation that still would not is given as the largest long. Eigenvalues of at most 1e-12 of the largest are no components, so a table of a single distinct vector, of
empty vectors or without rows gives no row. Of equal eigenvalues any orthonormal vectors are components, the same for all rows. Extra columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.shared import written

STEPS, SHIFT = 64, 1_000_000
COMPONENTS = 16
LARGEST = 1 << 34
#: Eigenvalues nearer to one another than this share of the matrix's norm have their vectors made orthogonal again.
CLUSTER = 1e-3
RANK = 1e-12
EPS = np.finfo(float).eps


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and Householder vectors of a symmetric matrix."""
    a = a.astype(float).copy()
    n, vectors, off = len(a), [], np.zeros(max(0, len(a) - 1))
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        rest = np.linalg.norm(v[1:])
        if rest == 0:
            off[k] = v[0]
            vectors.append(np.zeros_like(v))
            continue
        off[k] = -np.copysign(np.hypot(v[0], rest), v[0])
        v[0] -= off[k]
        v /= np.linalg.norm(v)
        below = a[k + 1 :, k + 1 :]
        w = below @ v
        w -= (v @ w) * v
        below -= 2 * (np.outer(v, w) + np.outer(w, v))
        vectors.append(v)
    if n > 1:
        off[n - 2] = a[n - 1, n - 2]
    return np.diag(a).copy(), off, vectors


def below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues of a tridiagonal matrix are less than each ``x``."""
    tiny = EPS * EPS * (np.abs(diagonal).max() + np.abs(off).max(initial=0.0) + np.finfo(float).tiny)
    count, q = np.zeros(len(x), int), np.ones(len(x))
    for d, square in zip(diagonal, [0.0, *(off * off)]):
        q = d - x - square / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def largest_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues of a tridiagonal matrix, falling, by bisection until no number lies between."""
    n = len(diagonal)
    reach = np.zeros(n)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    spread = max(np.abs(diagonal).max(), reach.max(), np.finfo(float).tiny)
    lo = np.full(k, (diagonal - reach).min() - EPS * spread)
    hi = np.full(k, (diagonal + reach).max() + EPS * spread)
    place = n - 1 - np.arange(k)
    for _ in range(200):
        mid = (lo + hi) / 2
        if not ((mid > lo) & (mid < hi) & (hi - lo > EPS * EPS * spread)).any():
            break
        less = below(diagonal, off, mid) <= place
        lo, hi = np.where(less, mid, lo), np.where(less, hi, mid)
    return (lo + hi) / 2


class Shifted:
    """A tridiagonal matrix less a multiple of the identity, factorised with row exchanges."""

    def __init__(self, diagonal: np.ndarray, off: np.ndarray, shift: float, least: float):
        n = len(diagonal)
        d, up, low = (diagonal - shift).tolist(), [*off.tolist(), 0.0], off.tolist()
        second = [0.0] * n
        factor, swapped = [0.0] * n, [False] * n
        for i in range(n - 1):
            if abs(d[i]) >= abs(low[i]):
                d[i] = d[i] if abs(d[i]) > least else least
                factor[i] = low[i] / d[i]
                d[i + 1] -= factor[i] * up[i]
            else:
                swapped[i] = True
                factor[i] = d[i] / low[i]
                d[i], d[i + 1], up[i] = low[i], up[i] - factor[i] * d[i + 1], d[i + 1]
                second[i], up[i + 1] = up[i + 1], -factor[i] * up[i + 1]
        d[n - 1] = d[n - 1] if abs(d[n - 1]) > least else least
        self.d, self.up, self.second, self.factor, self.swapped = d, up, second, factor, swapped

    def solve(self, b: np.ndarray) -> np.ndarray:
        x, n = b.tolist(), len(b)
        for i in range(n - 1):
            if self.swapped[i]:
                x[i], x[i + 1] = x[i + 1], x[i] - self.factor[i] * x[i + 1]
            else:
                x[i + 1] -= self.factor[i] * x[i]
        for i in range(n - 1, -1, -1):
            total = x[i]
            if i + 1 < n:
                total -= self.up[i] * x[i + 1]
            if i + 2 < n:
                total -= self.second[i] * x[i + 2]
            x[i] = total / self.d[i]
        return np.array(x)


def eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Rows: unit eigenvectors of a tridiagonal matrix for falling eigenvalues, by inverse iteration."""
    n, rng = len(diagonal), np.random.default_rng(0)
    norm = max((np.abs(diagonal) + np.concatenate([np.abs(off), [0]]) + np.concatenate([[0], np.abs(off)])).max(), np.finfo(float).tiny)
    out, first, shift = np.zeros((len(values), n)), 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            first = k
        # equal eigenvalues are shifted apart, so that their systems differ
        shift = min(value, shift - 10 * EPS * norm) if k > first else value
        system = Shifted(diagonal, off, shift, EPS * norm)
        x = rng.uniform(-1, 1, n)
        for _ in range(6):
            for _ in range(2):
                x -= out[first:k].T @ (out[first:k] @ x)
            x = system.solve(x / np.linalg.norm(x))
            x /= np.abs(x).max()
        for _ in range(2):
            x -= out[first:k].T @ (out[first:k] @ x)
        out[k] = x / np.linalg.norm(x)
    return out


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as rows."""
    size = np.abs(matrix).max(initial=0.0)
    if not size:
        return np.zeros(k), np.eye(len(matrix))[:k]
    diagonal, off, reflections = tridiagonal(matrix / size)
    values = largest_eigenvalues(diagonal, off, k)
    vectors = eigenvectors(diagonal, off, values)
    for first, v in reversed(list(enumerate(reflections, 1))):
        vectors[:, first:] -= 2 * np.outer(vectors[:, first:] @ v, v)
    return values * size, vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


class Fit(NamedTuple):
    """The fit list: its length, sums by dimension (as quotient and remainder by its length), components (rows), eigenvalues and trace."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.values)[:, None]).T

    def deviation(self, x: np.ndarray) -> list[int]:
        """Exact sums of squares of n * x less the sums."""
        own = x - self.whole
        furthest = self.n * (int(np.abs(own).max(initial=0)) + 1)
        if furthest * furthest * max(1, x.shape[1]) < 1 << 63:
            own = self.n * own - self.rest
            return (own * own).sum(axis=1).tolist()
        rest = self.rest.tolist()
        return [min((1 << 63) - 1, sum((self.n * v - r) ** 2 for v, r in zip(row, rest))) for row in own.tolist()]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column of whole numbers, all of one width."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def cleaned(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows whose vector is whole, with ``x``, its entries as whole numbers."""
    c = F.col(column)
    finite = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    size = lambda e: F.least(F.greatest(e.cast("double"), F.lit(-float(LARGEST))), F.lit(float(LARGEST)))
    return vectors.filter(c.isNotNull() & finite).withColumn("x", F.transform(c, lambda e: F.floor(size(e) * STEPS).cast("long") + SHIFT))


def _padded(x: str, width: int) -> Column:
    missing = F.lit(width) - F.size(x)
    return F.when(missing > 0, F.concat(F.col(x), F.array_repeat(F.lit(SHIFT).cast("long"), missing))).otherwise(F.col(x))


def _totals(fit: DataFrame, width: int, cells: int, kind: str, sums) -> list:
    """Sums over all rows: each task adds up ``sums(x)``, an array of ``cells`` numbers, and Spark adds up the tasks' by cell."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = sums(_matrix(batch.column("x"), width))
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(cells, dtype=np.int32)), pa.array(total)], ["cell", "v"])

    found = fit.select("x").mapInArrow(run, f"cell int, v {kind}")
    exact = F.col("v").cast("decimal(38,0)") if kind == "long" else F.col("v")
    out = [0] * cells
    for r in found.groupBy("cell").agg(F.sum(exact).alias("v")).collect():  # one row for each cell
        out[r["cell"]] = r["v"]
    return out


def _products(fit: DataFrame, width: int, wide: int, centred) -> np.ndarray:
    """Sums of products of all pairs of the ``wide`` columns of ``centred(x)``."""
    upper = np.triu_indices(wide)

    def sums(x):
        y = centred(x)
        return (y.T @ y)[upper]

    out = np.zeros((wide, wide))
    out[upper] = _totals(fit, width, len(upper[0]), "double", sums)
    return out + np.triu(out, 1).T


def fitted(rows: DataFrame, width: int, components: int = COMPONENTS) -> tuple[Fit, float] | None:
    """The fit of the distinct ``x`` of these rows and its identity error; None where there is no component."""
    fit = written(rows.select("x").distinct())
    n = fit.count()
    if not n or not width:
        return None
    sums = [int(v) for v in _totals(fit, width, width, "long", lambda x: x.sum(axis=0))]
    whole, rest = np.array([v // n for v in sums], np.int64), np.array([v % n for v in sums], np.int64)
    plain = Fit(n, whole, rest, np.zeros((0, width)), np.zeros(0), 0.0)
    covariance = _products(fit, width, width, plain.centred) / n
    values, vectors = leading(covariance, min(components, width))
    real = values > RANK * values[0]
    if not real.any():
        return None
    found = plain._replace(components=vectors[real], values=values[real], trace=float(np.trace(covariance)))
    k = int(real.sum())
    mean = np.array(_totals(fit, width, k, "double", lambda x: found.whitened(x).sum(axis=0))) / n
    again = _products(fit, width, k, lambda x: found.whitened(x) - mean) / n
    return found, float(np.abs(again - np.eye(k)).max())


def whitening(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """For each whole vector and component: the vector's deviation and its whitened value, with what the fit says of the component."""
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = cleaned(vectors.select(key, column), column).select(key, "x")
    width = rows.agg(F.max(F.size("x")).alias("w")).first()["w"] or 0
    rows = rows.withColumn("x", _padded("x", width))
    found = fitted(rows, width, components)
    if found is None:
        return rows.sparkSession.createDataFrame([], schema)
    shared = rows.sparkSession.sparkContext.broadcast(found)  # two rows of numbers for each component

    def run(batches):
        fit, error = shared.value
        k = len(fit.values)
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            m = len(x)
            ids = batch.column(key).take(pa.array(np.repeat(np.arange(m), k)))
            deviation = np.repeat(np.array(fit.deviation(x), np.int64), k)
            yield pa.record_batch(
                [
                    ids,
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, fit.n)),
                    pa.array(deviation),
                    pa.array(fit.whitened(x).reshape(-1)),
                    pa.array(np.tile(fit.values / fit.trace, m)),
                    pa.array(np.full(m * k, error)),
                ],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
