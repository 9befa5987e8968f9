"""Embedding whitening whose axes are found by spectrum slicing.

Vectors become integers (256 units to one), so equal vectors are equal exactly and sums are exact. Each
distinct vector counts once: their number, their sums and their centred products are added up over
tasks, and the driver gets one covariance matrix, as large as the vectors have dimensions.

How many eigenvalues lie above a shift is read off the signs of an LDL' factorisation of the shifted
matrix (Sylvester's law of inertia). Bisection on that count isolates each leading eigenvalue;
Rayleigh quotient iteration takes it and its vector from there to double precision; counts just below and
just above then certify that it is the one of that number. Components are centred vectors
projected on these axes, divided by the root of the eigenvalue.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import staged

UNITS = 256
COMPONENTS = 4
_LONG = 2**63
_EPS = np.finfo(float).eps


def negatives(matrix: np.ndarray) -> int:
    """Number of negative eigenvalues: negative pivots of LDL' with blocks of one and two (Bunch, Kaufman)."""
    a = np.array(matrix, float)
    n, k, found, growth = len(a), 0, 0, (1 + 17**0.5) / 8
    while k < n:
        below = np.abs(a[k + 1 :, k])
        own, most = abs(a[k, k]), below.max(initial=0.0)
        if max(own, most) == 0:
            k += 1
            continue
        size = 1
        if own < growth * most:
            r = k + 1 + int(below.argmax())
            other = np.abs(a[r, k:])
            other[r - k] = 0
            row = other.max()
            swap = None
            if own * row < growth * most * most:
                if abs(a[r, r]) >= growth * row:
                    swap = k, r
                else:
                    size, swap = 2, (k + 1, r)
            if swap and swap[0] != swap[1]:
                i, j = swap
                a[[i, j]] = a[[j, i]]
                a[:, [i, j]] = a[:, [j, i]]
        block, side = a[k : k + size, k : k + size], a[k + size :, k : k + size]
        if size == 1:
            found += bool(block[0, 0] < 0)
            a[k + 1 :, k + 1 :] -= np.outer(side[:, 0], side[:, 0] / block[0, 0])
        else:
            # The pivot rule leaves blocks of two with one negative eigenvalue, up to rounding.
            found += int((np.linalg.eigvalsh(block) < 0).sum())
            a[k + 2 :, k + 2 :] -= side @ np.linalg.solve(block, side.T)
        k += size
    return found


def above(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues larger than ``shift``."""
    return negatives(shift * np.eye(len(matrix)) - matrix)


def _solved(matrix: np.ndarray, shift: float, b: np.ndarray, scale: float) -> np.ndarray:
    """b by the shifted inverse; a shift that hits an eigenvalue is moved by one unit of rounding."""
    for move in (0.0, 1.0, -3.0, 9.0):
        try:
            x = np.linalg.solve(matrix - (shift + move * _EPS * scale) * np.eye(len(matrix)), b)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(x).all() and x.any():
            return x
    return b


def _refined(matrix: np.ndarray, shift: float, found: list[np.ndarray], scale: float, seed: int):
    """(eigenvalue, unit vector) near ``shift`` and orthogonal to ``found``, by Rayleigh quotients."""
    basis = np.array(found).T if found else np.zeros((len(matrix), 0))

    def unit(x):
        for _ in range(2):
            x = x / np.abs(x).max()
            x = x - basis @ (basis.T @ x)
            size = np.linalg.norm(x)
            if size == 0:
                return None
            x = x / size
        return x

    rng = np.random.default_rng(seed)
    x = None
    while x is None:
        x = unit(rng.standard_normal(len(matrix)))
    # Two steps with the middle of the interval, so that the quotient starts in its own basin.
    for _ in range(2):
        x = unit(_solved(matrix, shift, x, scale)) if x is not None else None
    best = None
    for _ in range(12):
        if x is None:
            break
        value = float(x @ matrix @ x)
        rest = float(np.linalg.norm(matrix @ x - value * x))
        if best is not None and rest >= best[2]:
            break
        best = value, x, rest
        if rest <= _EPS * scale:
            break
        x = unit(_solved(matrix, value, x, scale))
    return best


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of the ``count`` largest eigenvalues of a symmetric matrix, falling.

    Each is certified by inertia counts on both sides of it. Of equal eigenvalues any orthonormal
    vectors are given.
    """
    n = len(matrix)
    count = min(count, n)
    radius = float(np.abs(matrix).sum(1).max(initial=0.0))
    if radius == 0:
        return np.zeros(count), np.eye(n)[:, :count]
    # Scaled to about one, so that neither tiny nor huge entries leave the range of doubles.
    a = matrix / radius
    tolerance = 8 * n * _EPS
    values, vectors = [], []
    for k in range(1, count + 1):
        low, high = -1.0 - tolerance, (values[-1] if values else 1.0) + tolerance
        lower, upper = n, above(a, high)
        while True:
            alone = lower == k and upper == k - 1
            if alone or high - low <= tolerance:
                got = _refined(a, (low + high) / 2, vectors, 1.0, k)
                if got is not None and low - tolerance <= got[0] <= high + tolerance:
                    value, vector, rest = got
                    margin = rest + tolerance
                    if above(a, value + margin) < k <= above(a, value - margin):
                        values.append(value)
                        vectors.append(vector)
                        break
                if high - low <= tolerance:
                    raise ArithmeticError(f"eigenvalue {k} could not be certified")
            middle = (low + high) / 2
            larger = above(a, middle)
            if larger >= k:
                low, lower = middle, larger
            else:
                high, upper = middle, larger
    return np.array(values) * radius, np.array(vectors).T


def _entries(embedding: Column) -> Column:
    """floor(256 c) of each entry c as a long; null for vectors that are left out."""
    given = embedding.cast("array<double>")
    scaled = F.transform(given, lambda c: F.floor(c * UNITS))
    bad = F.exists(given, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= _LONG // UNITS))
    return F.when((F.size(given) > 0) & ~bad, scaled)


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _fixed(vectors: DataFrame, column: str) -> DataFrame:
    """(vec_id, x) of the rows that are not left out."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), _entries(F.col(column)).alias("x"))
    return rows.filter("x is not null")


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of rows of integers; those of an eigenvalue of zero are not finite."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return (x - self.mean) @ self.axes / np.sqrt(self.values)


def _added(rows: DataFrame, function, names: list[str]) -> dict[tuple, float]:
    """Sums by key of what ``function`` yields for each matrix of integers: (keys..., value) columns.

    One set of keys per task goes through the shuffle, one set in all to the driver.
    """

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                own = function(_matrix(batch.column(0)))
                total = own if total is None else total + own
        if total is not None:
            at = np.indices(total.shape).reshape(total.ndim, -1)
            columns = [pa.array(i.astype(np.int32)) for i in at]
            value = total.ravel()
            if value.dtype == object:
                value = pa.array([Decimal(int(v)) for v in value], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(value)], [*names, "value"])

    kind = "decimal(38,0)" if len(names) == 1 else "double"
    schema = ", ".join([*(f"{n} int" for n in names), f"value {kind}"])
    summed = rows.select("x").mapInArrow(run, schema).groupBy(*names).agg(F.sum("value").alias("value"))
    return {tuple(r[:-1]): r[-1] for r in summed.collect()}


def _square(sums: dict, size: int) -> np.ndarray:
    out = np.zeros((size, size))
    for (i, j), value in sums.items():
        out[i, j] = value
    return out


def fit(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> Whitening | None:
    """The whitening of the distinct vectors of ``vectors``, or None if there are none."""
    fixed = _fixed(vectors, column)
    lengths = fixed.groupBy(F.size("x").alias("dims")).count()
    common = lengths.orderBy(F.col("count").desc(), F.col("dims").desc()).first()
    if common is None:
        return None
    dims = common["dims"]
    # The distinct vectors, summed and multiplied in separate passes, are found once.
    rows = staged(fixed.filter(F.size("x") == dims).select("x").distinct(), "whitening")
    n = rows.count()
    sums = _added(rows, lambda x: x.astype(object).sum(0), ["i"])
    sums = [int(sums[i,]) for i in range(dims)]
    mean = np.array([s / n for s in sums])

    def products(x):
        centred = x - mean
        return centred.T @ centred

    covariance = _square(_added(rows, products, ["i", "j"]), dims) / n
    covariance = (covariance + covariance.T) / 2
    values, axes = leading(covariance, components)
    trace = float(np.trace(covariance))
    values = np.where(values > 8 * dims * _EPS * trace, values, 0.0)
    model = Whitening(n, sums, axes, values, trace, None)
    used = np.flatnonzero(values)
    if not len(used):
        return model
    first = _added(rows, lambda x: model.project(x)[:, used].sum(0, keepdims=True), ["i", "j"])
    middle = np.array([first[0, j] for j in range(len(used))]) / n

    def whitened(x):
        centred = model.project(x)[:, used] - middle
        return centred.T @ centred

    own = _square(_added(rows, whitened, ["i", "j"]), len(used)) / n
    return Whitening(n, sums, axes, values, trace, float(np.abs(own - np.eye(len(used))).max()))


def _deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 of each row, exact; None beyond a long."""
    rough = (model.n * x.astype(float) - np.array(model.sums, float)) ** 2
    if rough.sum(1).max(initial=0.0) < 2.0**62 and model.n * np.abs(x).max(initial=0) < 2.0**62:
        centred = model.n * x - np.array(model.sums, np.int64)
        return (centred * centred).sum(1).tolist()
    centred = x.astype(object) * model.n - np.array(model.sums, object)
    return [v if v < _LONG else None for v in (centred * centred).sum(1)]


def whiten(vectors: DataFrame, model: Whitening, column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row and component."""
    sent = vectors.sparkSession.sparkContext.broadcast(model)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.float64()] * 3]

    def run(batches):
        m = sent.value
        k = len(m.values)
        share = m.values / m.trace if m.trace else np.full(k, np.nan)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            parts = m.project(x)
            parts[:, m.values == 0] = np.nan
            rows = len(x)
            deviation = pa.array(_deviations(x, m), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, m.n)),
                    deviation,
                    pa.array(parts.ravel(), from_pandas=True),
                    pa.array(np.tile(share, rows), from_pandas=True),
                    pa.array([m.identity_error] * (rows * k), types[6]),
                ],
                names,
            )

    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = _fixed(vectors, column).filter(F.size("x") == len(model.sums))
    return rows.mapInArrow(run, schema)


def whitened_vectors(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of ``vectors`` (vec_id, embedding).

    A row for each vector and each component, as many as ``components`` or dimensions. Vectors that are
    null or empty, or hold entries that are null, not finite, or of 2^55 and more, are left out, and so are
    those of another length than most have (the greater length on a tie). Equal vectors count once
    in the fit and each have their rows; rows with a null or repeated id are rows like others. A
    component without variance, as in a table of equal vectors, has null whitened values, is explained to
    0 (null if no component has any), and is left out of identity_error, which is null if none is
    left. deviation is null where it is beyond a long. Other columns are ignored; an empty table
    gives an empty table. Sums are exact in any order, products up to rounding.
    """
    model = fit(vectors, components, column)
    if model is None:
        schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], schema)
    return whiten(vectors, model, column)
