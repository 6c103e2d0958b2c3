"""Whitening of embeddings by the leading eigenvectors of their covariance, found by spectrum slicing.

Spark makes the fit list (every different vector once), its exact sums and, in a second pass over centred vectors, the
covariance, one partial matrix a task. What reaches the driver is that matrix of dimensions by dimensions. There an
LDL^T factorisation of the covariance less a shift gives the signs of its pivots, which by Sylvester's law count the
eigenvalues above the shift. Bisection on these counts isolates an eigenvalue, Rayleigh quotient iteration converges
cubically within its interval, and two more counts beside the result certify its number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, staged, tidied

#: x = floor(SCALE * entry) + OFFSET, fixed values.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Entries whose x is no long of this many bits count as not finite.
_BITS = 61
_EPS = float(np.finfo(np.float64).eps)


@dataclass(frozen=True)
class Whitening:
    """A fit: n vectors with the mean low + rest / n in whole numbers, eigenvalues (falling) and vectors of their covariance."""

    n: int
    low: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0


def eigenvalues_above(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric matrix a are above shift: the positive pivots of an LDL^T factorisation of
    a - shift with Bunch and Kaufman's pivoting. A pivot of two rows has one eigenvalue of either sign."""
    m = a - shift * np.eye(len(a))
    bound = (1 + 17**0.5) / 8
    positive = 0
    while len(m):
        beside = np.abs(m[1:, 0])
        most = beside.max(initial=0.0)
        pair = False
        if abs(m[0, 0]) < bound * most:
            r = 1 + int(beside.argmax())
            others = np.abs(m[:, r])
            others[r] = 0
            if abs(m[0, 0]) * others.max() < bound * most * most:
                pair = abs(m[r, r]) < bound * others.max()
                order = np.arange(len(m))
                order[[int(pair), r]] = order[[r, int(pair)]]
                m = m[np.ix_(order, order)]
        if pair:
            positive += 1
            m = m[2:, 2:] - m[2:, :2] @ np.linalg.solve(m[:2, :2], m[:2, 2:])
        else:
            positive += bool(m[0, 0] > 0)
            m = m[1:, 1:] - (np.outer(m[1:, 0], m[1:, 0] / m[0, 0]) if m[0, 0] else 0)
    return positive


def _rayleigh(a: np.ndarray, shift: float, found: np.ndarray, seed: int) -> tuple[float, np.ndarray, float]:
    """Eigenvalue, vector and residual that iteration from shift leads to, away from the vectors found before."""
    away = lambda v: v - found.T @ (found @ v)
    v = away(np.random.default_rng(seed).standard_normal(len(a)))
    v /= np.linalg.norm(v)
    best = (shift, v, np.inf)
    for step in range(12):
        at = shift if step < 3 else best[0]  # the first steps stay at the interval's middle, so that they lead into it
        try:
            v = np.linalg.solve(a - at * np.eye(len(a)), v)
        except np.linalg.LinAlgError:
            v = np.linalg.solve(a - (at + _EPS) * np.eye(len(a)), v)
        v = away(away(v / np.linalg.norm(v)))
        v /= np.linalg.norm(v)
        value = float(v @ a @ v)
        left = float(np.linalg.norm(a @ v - value * v))
        if left >= best[2] / 2 and step > 4:
            return best if best[2] <= left else (value, v, left)
        best = (value, v, left)
    return best


def leading_eigenpairs(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most largest eigenvalues of a positive semidefinite matrix, falling, and their unit vectors as rows. Eigenvalues
    that are zero to double precision are left out; equal ones have vectors at right angles."""
    d, trace = len(a), float(np.trace(a))
    values, vectors = np.zeros(0), np.zeros((0, d))
    if not d or not trace > 0:
        return values, vectors
    a = (a + a.T) / (2 * trace)
    fine = 4 * d * _EPS
    counted: dict[float, int] = {-fine: d, 1 + fine: 0}

    def above(shift: float) -> int:
        if shift not in counted:
            counted[shift] = eigenvalues_above(a, shift)
        return counted[shift]

    for k in range(1, min(most, above(fine)) + 1):
        while True:
            low = max(s for s, c in counted.items() if c >= k)
            high = min(s for s, c in counted.items() if c < k)
            last = high - low <= fine
            if last or counted[low] == k and counted[high] == k - 1:
                value, v, left = _rayleigh(a, (low + high) / 2, vectors, k)
                off = max(fine, 2 * left)
                if left <= 16 * fine and low - fine <= value <= high + fine and above(value + off) < k <= above(value - off):
                    break
                if last:
                    raise ArithmeticError(f"eigenvalue {k} isn't certified")
            above((low + high) / 2)
        values, vectors = np.append(values, value), np.vstack([vectors, v])
    order = np.argsort(-values, kind="stable")
    return values[order] * trace, vectors[order]


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def _partial(width: int, add: Callable[[np.ndarray], np.ndarray], names: list[str], kind) -> Callable:
    """A task's sum of add(matrix) over its vectors, as rows (i, j, value) of its upper half or (i, a, b, ...) of its columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in slices(batches):
            if batch.num_rows:
                got = add(_matrix(batch.column(0), width))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays(kind(total), names=names)

    return tidied(run)


def _halves(total: np.ndarray) -> list[pa.Array]:
    i, j = np.triu_indices(len(total), 0, total.shape[1])
    return [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])]


def _gram(fit: DataFrame, d: int, rows: int, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over the fit list of v'v of rows v = f(x), summed by task and then by place."""
    parts = fit.mapInArrow(_partial(d, lambda x: (y := f(x)).T @ y, ["i", "j", "v"], _halves), "i int, j int, v double")
    got = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((rows, rows))
    i, j, v = (got.column(c).to_numpy() for c in ("i", "j", "v"))
    out[i, j] = out[j, i] = v
    return out


def _centred(model: Whitening) -> Callable[[np.ndarray], np.ndarray]:
    """Vectors less their mean; the whole part is subtracted exactly."""
    low, part = model.low, model.rest / model.n
    return lambda x: (x - low) - part


def points(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """df's rows with a usable vector, and x, its whole numbers.

    Left out are null and empty vectors, those with null or non-finite entries (or entries beyond 2**55), and those of another
    length than most have (of equally frequent lengths the greater one counts).
    """
    usable = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float(1 << (_BITS - 6)), F.lit(False)))
    rows = df.filter(F.coalesce(usable & (F.size(vector) > 0), F.lit(False)))
    lengths = rows.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size(vector) == (lengths["d"] if lengths else 0)).withColumn("x", F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + OFFSET))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The whitening of rows made by points. Without rows, or where no two vectors differ, it has no components."""
    unique = staged(rows.select("x").distinct(), "vectors")
    first = unique.first()
    d = len(first["x"]) if first else 0
    none = np.zeros(d, np.int64)
    if not first:
        return Whitening(0, none, none, np.zeros(0), np.zeros((0, 0)), 0.0)

    def sums(x: np.ndarray) -> np.ndarray:  # in two halves, so that no sum leaves a long
        return np.stack([np.full(d, len(x)), (x >> 31).sum(0), (x & (1 << 31) - 1).sum(0)])

    columns = lambda t: [pa.array(np.arange(d), pa.int32()), *map(pa.array, t)]
    got = unique.mapInArrow(_partial(d, sums, ["i", "n", "upper", "lower"], columns), "i int, n long, upper long, lower long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("upper").alias("upper"), F.sum("lower").alias("lower")).orderBy("i").collect()
    n = got[0]["n"]
    mean = [divmod((r["upper"] << 31) + r["lower"], n) for r in got]
    model = Whitening(n, np.array([m for m, _ in mean], np.int64), np.array([r for _, r in mean], np.int64), np.zeros(0), np.zeros((0, d)), 0.0)
    covariance = _gram(unique, d, d, _centred(model)) / n
    values, vectors = leading_eigenpairs(covariance, components)
    model = replace(model, values=values, vectors=vectors, trace=float(np.trace(covariance)))
    k = len(values)
    project = _projected(model)
    whole = _gram(unique, d, k + 1, lambda x: np.hstack([project(x), np.ones((len(x), 1))])) / n
    error = whole[:k, :k] - np.outer(whole[k, :k], whole[k, :k]) - np.eye(k)
    return replace(model, identity_error=float(np.abs(error).max(initial=0.0)))


def _projected(model: Whitening) -> Callable[[np.ndarray], np.ndarray]:
    centred, by = _centred(model), model.vectors.T / np.sqrt(model.values)
    return lambda x: centred(x) @ by


def _deviation(model: Whitening, x: np.ndarray) -> list[int | None]:
    """Exact sums over dimensions of (n x - S)^2; null where one is no long."""
    off = x - model.low
    reach = model.n * (float(np.abs(off).max(initial=0)) + 1)
    if x.shape[1] * reach * reach < 2.0**62:
        return ((model.n * off - model.rest) ** 2).sum(1).tolist()
    exact = ((model.n * off.astype(object) - model.rest.astype(object)) ** 2).sum(1)
    return [v if v < 1 << 63 else None for v in exact]


def whiten(rows: DataFrame, model: Whitening, vec_id: str = "vec_id") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each row of points and each component.

    Components are numbered from 1 by falling eigenvalue. There are fewer than asked for where vectors have fewer dimensions
    or vary in fewer directions. Repeated rows are each reported, a null id is kept, other columns play no part.
    """
    kind = rows.schema[vec_id].dataType
    schema = T.StructType([T.StructField("vec_id", kind)]).add("component", "integer").add("n", "long").add("deviation", "long").add("whitened", "double").add("explained", "double").add("identity_error", "double")
    d, k = len(model.low), len(model.values)
    sent = rows.sparkSession.sparkContext.broadcast(model)  # dimensions by components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        project, share = _projected(m), m.values / m.trace if k else m.values
        for batch in slices(batches, 1 << 20):
            if not batch.num_rows or not k:
                continue
            x = _matrix(batch.column(1), d)
            every = pa.array(np.repeat(np.arange(len(x)), k))
            exact = pa.array(_deviation(m, x), pa.int64())
            size = len(x) * k
            yield pa.RecordBatch.from_arrays([batch.column(0).take(every), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(size, m.n)), exact.take(every), pa.array(project(x).ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(size, m.identity_error))], names=schema.names)

    return rows.select(vec_id, "x").mapInArrow(tidied(run), schema)
