"""Whitening of embeddings by cyclic Jacobi rotations of an exact covariance.

Vectors become whole numbers, each distinct vector is fitted once, and sums and scatter are whole numbers too: a task adds up
the products of its vectors less a whole-number centre near the mean, and what is left of the mean is taken off exactly at the
end. So the covariance is right to the last bit of a double, however far the mean lies from zero and however the vectors
were dealt out. Only sums (one for each dimension) and the scatter (one for each two dimensions) reach the driver, which rotates
pairs of dimensions, all disjoint pairs of a round at once, until every off-diagonal entry has vanished against its own diagonal: this keeps
small eigenvalues accurate beside large ones. The whitening matrix (dimensions x components) goes back with the tasks.

Defined cases: a vector that is null, or holds a null, NaN or infinity, is left out; so is one of another length than most distinct
vectors have (the longer of equally frequent lengths); entries beyond 2^61 / scale in size are taken as that; a null vec_id is
kept, and equal rows each give their rows; a component without variance (fewer distinct vectors than dimensions, constant or dependent
dimensions) has whitened 0 and is left out of identity_error; a deviation that doesn't fit into a long is null; an empty table, or one
without a usable vector, gives an empty result; other columns are ignored; long vectors cost their dimensions' square in each task
and the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import parts_for, stored

EPS = float(np.finfo(float).eps)
LIMB = 20  # bits: products of two limbs, added over BLOCK rows, are exact in doubles
BLOCK = 4096  # rows
SHARE = 40  # bits of each of the longs that a large sum travels in
MOST = 2.0**61


def whole_vectors(embeddings: DataFrame, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(vec_id, x): usable vectors as whole numbers floor(scale * c) + offset."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    x = F.transform("embedding", lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(MOST)), F.lit(-MOST))).cast("long") + offset)
    return embeddings.where(F.col("embedding").isNotNull() & finite).select("vec_id", x.alias("x"))


def matrix(batch: pa.RecordBatch, column: str, d: int) -> np.ndarray:
    lists = batch.column(column)
    return np.asarray(lists.flatten(), np.int64).reshape(len(lists), d)


def shares(number: int) -> list[int]:
    """A whole number as four longs, the last with the sign, whose sums stay longs over millions of tasks."""
    return [number >> SHARE * i & (1 << SHARE) - 1 for i in range(3)] + [number >> SHARE * 3]


def sums(x: np.ndarray) -> list[int]:
    high, low = x >> 31, x & (1 << 31) - 1
    return [(int(a) << 31) + int(b) for a, b in zip(high.sum(axis=0), low.sum(axis=0), strict=True)]


def products(y: np.ndarray) -> np.ndarray:
    """y'y exactly, as Python's whole numbers."""
    limbs, rest = [], y
    while True:
        high = (rest + (1 << LIMB - 1)) >> LIMB
        limbs.append((rest - (high << LIMB)).astype(float))
        if not high.any():
            break
        rest = high
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            total += (a.T @ b).astype(np.int64).astype(object) << LIMB * (i + j)
    return total


def gathered(vectors: DataFrame, run, keys: int) -> dict[tuple[int, ...], int]:
    """The totals of what `run` gives for each task, by its `keys` first columns: whole numbers as shares."""
    names, rest = [f"k{i}" for i in range(keys)], [f"s{i}" for i in range(4)]

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = run(batches)
        cut = [shares(v) for _, v in found]
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k, _ in found], pa.int32()) for i in range(keys)), *(pa.array([c[i] for c in cut], pa.int64()) for i in range(4))], [*names, *rest])

    told = vectors.mapInArrow(wrapped, ", ".join([f"{n} int" for n in names] + [f"{n} long" for n in rest]))
    total = told.groupBy(*names).agg(*[F.sum(n).alias(n) for n in rest]).collect()  # dimensions, or their square, at most
    return {tuple(r[:keys]): sum(int(v) << SHARE * i for i, v in enumerate(r[keys:])) for r in total}


def jacobi(a: np.ndarray, most_sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric positive semidefinite matrix."""
    d = len(a)
    a, v = a.astype(float).copy(), np.eye(d)
    seats = list(range(d + d % 2))  # a tournament: every two dimensions meet once in a sweep, half of all pairs' members at a time
    floor = EPS * EPS * max(float(np.abs(np.diag(a)).max(initial=0)), np.finfo(float).tiny)
    for _ in range(most_sweeps):
        rotated = False
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            met = [(min(p, q), max(p, q)) for p, q in zip(seats[:half], reversed(seats[half:]), strict=True) if max(p, q) < d]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            if not met:
                continue
            p, q = np.array(met).T
            apq, app, aqq = a[p, q], a[p, p], a[q, q]
            turn = np.abs(apq) > np.maximum(floor, EPS * np.sqrt(np.maximum(app, 0) * np.maximum(aqq, 0)))
            if not turn.any():
                continue
            rotated = True
            p, q, apq, app, aqq = p[turn], q[turn], apq[turn], app[turn], aqq[turn]
            theta = (aqq - app) / (2 * apq)
            t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1))
            c = 1 / np.hypot(t, 1)
            s = t * c
            for m in (a, a.T, v.T):  # rows, columns, and the vectors
                one, other = m[p].copy(), m[q].copy()
                m[p], m[q] = c[:, None] * one - s[:, None] * other, s[:, None] * one + c[:, None] * other
            a[p, q] = a[q, p] = 0
            a[p, p], a[q, q] = app - t * apq, aqq + t * apq
        if not rotated:
            break
    else:
        raise ArithmeticError(f"off-diagonal entries are left after {most_sweeps} sweeps")
    order = np.argsort(-np.diag(a), kind="stable")
    v = v[:, order]
    return np.diag(a)[order], v / np.linalg.norm(v, axis=0)


@dataclass
class Whitening:
    """What fit() learns. centre and rest: the mean is centre + rest / n, in whole numbers."""

    n: int
    centre: list[int]
    rest: list[int]
    values: np.ndarray  # eigenvalues of the components
    vectors: np.ndarray  # dimensions x components
    trace: float
    identity_error: float = 0.0

    @property
    def matrix(self) -> np.ndarray:
        """dimensions x components, for centred vectors; zero for a component without variance."""
        return self.vectors / np.where(self.values > 0, np.sqrt(np.maximum(self.values, np.finfo(float).tiny)), math.inf)

    def less_centre(self, x: np.ndarray) -> np.ndarray:
        return x - np.array(self.centre, np.int64)

    def project(self, y: np.ndarray) -> np.ndarray:
        return (y - np.array([r / self.n for r in self.rest])) @ self.matrix

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """The sums of (n x - S)^2, exactly; null beyond a long."""
        most = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.rest), default=0)
        if most * most * y.shape[1] < 1 << 63:
            z = self.n * y - np.array(self.rest, np.int64)
            return (z * z).sum(axis=1).tolist()
        z = self.n * y.astype(object) - np.array(self.rest, object)
        return [v if v < 1 << 63 else None for v in (z * z).sum(axis=1)]


def fit(vectors: DataFrame, components: int = 16) -> Whitening | None:
    """The whitening of (x), each distinct one counted once; None if there is none."""
    distinct = stored(vectors.select("x").distinct(), "vectors", parts_for(vectors))
    length = distinct.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if length is None:
        return None
    d, n = length
    kept = distinct.where(F.size("x") == d)

    def added(batches: Iterator[pa.RecordBatch]) -> list:
        total = [0] * d
        for b in batches:
            total = [s + t for s, t in zip(total, sums(matrix(b, "x", d)), strict=True)]
        return [((i,), s) for i, s in enumerate(total)]

    total = gathered(kept, added, 1)
    total = [total[i,] for i in range(d)]
    centre = [(2 * s + n) // (2 * n) for s in total]
    model = Whitening(n, centre, [s - n * c for s, c in zip(total, centre, strict=True)], np.zeros(0), np.zeros((d, 0)), 0.0)

    def scattered(batches: Iterator[pa.RecordBatch]) -> list:
        found = np.zeros((d, d), object)
        for b in batches:
            y = model.less_centre(matrix(b, "x", d))
            for i in range(0, len(y), BLOCK):
                found += products(y[i : i + BLOCK])
        return [((i, j), int(found[i, j])) for i in range(d) for j in range(i, d)]

    scatter = gathered(kept, scattered, 2)
    covariance = np.zeros((d, d))
    for (i, j), v in scatter.items():
        covariance[i, j] = covariance[j, i] = (n * v - model.rest[i] * model.rest[j]) / (n * n)
    values, axes = jacobi(covariance)
    model.trace = sum(n * scatter[i, i] - model.rest[i] ** 2 for i in range(d)) / (n * n)
    model.vectors = axes[:, :components]
    # an eigenvalue below what rounding of its own dimensions' variances can make is none
    noise = 4 * EPS * (np.abs(model.vectors) * np.sqrt(np.diag(covariance))[:, None]).sum(axis=0) ** 2
    model.values = np.where(values[:components] > noise, values[:components], 0.0)

    k = len(model.values)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((k + 1, k))
        for b in batches:
            w = model.project(model.less_centre(matrix(b, "x", d)))
            own[:k] += w.T @ w
            own[k] += w.sum(axis=0)
        i, j = np.divmod(np.arange((k + 1) * k), max(k, 1))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(own.ravel())], ["i", "j", "v"])

    again = np.zeros((k + 1, k))
    for i, j, v in kept.mapInArrow(seen, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():  # components squared at most
        again[i, j] = v / n
    spread = model.values > 0
    error = np.abs(again[:k] - np.outer(again[k], again[k]) - np.eye(k))[spread][:, spread]
    model.identity_error = float(error.max(initial=0))
    return model


def whitened(embeddings: DataFrame, components: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every usable vector and component."""
    vectors = whole_vectors(embeddings, scale, offset)
    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(vectors, components)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    d, k = model.vectors.shape
    explained = [float(e / model.trace) if e else 0.0 for e in model.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b, "x", d)
            for i in range(0, len(x), BLOCK):
                y = model.less_centre(x[i : i + BLOCK])
                m = len(y)
                each = np.repeat(np.arange(i, i + m), k)
                columns = [b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n), pa.int64()), pa.array(model.deviations(y), pa.int64()).take(pa.array(each - i))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(model.project(y).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, model.identity_error))], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.where(F.size("x") == d).mapInArrow(run, schema)
