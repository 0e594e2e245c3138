"""Whitening by cyclic Jacobi: a distributed centred scatter, rotations on the driver, a broadcast matrix.

Entries become whole numbers, so that sums over the cluster are exact in any order. The distinct vectors are the fit list.
A first pass sums their dimensions; a second one subtracts the whole numbers nearest to the means and then multiplies,
and what the centre still lacks is put right with exact fractions. The covariance, of a dimension's square, goes to the driver, where
rotations of disjoint pairs run through all pairs until each off-diagonal is nothing beside its two diagonals; that
stop keeps small eigenvalues accurate. Components come sorted by falling eigenvalue, and their matrix is broadcast.

Defined results: vectors that are null or hold a null, infinite or not-a-number entry are left out, as are empty ones; entries
beyond 2^61 / scale are held there; vectors of another length are a space of their own, with its own fit; rows that repeat an id, or have none,
each give their rows, and equal vectors count once in the fit; a component without variance has whitened 0 and isn't
part of identity_error; a deviation that 38 digits can't hold is null; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, tidied
from .vectors import by_length, floored, whole

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
SWEEPS = 60
#: A double holds whole numbers up to here.
EXACT = float(1 << 53)


@dataclass(frozen=True)
class Centre:
    """Of the vectors of one length: how many, the whole numbers nearest to the means, and sums of what is left."""

    n: int
    nearest: np.ndarray
    rest: tuple[int, ...]


@dataclass(frozen=True)
class Space:
    """A centre, and its components: a matrix that whitens what is centred, and eigenvalues as shares of the trace."""

    centre: Centre
    matrix: np.ndarray
    explained: np.ndarray


def jacobi(a: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric matrix without negative eigenvalues.

    A sweep meets every pair once, in rounds of disjoint pairs (as in a tournament where one stays and the others move on).
    """
    d = len(a)
    a, v = a.astype(float).copy(), np.eye(d)
    ring = np.arange(d + d % 2)
    eps = np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            p, q = ring[: len(ring) // 2], ring[len(ring) // 2 :][::-1]
            real = (p < d) & (q < d)
            p, q = p[real], q[real]
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
            off = np.abs(a[p, q]) > eps * np.sqrt(np.abs(a[p, p] * a[q, q]))
            if not off.any():
                continue
            turned, p, q = True, p[off], q[off]
            with np.errstate(over="ignore"):
                tau = (a[q, q] - a[p, p]) / (2 * a[p, q])
            t = np.where(tau < 0, -1.0, 1.0) / (np.abs(tau) + np.hypot(1.0, tau))
            c = 1 / np.hypot(1.0, t)
            s = t * c
            ap, aq = a[p], a[q]
            a[p], a[q] = c[:, None] * ap - s[:, None] * aq, s[:, None] * ap + c[:, None] * aq
            ap, aq = a[:, p], a[:, q]
            a[:, p], a[:, q] = c * ap - s * aq, s * ap + c * aq
            a[p, q] = a[q, p] = 0.0
            vp, vq = v[:, p], v[:, q]
            v[:, p], v[:, q] = c * vp - s * vq, s * vp + c * vq
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[:, order]


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, x`` of the rows that count; x is an array of long."""
    v = F.col(vector_col)
    return df.where(whole(v) & (F.size(v) > 0)).select(F.col(id_col).cast("long").alias("vec_id"), floored(v, SCALE, OFFSET).alias("x"))


def _sums(fit: DataFrame) -> dict[int, Centre]:
    """Exact sums of each dimension: high and low halves are summed apart, as long can't overflow then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            for d, rows, x in by_length(b.column(0)):
                now = total.setdefault(d, [0, np.zeros(d, object)])
                now[0] += len(rows)
                now[1] += ((x >> 32).sum(0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
        for d, (n, sums) in total.items():
            columns = [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([str(s) for s in sums], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["d", "i", "n", "total"])

    parts = fit.mapInArrow(tidied(run), "d int, i int, n long, total string")
    each = parts.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out: dict[int, dict[int, tuple[int, int]]] = {}
    for r in each.collect():  # a row for each dimension
        out.setdefault(r["d"], {})[r["i"]] = (r["n"], int(r["total"]))
    centres = {}
    for d, sums in out.items():
        n = sums[0][0]
        nearest = [(2 * sums[i][1] + n) // (2 * n) for i in range(d)]
        centres[d] = Centre(n, np.array(nearest, np.int64), tuple(sums[i][1] - n * nearest[i] for i in range(d)))
    return centres


def _centred(x: np.ndarray, centre: Centre) -> np.ndarray:
    """Entries without the nearest whole numbers; exact, as whole numbers of two bounded entries are within long."""
    return x - centre.nearest


def _gram(fit: DataFrame, centres: dict[int, Centre], spaces: dict[int, Space] | None = None) -> dict[int, np.ndarray]:
    """Sums of products of a column of ones and the centred columns, whitened if ``spaces`` are given; a matrix for each length.

    Tasks send a matrix each, however many rows they read; sums of whole numbers below 2^53 are exact.
    """
    shared = fit.sparkSession.sparkContext.broadcast((centres, spaces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, spaces = shared.value
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, rows, x in by_length(b.column(0)):
                z = _centred(x, centres[d]).astype(float) if spaces is None else whitened(x, spaces[d])
                z = np.hstack([np.ones((len(rows), 1)), z])
                total[d] = total.get(d, 0.0) + z.T @ z
        for d, g in total.items():
            k = len(g)
            lists = pa.ListArray.from_arrays(pa.array(range(0, k * k + 1, k), pa.int32()), pa.array(g.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([d] * k, pa.int32()), pa.array(range(k), pa.int32()), lists], ["d", "i", "row"])

    parts = fit.mapInArrow(tidied(run), "d int, i int, row array<double>").select("d", "i", F.posexplode("row").alias("j", "v"))
    sums = parts.groupBy("d", "i", "j").agg(F.sum("v").alias("v"))
    lines = sums.groupBy("d", "i").agg(F.array_sort(F.collect_list(F.struct("j", "v")))["v"].alias("row"))
    out: dict[int, dict[int, list[float]]] = {}
    for r in lines.collect():  # a row for each dimension
        out.setdefault(r["d"], {})[r["i"]] = r["row"]
    shared.unpersist()
    return {d: np.array([rows[i] for i in range(len(rows))]) for d, rows in out.items()}


def covariance(gram: np.ndarray, centre: Centre) -> np.ndarray:
    """Covariance with divisor n of whole numbers, rounded once."""
    n, rest, g = centre.n, centre.rest, gram[1:, 1:]
    if np.abs(g).max() >= EXACT:
        r = np.array(rest, float)
        return g / n - np.outer(r / n, r / n)
    out, d = np.empty_like(g), len(g)
    for i in range(d):
        for j in range(i, d):
            out[i, j] = out[j, i] = (n * int(g[i, j]) - rest[i] * rest[j]) / (n * n)
    return out


def whitened(x: np.ndarray, space: Space) -> np.ndarray:
    c = space.centre
    return (_centred(x, c) - np.array([r / c.n for r in c.rest])) @ space.matrix


def deviations(x: np.ndarray, centre: Centre) -> list[str]:
    """Sums over dimensions of (n x - S)^2, exact, as texts."""
    y, n, d = _centred(x, centre), centre.n, x.shape[1]
    most = max(int(np.abs(y).max()), 1) if len(y) else 1
    # y in place of x: (n y - rest)^2 summed is n^2 sum(y^2) - 2 n sum(y rest) + sum(rest^2).
    if 4 * d * n * n * most * most >= 1 << 62:
        y = y.astype(object)
    rest = np.array(centre.rest, y.dtype)
    out = n * n * (y * y).sum(1) - 2 * n * (y * rest).sum(1) + (rest * rest).sum()
    return [str(v) for v in out]


def fit_spaces(fit: DataFrame, components: int = COMPONENTS) -> tuple[dict[int, Space], dict[int, float]]:
    """The space of each length, and the largest error of the whitened covariance."""
    centres = _sums(fit)
    spaces = {}
    for d, g in _gram(fit, centres).items():
        v = covariance(g, centres[d])
        values, columns = jacobi(v)
        trace = float(np.trace(v))
        some = values > d * np.finfo(float).eps * trace
        roots = np.sqrt(np.where(some, values, 1.0))
        matrix = np.where(some, columns / roots, 0.0)[:, :components]
        shares = np.where(some, values / (trace or 1.0), 0.0)[:components]
        spaces[d] = Space(centres[d], matrix, shares)
    errors = {}
    for d, g in _gram(fit, centres, spaces).items() if spaces else ():
        n, mean = spaces[d].centre.n, g[0, 1:] / spaces[d].centre.n
        real = spaces[d].explained > 0
        off = np.abs(g[1:, 1:] / n - np.outer(mean, mean) - np.eye(len(mean)))[np.ix_(real, real)]
        errors[d] = float(off.max()) if off.size else 0.0
    return spaces, errors


def whiten(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation`` (decimal), ``whitened, explained, identity_error``: a row for each vector that counts and component."""
    rows = vectors(df, id_col, vector_col)
    fit = staged(rows.select("x").distinct(), "whitening-fit")
    spaces, errors = fit_spaces(fit, components)
    shared = df.sparkSession.sparkContext.broadcast((spaces, errors))
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces, errors = shared.value
        for b in batches:
            for d, own, x in by_length(b.column(1)):
                s = spaces[d]
                m, k = len(own), len(s.explained)
                each, size = np.repeat(np.arange(m), k), m * k
                columns = [
                    b.column(0).take(pa.array(own)).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(size, s.centre.n, np.int64)),
                    pa.array(deviations(x, s.centre), pa.string()).take(pa.array(each)),
                    pa.array(whitened(x, s).ravel()),
                    pa.array(np.tile(s.explained, m)),
                    pa.array(np.full(size, errors[d])),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    out = rows.mapInArrow(tidied(run), "vec_id long, component int, n long, deviation string, whitened double, explained double, identity_error double")
    return out.withColumn("deviation", F.col("deviation").try_cast("decimal(38,0)"))
