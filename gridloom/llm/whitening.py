"""Operator 13, embedding whitening.

Vectors become integers, floor(scale * c) + shift; the fit list has each distinct one once. Its sums are counted
exactly; then every vector, centred on the rounded mean, adds its outer product within its task (whole numbers, so float64 holds the sums
exactly below 2**53, in any order), and what rounding the mean left out, half a unit at most a dimension, is taken off at the end. The
covariance, a matrix of the vectors' width, is reduced to tridiagonal form by Householder reflections; its leading eigenvalues
come from bisection on Sturm counts, all at once, and its eigenvectors from inverse iteration, orthogonalised again within clusters of close
eigenvalues, and values are taken once more as Rayleigh quotients of the matrix itself. Components are projected on by a broadcast of
width x components numbers. A second pass over the fit list measures the covariance of what came out.

Vectors null or with null or non-finite components take no part, nor do those of another length than the most frequent (ties: the
longer): a covariance has one width. Scaled components beyond 2**52 count as 2**52. Repeated rows: each is returned, and fits once. Null
vec_id: as any other row. Eigenvalues below 1e-12 of the largest are no components, so constant columns and fewer vectors than dimensions give
fewer. Equal eigenvalues: any basis of their space. No vectors, or one distinct: an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import read, stored

SCALE, SHIFT, COMPONENTS, LEAST, MOST = 64, 1_000_000, 16, 1e-12, 2.0**52


class Whitening(NamedTuple):
    """What a fit gives: rows, sums and rounded means of each dimension, eigenvalues and unit eigenvectors (a column each) of the leading components, and the trace."""

    n: int
    sums: list[int]
    centre: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float


_NONE = Whitening(0, [], np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)), 0.0)

# ---- eigenvectors of a symmetric matrix


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflections) of a symmetric matrix: each reflection is the unit vector of one Householder step."""
    a, n, reflections = a.copy(), len(a), []
    for k in range(n - 2):
        x = a[k + 1 :, k]
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(v)
        v = v / size if size > 0 else v
        reflections.append(v)
        rest = a[k + 1 :, k + 1 :]
        p = rest @ v
        w = 2 * (p - v * (v @ p))
        a[k + 1 :, k + 1 :] = rest - np.outer(v, w) - np.outer(w, v)
        a[k + 1 :, k] -= 2 * v * (v @ x)
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflections


def counts_below(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each of these numbers: the negative terms of a Sturm sequence."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    below, q = np.zeros(len(at), int), np.ones(len(at))
    for k in range(len(d)):
        q = d[k] - at - (e[k - 1] ** 2 / q if k else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        below += q < 0
    return below


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection of all of them at once."""
    radius = np.abs(np.concatenate((e, [0]))) + np.abs(np.concatenate(([0], e)))
    lo, hi = np.full(k, (d - radius).min()), np.full(k, (d + radius).max())
    place = len(d) - 1 - np.arange(k)  # in rising order
    for _ in range(128):
        mid = (lo + hi) / 2
        above = counts_below(d, e, mid) > place
        lo, hi = np.where(above, lo, mid), np.where(above, mid, hi)
    return (lo + hi) / 2


def _solver(d: np.ndarray, e: np.ndarray, shift: float):
    """Solves (T - shift) x = b by elimination with row exchanges."""
    n, small = len(d), np.finfo(float).eps * max(np.abs(d).max(), np.abs(e).max(initial=0), np.finfo(float).tiny)
    u, u1, u2, steps = d - shift, np.concatenate((e, [0.0])), np.zeros(n), []
    for k in range(n - 1):
        below = [e[k], d[k + 1] - shift, e[k + 1] if k + 1 < n - 1 else 0.0]
        if abs(below[0]) > abs(u[k]):
            f = u[k] / below[0]
            steps.append((True, f))
            u[k + 1], u1[k + 1] = u1[k] - f * below[1], -f * below[2]
            u[k], u1[k], u2[k] = below
        else:
            f = below[0] / u[k] if u[k] else 0.0
            steps.append((False, f))
            u[k + 1], u1[k + 1] = below[1] - f * u1[k], below[2]
    u = np.where(np.abs(u) < small, small, u)

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.copy()
        for k, (swap, f) in enumerate(steps):
            if swap:
                x[k], x[k + 1] = x[k + 1], x[k]
            x[k + 1] -= f * x[k]
        for k in reversed(range(n)):
            x[k] = (x[k] - (u1[k] * x[k + 1] if k + 1 < n else 0.0) - (u2[k] * x[k + 2] if k + 2 < n else 0.0)) / u[k]
        return x

    return solve


def inverse_iterated(d: np.ndarray, e: np.ndarray, values: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A unit eigenvector of the tridiagonal matrix for each value, a column each; within a cluster of close values each is kept orthogonal to those before."""
    spread = max(np.abs(d).max(initial=0) + 2 * np.abs(e).max(initial=0), np.finfo(float).tiny)
    rng, out, first = np.random.default_rng(13), np.zeros((len(d), len(values))), 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * spread:
            first = k
        # Equal values get shifts a few roundings apart, else the solver would return the same vector.
        solve = _solver(d, e, value - (k - first) * 4 * np.finfo(float).eps * spread)
        x = rng.standard_normal(len(d))
        for _ in range(rounds):
            for _ in range(2):
                x = x - out[:, first:k] @ (out[:, first:k].T @ x)
            x = solve(x / np.linalg.norm(x))
        for _ in range(2):
            x = x - out[:, first:k] @ (out[:, first:k].T @ x)
        out[:, k] = x / np.linalg.norm(x)
    return out


def leading_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling, and their unit eigenvectors, a column each) of the k leading components of a symmetric matrix."""
    k, scale = min(k, len(v)), float(np.abs(v).max(initial=0)) or 1.0
    d, e, reflections = tridiagonal(v / scale)
    x = inverse_iterated(d, e, leading_values(d, e, k))
    for j in reversed(range(len(reflections))):
        r = reflections[j]
        x[j + 1 :] -= 2 * np.outer(r, r @ x[j + 1 :])
    x /= np.linalg.norm(x, axis=0)
    own = np.einsum("ij,ij->j", x, (v / scale) @ x)
    order = np.argsort(-own, kind="stable")
    return own[order] * scale, x[:, order]


# ---- the fit


def integers(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x) of the vectors that take part, x of longs."""
    scaled = F.transform("embedding", lambda c: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), c.cast("double") * scale)))
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return vectors.where("embedding is not null").where(~bad).select("vec_id", F.transform(scaled, lambda c: F.floor(c) + F.lit(shift).cast("bigint")).alias("x"))


def _chunks(batches, width: int, rows: int = 8192):
    """Vectors of a column of longs, as matrices."""
    for batch in batches:
        flat = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False)
        m = flat.reshape(batch.num_rows, width)
        for a in range(0, len(m), rows):
            yield m[a : a + rows]


def _summed(parts: DataFrame, kind: str) -> DataFrame:
    """(i, v): sums of the rows (i, part, v) of all tasks, place by place: 1024 tasks' at a time, then those of these sums."""

    def add(t: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": t["i"][:1], "part": t["part"][:1] // 1024, "v": [np.sum(np.stack(t.sort_values("part")["v"].to_list()), axis=0)]})

    schema = f"i int, part int, v array<{kind}>"
    return parts.groupBy("i", F.expr("part div 1024")).applyInPandas(add, schema).groupBy("i").applyInPandas(add, schema).select("i", "v")


def _part() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _rows(i: int, m: np.ndarray, kind) -> pa.RecordBatch:
    """Rows (i, part, v), from i on, of a matrix."""
    return pa.RecordBatch.from_arrays([pa.array(range(i, i + len(m)), pa.int32()), pa.array([_part()] * len(m), pa.int32()), pa.array(list(m), pa.list_(kind))], ["i", "part", "v"])


def moments(fit: DataFrame, width: int, of, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, sums of outer products) of of(rows of x), of `size` columns, over all of fit. What comes back is size + 1 rows a 1024 tasks."""

    def run(batches):
        gram = np.zeros((size + 1, size))
        for m in _chunks(batches, width):
            z = of(m)
            gram[0] += z.sum(0)
            gram[1:] += z.T @ z
        yield _rows(0, gram, pa.float64())

    out = np.zeros((size + 1, size))
    for r in _summed(fit.select("x").mapInArrow(run, "i int, part int, v array<double>"), "double").collect():  # size + 1 rows
        out[r["i"]] = r["v"]
    return out[0], out[1:]


def fit_list(ints: DataFrame) -> tuple[DataFrame, int]:
    """(the distinct x of the most frequent length, stored; that length)."""
    lengths = ints.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n")).where("width > 0")
    top = lengths.orderBy(F.desc("n"), F.desc("width")).first()
    width = top["width"] if top else 0
    return stored(ints.where(F.size("x") == width).select("x").distinct(), "fit-list"), width


def fit(distinct: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of a fit list."""

    def run(batches):
        total = np.zeros((2, width), np.int64)
        for m in _chunks(batches, width):
            total[0] += m.sum(0)
            total[1] += len(m)
        yield _rows(0, total, pa.int64())

    sums = {r["i"]: r["v"] for r in _summed(distinct.mapInArrow(run, "i int, part int, v array<bigint>"), "bigint").collect()}  # 2 rows
    n = int(sums[1][0]) if sums and width else 0
    if n < 2:
        return Whitening(n, [int(x) for x in sums.get(0, [])], np.zeros(width, np.int64), np.zeros(0), np.zeros((width, 0)), 0.0)
    s = [int(x) for x in sums[0]]
    centre = np.array([(2 * x + n) // (2 * n) for x in s], np.int64)
    z, gram = moments(distinct, width, lambda m: (m - centre).astype(np.float64), width)
    off = z / n  # what is left of the mean, half a unit at most
    v = gram / n - np.outer(off, off)
    v = (v + v.T) / 2
    values, vectors = leading_components(v, components)
    kept = values > LEAST * max(values.max(initial=0), np.finfo(float).tiny)
    return Whitening(n, s, centre, values[kept], vectors[:, kept], float(np.trace(v)))


def whitened(x: np.ndarray, w: Whitening) -> np.ndarray:
    """Rows of x, centred, on each component, over its deviation."""
    off = np.array([(s - w.n * int(c)) / w.n for s, c in zip(w.sums, w.centre, strict=True)])
    return ((x - w.centre).astype(np.float64) - off) @ (w.vectors / np.sqrt(w.values))


def deviations(x: np.ndarray, w: Whitening) -> list[int]:
    """Each row's sum over dimensions of (n x - S) ** 2, exact at any size."""
    off = [s - w.n * int(c) for s, c in zip(w.sums, w.centre, strict=True)]
    z = x - w.centre
    most = (w.n * float(np.abs(z).max(initial=0)) + max(map(abs, off), default=0)) ** 2 * max(1, x.shape[1])
    kind = np.int64 if most < 2.0**62 else object
    d = z.astype(kind) * w.n - np.array(off, kind)
    return [int(k) for k in (d * d).sum(1)]


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, n, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error) of each vector that takes part."""
    spark = vectors.sparkSession
    ints = stored(integers(vectors, scale, shift), "integer-vectors")
    distinct, width = fit_list(ints)
    w = fit(distinct, width, components) if width else _NONE
    size = len(w.values)
    error = 0.0
    if size:
        total, gram = moments(distinct, width, lambda m: whitened(m, w), size)
        error = float(np.abs(gram / w.n - np.outer(total, total) / w.n**2 - np.eye(size)).max())
    shared = spark.sparkContext.broadcast(w)  # width x components numbers
    explained = [float(e) / w.trace for e in w.values]
    id_kind = ints.schema["vec_id"].dataType.simpleString()

    def run(batches):
        w = shared.value
        for batch in batches:
            m = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, width)
            out = whitened(m, w)
            far = [Decimal(k) if k < 10**38 else None for k in deviations(m, w)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(far, pa.decimal128(38, 0)), pa.array(list(out), pa.list_(pa.float64()))], ["vec_id", "deviation", "whitened"])

    rows = ints.where(F.size("x") == width) if size else ints.limit(0)
    out = rows.select("vec_id", "x").mapInArrow(run, f"vec_id {id_kind}, deviation decimal(38,0), whitened array<double>")
    return out.select("vec_id", F.lit(w.n).cast("bigint").alias("n"), "deviation", "whitened", F.array(*(F.lit(x) for x in explained)).cast("array<double>").alias("explained"), F.lit(error).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(read(spark, sf_dir, "embeddings"))
    each = rows.select("vec_id", "n", F.expr("try_cast(deviation as bigint)").alias("deviation"), F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "c"), "identity_error")
    return each.select("vec_id", (F.col("k") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")
