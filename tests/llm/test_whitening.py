"""Operator 13 against a library's eigenvectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import whitening


def fitted(rows):
    """The contract in numpy: (x of each row, n, S, eigenvalues, eigenvectors, trace)."""
    x = np.floor(64 * np.array(rows, float)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    z = u - s / n
    v = z.T @ z / n
    values, vectors = np.linalg.eigh(v)
    return x, n, s, values[::-1], vectors[:, ::-1], np.trace(v)


def symmetric(kind, n, rng):
    if kind == "random":
        a = rng.standard_normal((n, n))
        return a @ a.T
    if kind == "equal":
        return np.eye(n) * 3
    if kind == "low rank":
        a = rng.standard_normal((n, 5))
        return a @ a.T
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    if kind == "fourfold":
        return q @ np.diag(np.repeat(np.arange(1.0, n // 4 + 1), 4)) @ q.T
    return q @ np.diag(10.0 ** -np.linspace(0, 9, n)) @ q.T


@pytest.mark.parametrize(("kind", "n"), [("random", 1), ("random", 2), ("random", 3), ("random", 64), ("equal", 40), ("low rank", 64), ("fourfold", 64), ("falling", 120), ("equal", 1)])
def test_components_of_symmetric_matrices(kind, n):
    a = symmetric(kind, n, np.random.default_rng(n))
    a = (a + a.T) / 2
    values, x = whitening.leading_components(a, 16)
    assert len(values) == min(16, n) and (np.diff(values) <= 1e-12 * values[0]).all()
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1][:16]).max() < 1e-12 * values[0]
    assert np.abs(a @ x - x * values).max() < 1e-12 * values[0]
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-11


def test_sturm_counts():
    rng = np.random.default_rng(3)
    d, e = rng.standard_normal(30), rng.standard_normal(29)
    e[10] = 0.0
    own = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = np.linspace(-4, 4, 57)
    assert (whitening.counts_below(d, e, at) == (own[None, :] < at[:, None]).sum(1)).all()


def test_query_equals_numpy(spark, tmp_path):
    rng = np.random.default_rng(13)
    base = (rng.standard_normal((300, 24)) @ rng.standard_normal((24, 24)) + 5).astype(np.float32)
    rows = [(k, [float(c) for c in base[k % 250]], 1, "x") for k in range(300)]  # fifty copies
    odd = [(900, None, 1, "x"), (901, [None] + [0.5] * 23, 1, "x"), (902, [float("nan")] * 24, 1, "x"), (903, [float("inf")] + [0.0] * 23, 1, "x"), (904, [1.0, 2.0], 1, "x"), (905, [], 1, "x")]
    spark.createDataFrame([*rows, *odd, (None, rows[7][1], 1, "x"), rows[8]], "vec_id long, embedding array<float>, n int, x string").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.op13_whitening(spark, str(tmp_path)).toPandas()
    kept = [*rows, (None, rows[7][1]), rows[8]]
    x, n, s, values, vectors, trace = fitted([r[1] for r in kept])
    assert n == 250 and len(got) == 16 * len(kept) and set(got["n"]) == {250}
    want = (x - s / n) @ vectors[:, :16] / np.sqrt(values[:16])
    far = ((n * x - s) ** 2).sum(1)
    place = {r[0]: k for k, r in enumerate(kept)}
    for k in range(16):
        c = got[got["component"] == k + 1]
        at = [place[None if np.isnan(i) else int(i)] for i in c["vec_id"].astype(float)]
        sign = np.sign((want[at, k] * c["whitened"]).sum())
        assert np.abs(want[at, k] * sign - c["whitened"]).max() < 1e-8
        assert (far[at] == c["deviation"]).all()
        assert np.abs(c["explained"] - values[k] / trace).max() < 1e-12
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-10


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_fit(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(df).select("vec_id", "whitened", "explained").collect() == []


def test_fewer_components_where_columns_are_constant(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(k, [float(a), 3.0, float(b), float(a + b)]) for k, (a, b) in enumerate(rng.integers(-9, 9, (60, 2)))], "vec_id long, embedding array<double>")
    out = whitening.whiten(df).collect()
    assert {len(r["whitened"]) for r in out} == {2}
    w = np.unique(np.array([r["whitened"] for r in out]).round(9), axis=0)
    assert np.abs(w.T @ w / len(w) - np.eye(2)).max() < 1e-6


def test_huge_components_and_exact_deviations(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])]
    out = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = [[2**52 + 10**6, 10**6], [-(2**52) + 10**6, 64 + 10**6], [10**6, 128 + 10**6]]
    s = [sum(r[k] for r in x) for k in (0, 1)]
    assert out == {k + 1: sum((3 * r[j] - s[j]) ** 2 for j in (0, 1)) for k, r in enumerate(x)}


def test_lengths(spark):
    df = spark.createDataFrame([(k, [float(k), float(k * k % 7)]) for k in range(9)] + [(k, [float(k)] * 3) for k in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whiten(df).agg(F.count("*")).first()[0] == 9
