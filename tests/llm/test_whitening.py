"""Whitening against NumPy's eigenvectors, exact deviations in Python integers, and awkward tables."""

import math

import numpy as np
import pytest

from pedolake.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, deviation string, whitened string, n string"


def x_of(vectors):
    return [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 40])
@pytest.mark.parametrize("kind", ["plain", "equal", "split", "zero"])
def test_pairs(n, kind):
    rng = np.random.default_rng(n)
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    values = {"plain": np.sort(rng.random(n))[::-1], "equal": np.r_[np.full(n - n // 2, 3.0), np.full(n // 2, 1.0)], "split": np.arange(n, 0, -1.0), "zero": np.zeros(n)}[kind]
    v = np.diag(values) if kind == "split" else q @ np.diag(values) @ q.T
    v = (v + v.T) / 2
    got, axes = whitening.leading_pairs(v, n)
    assert np.allclose(got, np.linalg.eigvalsh(v)[::-1], atol=1e-14 * max(1, values.max()) * n)
    assert np.abs(axes.T @ axes - np.eye(n)).max() < 1e-12
    assert np.abs(v @ axes - axes * got).max() < 1e-13 * max(1, n)


def test_whole_table(spark, sf):
    rows = queries.queries()["op11_whitening"](spark, sf).collect()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = x_of(r["embedding"] for r in table)
    n, d = len(x), len(x[0])
    s = [sum(v[k] for v in x) for k in range(d)]
    exact = {r["vec_id"]: sum((n * v[k] - s[k]) ** 2 for k in range(d)) for r, v in zip(table, x, strict=True)}
    y = np.array([[(n * v[k] - s[k]) / n for k in range(d)] for v in x])
    cov = y.T @ y / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(32, d)
    want = y @ axes[:, :k] / np.sqrt(values[:k])
    got = np.full((n, k), np.nan)
    place = {r["vec_id"]: i for i, r in enumerate(table)}
    for r in rows:
        assert r["n"] == n and r["deviation"] == exact[r["vec_id"]]
        assert abs(r["explained"] / (values[r["component"] - 1] / np.trace(cov)) - 1) < 1e-9
        assert r["identity_error"] < 1e-9
        got[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
    assert np.abs(got.T @ got / n - np.eye(k)).max() < 1e-9
    assert np.abs(np.abs((got * want).mean(0)) - 1).max() < 1e-6  # the same axes, either sign


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, [-1.0, 2.0]), (3, [0.1, -0.7])]
    bad = [(4, None), (5, []), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, 2.0, 3.0]), (10, [1e30, 0.0])]
    df = spark.createDataFrame([(i, v, "a", "b", "c") for i, v in good + bad], SCHEMA).repartition(3)
    rows = whitening.whitened_rows(spark, df).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["component"]) for r in rows) == [(False, 1, 1), (False, 1, 1), (False, 1, 2), (False, 1, 2), (False, 3, 1), (False, 3, 2), (True, 0, 1), (True, 0, 2)]
    x = x_of(v for _, v in good)
    s = [sum(v[k] for v in x) for k in range(2)]
    assert {r["deviation"] for r in rows} == {sum((4 * v[k] - s[k]) ** 2 for k in range(2)) for v in x}
    assert all(r["n"] == 4 and r["identity_error"] < 1e-12 for r in rows)


def test_no_variance(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        df = spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], SCHEMA)
        assert whitening.whitened_rows(spark, df).collect() == []


def test_fewer_directions_than_dimensions(spark):
    """A dimension that repeats another has no variance of its own; far values are exact and beyond a long null."""
    rows = [(i, [float(i * i % 7), float(i * i % 7), i * 1e12]) for i in range(20)]
    df = spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], SCHEMA.replace("float", "double"))
    got = whitening.whitened_rows(spark, df).collect()
    assert {r["component"] for r in got} == {1} and {r["deviation"] for r in got} == {None}
    w = whitening.fit(spark, df)
    x = x_of(v for _, v in rows)
    s = [sum(v[k] for v in x) for k in range(3)]
    exact = {i: sum((20 * v[k] - s[k]) ** 2 for k in range(3)) for i, v in enumerate(x)}
    assert {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(spark, df, w).collect()} == exact
