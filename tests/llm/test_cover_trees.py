"""Cover trees: their invariants, exact pairs of two trees, pruning on clustered vectors, repeated ids."""

import numpy as np
import pytest

from pedolake.llm import embedding_join as ej


def clustered(n_clusters, each, dim=16, spread=0.01, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n_clusters, dim))
    return ej.unit(np.repeat(centres, each, 0) + spread * rng.normal(size=(n_clusters * each, dim)))


@pytest.mark.parametrize("x", [clustered(20, 15), clustered(200, 1), clustered(1, 60, spread=1e-9), np.ones((5, 4)) / 2])
def test_levels_are_nested_and_cover(x):
    tree = ej.CoverTree.build(x)
    seen, stack = [], [(0, 4.0)]
    while stack:
        node, above = stack.pop()
        kids = np.arange(tree.first[node], tree.last[node])
        if not len(kids):
            seen.append(tree.centre[node])
            continue
        assert tree.centre[kids[0]] == tree.centre[node]  # nested
        assert tree.radius[node] <= above
        below, inner = [], list(kids)
        while inner:
            k = inner.pop()
            below.append(tree.centre[k])
            inner += range(tree.first[k], tree.last[k])
        assert np.linalg.norm(x[below] - x[tree.centre[node]], axis=1).max() <= tree.radius[node] + 1e-12
        stack += [(k, max(tree.radius[node], 1e-5)) for k in kids]
    assert sorted(seen) == list(range(len(x)))


def test_pairs_of_two_trees_are_exact_and_few_are_compared():
    x, y = clustered(60, 10, seed=1), clustered(60, 10, seed=1)[::3]
    a, b = ej.CoverTree.build(x), ej.CoverTree.build(y)
    for p, u, q, v in ((a, x, b, y), (a, x, a, x)):
        found, looked = set(), 0
        for i, j in ej.near_leaves(p, u, q, v, ej.reach(0.95)):
            looked += len(i)
            found |= {(min(s, t), max(s, t)) if p is q else (s, t) for s, t in zip(i.tolist(), j.tolist()) if u[s] @ v[t] >= 0.95}
        near = u @ v.T >= 0.95
        want = {(i, j) for i, j in zip(*map(list, np.nonzero(near))) if p is not q or i < j}
        assert found == want and looked < 0.1 * len(u) * len(v)


def test_rows_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.01, 1.0]), (2, [1.0, 0.001]), (None, [1.0, 0.0]), (7, None)]
    out = ej.threshold_join(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    got = sorted(((r["vec_id"] or 0), r["n_links"], r["component_id"], r["kept"]) for r in out)
    assert got == [(0, 2, 1, False), (1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (2, 2, 1, False), (7, 0, 7, True)]


def test_every_length_is_joined(spark):
    rows = [(2 * n + k, [1.0] * (n + 1)) for n in range(4) for k in range(2)]
    out = ej.threshold_join(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out) == [(i, 1, i - i % 2) for i in range(8)]
