"""Hard negatives against Python's integers: packed products of every width, ties, bands, awkward rows."""

import math

import numpy as np
import pytest

from pedolake.llm import hard_negatives
from pedolake.llm.hard_negatives import MiningParams, Products, mine_negatives

SCHEMA = "id long, label long, vector array<double>, score string, n string, dims string"


@pytest.mark.parametrize("dims", [1, 7, 64])
@pytest.mark.parametrize("most", [0, 1, 200, 4096, 1 << 20, (1 << 24) - 1])
def test_packed_products(dims, most):
    rng = np.random.default_rng(dims)
    b, a = (rng.integers(-most, most + 1, (n, dims)) for n in (67, 9))
    for end in (b, a):
        end[0] = most
        end[-1] = -most
    want = [[sum(x * y for x, y in zip(u, v, strict=True)) for v in b.tolist()] for u in a.tolist()]
    assert Products(b.astype(np.int32)).scores(a.astype(np.int32)).tolist() == want
    wide = Products(b.astype(np.int32))
    less = wide.bias * a.sum(1)
    assert (wide._long(a, -(-wide.width(a) // 8)) - less[:, None]).tolist() == want


def plain(rows, p):
    """The contract, row by row."""
    good = [
        (i, lab, [math.floor(p.scale * c) for c in v])
        for i, lab, v in rows
        if i is not None and lab is not None and v and all(c is not None and math.isfinite(c) and abs(math.floor(p.scale * c)) < 1 << 24 for c in v)
    ]
    out = []
    for k, (i, lab, v) in enumerate(good):
        if i % p.every:
            continue
        near = [(sum(x * y for x, y in zip(v, w, strict=True)), j, other) for m, (j, other, w) in enumerate(good) if m != k and len(w) == len(v)]
        same = sorted(((-s, j) for s, j, other in near if other == lab))[: p.positives]
        for less, j in same:
            s = -less
            hard = sorted((-t, m) for t, m, other in near if other != lab and p.least_percent * s <= 100 * t <= p.most_percent * s)
            out += [(i, j, r + 1, m, s, -t) for r, (t, m) in enumerate(hard[: p.negatives])]
    return sorted(out)


def got(spark, rows, p=None, tasks=3):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(tasks)
    return sorted(tuple(r) for r in mine_negatives(spark, df, p).collect())


def test_clusters_with_ties(spark):
    """Few distinct vectors, so that scores tie; several groups and blocks of anchors."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 6)) + 1
    rows = [(i, int(rng.integers(4)), (centres[rng.integers(12)] + 0.05 * rng.integers(-1, 2, 6)).tolist()) for i in range(4000)]
    p = MiningParams(every=10)
    want = plain(rows, p)
    assert len(want) > 2000 and got(spark, rows, p) == want


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(50 * i, i % 2, [1.0, 0.5 + i / 10]) for i in range(6)] + [(i, i % 3, [0.9, i / 7]) for i in range(1, 9)]
    rows += [(100, 0, [1.0, 0.7]), (100, 0, [1.0, 0.7])]  # one id on three rows
    rows += [(None, 0, [1.0, 1.0]), (150, None, [1.0, 1.0]), (200, 1, None), (250, 1, []), (300, 0, [1.0, None]), (350, 1, [nan, 1.0])]
    rows += [(400, 0, [inf, 1.0]), (450, 0, [1e9, 1.0]), (500, 0, [1.0, 2.0, 3.0]), (501, 0, [1.0, 2.0, 3.0]), (502, 1, [0.5, 1.5, 2.0])]
    rows += [(550, 0, [60000.0, 60000.0]), (551, 0, [59999.0, 60001.5]), (552, 1, [40000.0, 50000.0]), (-50, 1, [-1.0, -1.0]), (-1, 1, [0.0, 0.0])]
    want = plain(rows, MiningParams())
    assert {r[0] for r in want} >= {100, 500, 550} and got(spark, rows) == want


def test_nothing(spark):
    assert got(spark, []) == [] == got(spark, [(1, 1, [1.0])]) == got(spark, [(50, 1, None)])


def test_labels_of_one_row_each(spark):
    rows = [(i, i, [float(i), 1.0]) for i in range(0, 500, 5)]
    assert got(spark, rows) == []


def test_query_moves_labels(spark):
    table = spark.createDataFrame([(i, [1.0, i / 100], i % 3) for i in range(120)], "vec_id long, embedding array<float>, label int")
    rows = [(i, (i % 3 + 1) % 10 if i % 7 == 0 else i % 3, [1.0, float(np.float32(i / 100))]) for i in range(120)]
    want = plain(rows, MiningParams())
    assert want and sorted(tuple(r) for r in hard_negatives.hard_negatives(spark, table).collect()) == want
