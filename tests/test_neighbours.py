"""Pruned neighbours against all distances: ties, equal rows, folds, incomplete rows, hot blocks, and the share looked at."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pedolake.operators import neighbours
from pedolake.operators.neighbours import distance_totals, nearest

SCHEMA = "vec_id long, fold string, z array<double>, note string"


def frame(spark, ids, folds, z):
    rows = [(int(i), f, None if v is None else [float(x) for x in v], "n") for i, f, v in zip(ids, folds, z, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain(ids, folds, z, t_ids, t_folds, t, k, other_fold):
    out = []
    for i, f, v in zip(ids, folds, z, strict=True):
        near = [] if v is None else sorted((float(np.sqrt(((np.array(v) - w) ** 2).sum())), int(j)) for j, g, w in zip(t_ids, t_folds, t, strict=True) if (g != f if other_fold else j != i))[:k]
        out.append((int(i), near))
    return sorted(out, key=repr)


@pytest.mark.parametrize("other_fold", [False, True])
@pytest.mark.parametrize("kind", ["clusters", "spread", "ties", "equal"])
def test_as_all_pairs(spark, monkeypatch, kind, other_fold):
    monkeypatch.setattr(neighbours, "SERVED", 40)
    rng = np.random.default_rng(6)
    n = 700
    t = {"clusters": rng.normal(size=(7, 5))[rng.integers(7, size=n)] * 50 + rng.normal(size=(n, 5)), "spread": rng.normal(size=(n, 24)), "ties": rng.integers(0, 3, (n, 3)), "equal": np.ones((n, 2))}[kind].astype(float)
    folds = [f"f{i}" for i in (np.arange(n) * 7 // n if kind == "clusters" else rng.integers(3, size=n))]
    q = [*(t[:60] + (kind == "clusters") * 0.3), None, t.mean(0) + 1e3]
    ids, q_folds = [*range(0, 60), 9001, 9002], [*folds[:60], "f0", "elsewhere"]
    got = nearest(frame(spark, ids, q_folds, q), frame(spark, range(n), folds, t), 6, other_fold, block_rows=30)
    assert got.columns == ["vec_id", "fold", "z", "note", "near", "looked"]
    got = sorted(((r["vec_id"], [(x["d"], x["id"]) for x in r["near"]]) for r in got.collect()), key=repr)
    want = plain(ids, q_folds, q, range(n), folds, t, 6, other_fold)
    assert [(i, [j for _, j in near]) for i, near in got] == [(i, [j for _, j in near]) for i, near in want]
    assert all(np.allclose([d for d, _ in a], [d for d, _ in b], rtol=1e-12) for (_, a), (_, b) in zip(got, want, strict=True))


def test_few_or_no_training_rows(spark):
    q = frame(spark, [1, 2, 2], "abb", [[0.0, 1.0], [1.0, 1.0], None])
    none = nearest(q, frame(spark, [5], "a", [None]), 3).collect()
    assert len(none) == 3 and all(r["near"] == [] for r in none)
    few = {(r["vec_id"], r["z"] is None): [x["id"] for x in r["near"]] for r in nearest(q, frame(spark, [1, 7], "ab", [[0.0, 0.0], [9.0, 9.0]]), 3).collect()}
    assert few == {(1, False): [7], (2, False): [1, 7], (2, True): []}


def test_share_of_pairs_falls_with_size(spark):
    """On clustered rows the share of pairs looked at falls as the table grows."""
    shares = []
    for n in (1000, 8000):
        rng = np.random.default_rng(1)
        t = rng.normal(size=(40, 4))[rng.integers(40, size=n)] * 20 + rng.normal(size=(n, 4))
        out = nearest(frame(spark, range(-100, 0), "x" * 100, t[:100]), frame(spark, range(n), "x" * n, t), 5)
        shares.append(sum(r["looked"] for r in out.collect()) / (100 * n))
    assert shares[0] < 0.06 and shares[1] < 0.65 * shares[0]


def test_totals(spark):
    rng = np.random.default_rng(3)
    t = rng.normal(size=(2500, 3))
    ids = [*range(2499), 0]  # one id twice
    got = distance_totals(frame(spark, ids, "x" * 2500, t), group_rows=600).collect()
    d = np.sqrt(((t[:, None] - t[None]) ** 2).sum(2))
    other = np.array(ids)[:, None] != np.array(ids)
    assert np.allclose(sorted(r["total"] for r in got), sorted((d * other).sum(1))) and sorted(r["n"] for r in got) == sorted(other.sum(1))


def test_all_pairs_meet_once_and_two_groups_a_task(spark):
    """A task of the totals reads two groups of rows, not the table, and no two tasks' shares come together."""
    rng = np.random.default_rng(3)
    rows = neighbours._keyed(frame(spark, range(900), "x" * 900, rng.normal(size=(900, 3))), False).withColumn("row", F.monotonically_increasing_id())
    read = neighbours.paired(rows, 6).rdd.mapPartitions(lambda part: [sum(len(r["rows"]) // 8 for r in part)]).collect()
    assert len(read) == 21 and min(read) > 0 and max(read) <= 2 * (150 + 3) and sum(read) == 900 * 6


@pytest.mark.parametrize("other_fold", [False, True])
def test_limits_leave_the_same_rows(other_fold):
    """Queries with limits, which look closer only at what these leave, find what queries without limits find."""
    rng = np.random.default_rng(4)
    y, z = rng.integers(0, 4, (300, 3)).astype(float), rng.integers(0, 4, (20, 3)).astype(float)
    ids, own, folds, y_folds = np.arange(300), np.arange(20), rng.integers(3, size=20), rng.integers(3, size=300)
    blocks, wants = np.arange(300) // 100, rng.random((20, 3)) < 0.7
    found = []
    for limits in (np.full(20, np.inf), np.full(20, 1.5), np.full(20, 9.0)):
        best = neighbours.Nearest(z, own, folds, limits, 4, other_fold)
        best.meet(np.arange(20), y, ids, y_folds, (wants, blocks))
        near = best.d <= 1.5
        found.append((best.q[near].tolist(), best.d[near].tolist(), best.near[near].tolist()))
    assert len(found[0][0]) > 20 and found[0] == found[1] == found[2]


def test_holders_of_groups_are_tasks_of_their_own(spark, monkeypatch):
    """Queries and groups are dealt to holders by number, so that no task gets the share of two by chance."""
    monkeypatch.setattr(neighbours, "SERVED", 40)
    rng, dealt = np.random.default_rng(5), []
    plain_deal = type(spark.range(1)).repartitionById
    monkeypatch.setattr(type(spark.range(1)), "repartitionById", lambda df, n, by: dealt.append(plain_deal(df, n, by)) or dealt[-1])
    t = frame(spark, range(400), "x" * 400, rng.normal(size=(400, 8)))
    monkeypatch.setattr(neighbours, "SLAB", 64)
    assert nearest(t, t, 2, block_rows=30).count() == 400
    for df in dealt:
        holders = df.rdd.mapPartitions(lambda part: [len({(r["group"], r["holder"]) for r in part})]).collect()
        assert len(holders) > 4 and set(holders) == {1}
