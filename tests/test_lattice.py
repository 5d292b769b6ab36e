"""Sums and units over supersets against plain loops, for attributes in one group of bits and in several."""

import numpy as np
import pytest

from pedolake.operators import lattice


@pytest.mark.parametrize("n_attrs", [3, 8, 11, 63])
def test_as_plain_loops(spark, n_attrs):
    rng = np.random.default_rng(n_attrs)
    few = lambda k: int(sum(1 << int(i) for i in rng.choice(n_attrs, k, replace=False)))
    combos = sorted({few(int(rng.integers(1, min(4, n_attrs) + 1))) for _ in range(25)})
    masks = [0, (1 << n_attrs) - 1, *[few(int(rng.integers(1, n_attrs + 1))) for _ in range(30)]]
    rows = [(("x", "y", None)[i % 3], int(rng.integers(40)), m, int(rng.integers(1, 9))) for i, m in enumerate(masks * 3)]
    df = spark.createDataFrame(rows, "k string, unit int, mask long, n long").repartition(3)
    wanted = spark.createDataFrame([(c,) for c in combos], "combo_mask long")
    for keys in ([], ["k"]):
        of = lambda r: (r[0],) if keys else ()  # noqa: B023, E731
        sums, units = {}, {}
        for r in rows:
            for c in combos:
                if r[2] & c == c:
                    sums[(*of(r), c)] = sums.get((*of(r), c), 0) + r[3]
                    units.setdefault((*of(r), c), set()).add(r[1])
        got = {tuple(r)[:-1]: r["n"] for r in lattice.superset_sums(df, wanted, n_attrs, keys).collect()}
        if not keys:
            assert got == sums and len(got) > 5
            got = {tuple(r)[:-1]: r["n"] for r in lattice.superset_units(df, wanted, n_attrs, "unit").collect()}
            assert got == {k: len(v) for k, v in units.items()}
        else:
            assert got == sums


def test_units_of_one_set_go_down_once(spark):
    """A thousand units with two sets of masks are two sets; null keys are keys."""
    rows = [(None if i % 2 else "a", i, m) for i in range(1000) for m in ((3, 4) if i % 5 else (7,))]
    df = spark.createDataFrame(rows, "k string, unit int, mask long")
    combos = spark.createDataFrame([(1,), (3,), (4,), (5,)], "combo_mask long")
    got = {(r["k"], r["combo_mask"]): r["n"] for r in lattice.superset_units(df, combos, 3, "unit", ["k"]).collect()}
    assert got == {(k, c): 100 if c == 5 else 500 for k in ("a", None) for c in (1, 3, 4, 5)}
    assert "NestedLoop" not in lattice.superset_units(df, combos, 3, "unit")._jdf.queryExecution().executedPlan().toString()


def test_nothing(spark):
    none = spark.createDataFrame([], "unit int, mask long, n long")
    combos = spark.createDataFrame([(1,)], "combo_mask long")
    assert lattice.superset_sums(none, combos, 3).collect() == lattice.superset_units(none, combos, 3, "unit").collect() == []
