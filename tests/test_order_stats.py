"""Exact quantiles against NumPy: ties, skew, hot groups, null groups, NaN and nothing."""

import numpy as np
import pytest

from pedolake.operators.order_stats import quantiles

PROBS = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]


def table(spark, values, groups=None):
    rows = [(g, None if v is None else float(v)) for g, v in zip(groups if groups is not None else ["a"] * len(values), values, strict=True)]
    return spark.createDataFrame(rows, "g string, x double").repartition(3)


@pytest.mark.parametrize("kind", ["even", "ties", "long tail", "two values", "one value", "negative"])
def test_rounds_narrow_to_the_exact_value(spark, kind):
    rng = np.random.default_rng(5)
    n = 4001
    x = {
        "even": np.arange(n), "ties": rng.integers(0, 9, n), "long tail": 10.0 ** rng.uniform(-300, 300, n), "two values": (np.arange(n) > 1000) * 1.0,
        "one value": np.full(n, 3.0), "negative": -rng.exponential(1, n),
    }[kind]
    got = quantiles(table(spark, x), "x", PROBS, rest=20, accuracy=100).collect()
    assert len(got) == 1 and got[0]["n"] == n and got[0]["least"] == x.min() and got[0]["most"] == x.max()
    h = (n - 1) * np.array(PROBS)
    s = np.sort(x.astype(float))
    lower, higher = s[np.floor(h).astype(int)], s[np.ceil(h).astype(int)]
    assert np.allclose(got[0]["q"], np.where(lower == higher, lower, (np.ceil(h) - h) * lower + (h - np.floor(h)) * higher), rtol=1e-15, atol=0)


@pytest.mark.parametrize("rest", [25, 65_536])
def test_groups_of_any_size(spark, rest):
    rng = np.random.default_rng(8)
    groups = ["hot"] * 1500 + [None] * 300 + ["few"] * 3 + ["none"] * 2 + ["one"]
    x = [*rng.normal(size=1500), *rng.integers(0, 4, 300), 1.0, 2.0, float("nan"), None, float("nan"), 5.0]
    got = {r["g"]: r for r in quantiles(table(spark, x, groups), "x", PROBS, ["g"], rest=rest, accuracy=60).collect()}
    assert set(got) == {"hot", None, "few", "none", "one"}
    for g, r in got.items():
        own = np.array([v for h, v in zip(groups, x, strict=True) if h == g and v is not None and v == v])
        assert r["n"] == len(own)
        if len(own):
            assert np.allclose(r["q"], np.quantile(own, PROBS), rtol=1e-12) and (r["least"], r["most"]) == (own.min(), own.max())
        else:
            assert r["q"] is None and r["least"] is None and r["most"] is None


def test_nothing(spark):
    got = quantiles(table(spark, []), "x", [0.5]).collect()
    assert len(got) == 1 and got[0]["n"] == 0 and got[0]["q"] is None
    assert quantiles(table(spark, []), "x", [0.5], ["g"]).collect() == []


def test_no_percentile_over_the_table(spark):
    """The plan that reads the result off has no percentile aggregate."""
    df = quantiles(table(spark, range(500)), "x", [0.5], rest=20)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and df.first()["q"] == [249.5]
