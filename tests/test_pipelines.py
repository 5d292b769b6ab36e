"""Learners and validation pipelines against NumPy and plain loops."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier

from pyspark.sql import functions as F

from pedolake.operators import pipelines as p
from pedolake.operators import resample


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(120, 3))
    y = 2.0 + 3.0 * x[:, 0] + 0.1 * rng.normal(size=120)
    data = [(i, f"g{i % 6}", *map(float, x[i]), float(y[i]), "high" if y[i] > 3 else "low") for i in range(120)]
    return spark.createDataFrame([*data, (999, None, None, 0.0, 0.0, 1.0, "low")], "id int, g string, a double, b double, c double, y double, k string")


def table(df):
    return [r.asDict() for r in df.collect()]


def test_linear_is_least_squares(rows):
    full = np.array([(r["a"], r["b"], r["c"], r["y"]) for r in rows.na.drop().orderBy("id").collect()])
    want = np.linalg.lstsq(np.column_stack((np.ones(len(full)), full[:, :3])), full[:, 3], rcond=None)[0]
    fit = p.linear().fit(rows, ["a", "b", "c"], "y", {})
    got = [r["prediction"] for r in fit.score(rows.na.drop().orderBy("id")).collect()]
    assert np.allclose(got, np.column_stack((np.ones(len(full)), full[:, :3])) @ want)
    assert max(fit.importance, key=fit.importance.get) == "a"


def test_elimination_keeps_what_tells(rows):
    settings = p.Settings(sizes=[1, 2], folds=2, metric="r2", tolerance=5.0)
    kept, profile = p.eliminate(p.with_folds(rows, 2, "id", "g", 1), p.linear(), ["c", "b", "a"], "y", [], settings)
    assert kept == ["a"] and set(profile) == {1, 2, 3}
    assert p.within_tolerance({1: 0.5, 2: 0.99, 3: 1.0}, 1.5, True) == 2 and p.within_tolerance({1: 1.0, 2: 0.9}, 0.0, False) == 2


def test_left_out_groups_do_not_train(rows):
    out = p.leave_one_out(rows, p.linear(), ["a"], "y", "id", "g", p.Settings(threads=2))
    assert len({r["unit"] for r in table(out["predictions"])}) == 6 and out["predictions"].count() == 120
    held = [r for r in table(rows) if r["g"] == "g2"]
    others = np.array([(r["a"], r["y"]) for r in table(rows) if r["g"] not in (None, "g2")])
    slope, base = np.polyfit(others[:, 0], others[:, 1], 1)
    got = {r["id"]: r["prediction"] for r in table(out["predictions"])}
    assert all(got[r["id"]] == pytest.approx(base + slope * r["a"]) for r in held)
    with pytest.raises(ValueError):
        p.leave_one_out(rows.where("g = 'g1'"), p.linear(), ["a"], "y", "id", "g")


def test_class_pipelines(rows):
    tree = p.spark_learner("tree", "classification", lambda **a: DecisionTreeClassifier(maxDepth=a["depth"], seed=1), ({"depth": 1}, {"depth": 3}))
    settings = p.Settings(sizes=[1], folds=2, metric="kappa", tolerance=20.0)
    pure = rows.where("g is not null").withColumn("g", F.concat("g", "k"))  # groups of two classes are refused
    out = p.repeated(pure, tree, ["b", "a"], "k", "id", 1, group="g", settings=settings)
    by = {r["data"]: r for r in table(out["performance"])}
    assert set(by) == {"train", "test", "null"} and by["test"]["kappa"] > 0.7 and by["null"]["kappa"] in (None, 0.0)
    assert table(out["importance"])[0]["predictor"] == "a"
    one = p.single(rows, p.centroids(), ["a"], "k", "id", settings=p.Settings(metric="kappa"))
    assert table(one["performance"])[0]["accuracy"] > 0.9


def test_wrong_settings_are_refused(rows):
    with pytest.raises(ValueError):
        p.Learner("x", "ranking", lambda *a: None)
    with pytest.raises(ValueError):
        p.Learner("x", "regression", lambda *a: None, ())
    with pytest.raises(ValueError):
        p._value(p.linear().fit(rows, ["a"], "y", {}).score(rows), "regression", "y", [], p.Settings(metric="speed"))


CHOICE = p.Settings(sizes=[1, 2], folds=3, metric="rmse", larger=False, tolerance=0.5)


@pytest.mark.parametrize("unit", ["g", None])
def test_left_out_from_moments_as_one_by_one(spark, unit):
    """Elimination, a grid of penalties and the last fit, against a fit of each unit on its own."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(36, 3)) * [1, 5, 0.1] + [0, 100, 3]
    y = 1e4 + 3 * x[:, 0] - x[:, 1] + rng.normal(size=36)
    data = [(i, f"g{i % 4}", *map(float, x[i]), float(y[i])) for i in range(36)]
    data += [(91, "alone", 1.0, 100.0, 3.0, None), (92, "g2", 0.5, 99.0, 3.0, None), (93, None, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(data, "id int, g string, a double, b double, c double, y double").repartition(3)
    if not unit:
        df = df.where("id < 14 or id = 91").unionByName(df.where("id = 93").withColumn("id", F.lit(None).cast("int")))
    settings = replace(CHOICE, sizes=[1], folds=2)
    fast, slow = (p.leave_one_out(df, replace(p.linear([0.0, 0.3]), moments=m), ["c", "b", "a"], "y", "id", unit, settings) for m in (True, False))
    for name, order in (("predictions", ["id"]), ("performance", ["rmse"]), ("importance", ["run", "place"])):
        got, want = table(fast[name].orderBy(*order)), table(slow[name].orderBy(*order))
        assert len(got) == len(want) > 0
        for g, w in zip(got, want, strict=True):
            assert all(v == (pytest.approx(w[k], rel=1e-7) if isinstance(v, float) else w[k]) for k, v in g.items()), (g, w)


def test_incomplete_rows_do_not_train(spark):
    """A row that lacks a predictor is predicted from the predictors that are kept, and trains no unit's fit."""
    data = [(i, float(i), float((i * 7) % 5), 3.0 * i + 1) for i in range(20)]
    full, extra = (spark.createDataFrame(x, "id int, a double, b double, y double") for x in (data, [*data, (90, 2.0, None, 1e6), (91, None, 1.0, 5.0)]))
    settings = p.Settings(sizes=[1], folds=2, metric="rmse", larger=False, tolerance=1e6)
    want, got = ({r["id"]: r["prediction"] for r in p.leave_one_out(df, p.linear(), ["a", "b"], "y", "id", None, settings)["predictions"].collect()} for df in (full, extra))
    assert all(got[i] == pytest.approx(want[i]) for i in want) and got[90] == pytest.approx(7.0) and got[91] is None


def test_rows_left_out_are_the_hat_matrix(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack((np.ones(500), rng.normal(size=(500, 2))))
    y = x @ [5, 1, -2] + rng.normal(size=500)
    df = spark.createDataFrame([(i, float(x[i, 1]), float(x[i, 2]), float(y[i])) for i in range(500)], "id int, a double, b double, y double")
    hat = np.einsum("ij,jk,ik->i", x, np.linalg.inv(x.T @ x), x)
    left = y - (y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) / (1 - hat)
    got = {r["id"]: r["prediction"] for r in p.leave_one_out(df, p.linear(), ["a", "b"], "y", "id")["predictions"].collect()}
    assert np.allclose([got[i] for i in range(500)], left, rtol=1e-10)
    twice = p.leave_one_out(df.unionByName(df.where("id < 3")), p.linear(), ["a", "b"], "y", "id")["predictions"]
    assert twice.count() == 503 and twice.where("id < 3").select("prediction").distinct().count() == 3


@pytest.mark.parametrize("group", ["g", None])
def test_repeated_from_moments_as_one_by_one(rows, group):
    fast, slow = (p.repeated(rows, replace(p.linear([0.0, 0.1]), moments=m), ["c", "b", "a"], "y", "id", 2, 0.7, group, CHOICE) for m in (True, False))
    for name, order in (("performance", ["run", "data"]), ("importance", ["run", "place"])):
        got, want = table(fast[name].orderBy(*order)), table(slow[name].orderBy(*order))
        assert len(got) == len(want) > 0
        for g, w in zip(got, want, strict=True):
            assert all(g[k] == (pytest.approx(v, rel=1e-7) if isinstance(v, float) else v) for k, v in w.items()), (g, w)


def test_undefined_metrics_do_not_end_the_pipeline(spark):
    """A constant target and an exact line have no mqi in any fold: all predictors stay."""
    for y in ([2.0] * 30, [1.0 + 2 * i for i in range(30)]):
        df = spark.createDataFrame([(i, float(i), float(i % 4), v) for i, v in enumerate(y)], "id int, a double, b double, y double")
        out = p.single(df, p.linear(), ["a", "b"], "y", "id", settings=p.Settings(sizes=[1], folds=2))
        assert table(out["importance"])[0]["run"] == "all" and len(table(out["importance"])) == 2
    assert p.within_tolerance({1: float("nan"), 2: 0.5}, 1.0, True) == 2 and p.within_tolerance({1: float("nan"), 3: float("nan")}, 1.0, True) == 3


def test_no_run_without_test_rows(spark):
    """Groups of two classes are refused; few groups of one class still leave some to test; one group alone is refused."""
    df = spark.createDataFrame([(i, f"g{i % 3}", float(i), "ab"[i % 2]) for i in range(30)], "id int, g string, a double, k string")
    with pytest.raises(ValueError, match="more than one class"):
        p.repeated(df, p.centroids(), ["a"], "k", "id", 1, group="g")
    pure = spark.createDataFrame([(i, f"g{i % 4}", float(i % 2), "ab"[i % 2]) for i in range(40)], "id int, g string, a double, k string")
    out = {r["data"]: r for r in table(p.repeated(pure, p.centroids(), ["a"], "k", "id", 1, group="g")["performance"])}
    assert out["test"]["accuracy"] == 1.0
    with pytest.raises(ValueError, match="too few"):
        p.repeated(df.withColumn("y", F.col("a")).where("g = 'g1'"), p.linear(), ["a"], "y", "id", 1, group="g")


def test_rows_without_a_group_are_kept(rows):
    split = p.holdouts(rows, "regression", "y", "id", [1, 2], 0.75, "g")
    assert split.count() == 2 * 121 and split.where("g is null").select("run", "role").distinct().count() == 2
    assert split.groupBy("run", "g").agg(F.count_distinct("role").alias("k")).where("k > 1").isEmpty()


def test_holdouts_are_the_first_by_their_draw(spark):
    df = spark.createDataFrame([(i, ["a", "b", None][min(i % 7, 2)]) for i in range(700)], "id int, s string").repartition(3)
    got = resample.stratified_holdouts(df, "s", "id", 0.6, [1, 5])
    for run in (1, 5):
        want = {r["id"]: r["role"] for r in resample.stratified_holdout(df, "s", "id", 0.6, run).collect()}
        assert {r["id"]: r["role"] for r in got.where(F.col("run") == run).collect()} == want


def test_metric_of_ones_own(rows):
    def worst(pairs):
        return pairs.agg(F.max(F.abs(F.col("obs") - F.col("pred"))).alias("worst"))

    settings = p.Settings(sizes=[1], folds=2, metric="worst", larger=False, tolerance=50.0, report=worst)
    kept, profile = p.eliminate(p.with_folds(rows, 2, "id", "g", 1), p.linear(), ["c", "b", "a"], "y", [], settings)
    assert kept == ["a"] and 0 < profile[1] < 1


def test_stopped_runs_go_on_where_they_ended(rows, tmp_path):
    whole, fits, line = p.repeated(rows, p.linear(), ["a", "b"], "y", "id", 3), [], p.linear()

    def stops_at(n):
        def fit(*given):
            if len(fits) == n:
                raise RuntimeError("stopped")
            fits.append(1)
            return line.fit(*given)

        return replace(line, fit=fit, moments=False)

    ledger = str(tmp_path / "ledger")
    with pytest.raises(RuntimeError, match="stopped"):
        p.repeated(rows, stops_at(2), ["a", "b"], "y", "id", 3, ledger=ledger)
    out = p.repeated(rows, stops_at(99), ["a", "b"], "y", "id", 3, ledger=ledger)
    assert len(fits) == 3
    for name, by in (("performance", ["run", "data"]), ("importance", ["run", "place"])):
        got, want = (out[name].orderBy(by).toPandas(), whole[name].orderBy(by).toPandas())
        assert list(got[by[0]]) == list(want[by[0]])
        for c in want.select_dtypes("float"):
            assert np.allclose(got[c].astype(float), want[c], equal_nan=True)
    with pytest.raises(ValueError, match="tolerance"):
        p.repeated(rows, stops_at(99), ["a", "b"], "y", "id", 3, ledger=ledger, settings=p.Settings(tolerance=9.0))
