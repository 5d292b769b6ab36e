"""What small tables do not show: large grids, latitudes beyond the poles, points on a border."""

from dataclasses import replace

import duckdb
import harness
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from pedolake.functions.expr import plain
from pedolake.operators import cells, modelling, pipelines, spatial, tiles
from pedolake.plans import fixtures, registry


def lineitem(spark, folder, rows):
    """A folder with the columns of lineitem that cell tables are made of."""
    df = spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double")
    df.write.parquet(f"{folder}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    return con


def test_pixels_of_tiles_beyond_an_int(spark):
    grid = spark.createDataFrame([(1, 0, 239_999, 0, 14_999)], "tile_id int, row_start int, row_end int, col_start int, col_end int")
    few = spark.createDataFrame([(3, 4, 1.0), (5, 6, None)], "row long, col long, v double")
    one = tiles.tile_summary(few, grid, "v")
    assert (one.first()["n_total"], one.first()["n_valid"]) == (3_600_000_000, 1)
    assert tiles.global_summary(one).first()["total_pixels"] == 3_600_000_000


def test_polygons_far_from_the_origin(spark, tmp_path):
    con = lineitem(spark, tmp_path, [(r, c, 1.0, 2.0, 0.0) for r, c in ((0, 0), (1_199_999, 59_999))])
    said = harness.compare(registry.queries()["tile_polygons"](spark, str(tmp_path)), con, registry.oracle_sql()["tile_polygons"])
    assert not said, said


def test_plain_text_of_doubles(spark):
    values = [0.0, -0.5, 1e7, -35940000.0, 12345678.25, 99999999999999.98, 1e15 - 1, 0.00012345, 123.456, 9999999.5]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(plain(F.col("v"))).collect()]
    assert got == [duckdb.execute("SELECT format('{}', CAST(? AS DOUBLE))", [v]).fetchone()[0] for v in values]


def test_points_on_a_ring_are_not_in_it(spark):
    ring = spark.createDataFrame([(1, [(0.0, 0.0), (6.0, 0.0), (0.0, 20.0)])], "poly_id long, ring array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(1, 0.5, 0.0), (2, 0.5, -0.0), (3, 3.0, 10.0), (4, 0.0, 5.0), (5, 0.5, 0.01), (6, 2.0, 5.0)], "point_id long, x double, y double")
    assert sorted(r["point_id"] for r in spatial.points_in_rings(points, ring).collect()) == [5, 6]


def test_mercator_beyond_the_poles(spark, tmp_path):
    con = lineitem(spark, tmp_path, [(r, 7, 1.0, 2.0, 0.0) for r in (0, 1000, 3999, 4001, 4500, 9000, 13_000, 19_999)])
    said = harness.compare(registry.queries()["reproject_mercator"](spark, str(tmp_path)), con, registry.oracle_sql()["reproject_mercator"])
    assert not said, said


def test_grouped_inputs_have_as_many_tasks_as_rows_ask_for(spark, sf):
    """Tasks of a grouping hold a bounded number of rows at any size, and the grouping needs no exchange of its own."""
    df = fixtures.table(spark, sf, "lineitem")
    many = fixtures.dealt(df, ["l_partkey", "l_suppkey"], 500)
    assert many.rdd.getNumPartitions() == -(-df.count() // 500)
    assert fixtures.dealt(df, ["l_partkey"]) is df
    plan = many.groupBy("l_partkey", "l_suppkey").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def counted(spark, n):
    """Rows (id, b1, b2, y) and a counter of how often a row of them has been made."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(i):
        made.add(1)
        return float(i * 37 % 101)

    rows = spark.range(n).withColumn("b1", value.asNondeterministic()("id"))
    return rows.withColumns({"b2": F.col("id") * 11 % 53 + 0.0, "y": F.col("id") * 3.0}), made


def test_classes_of_two_bands_read_them_once(spark):
    rows, made = counted(spark, 200)
    assert cells.bivariate_map(rows, "b1", "b2", 4).groupBy("colour_id").count().count() > 4
    assert made.value == 200


def test_repeated_holdouts_read_their_rows_once(spark):
    rows, made = counted(spark, 200)
    out = pipelines.repeated(rows, pipelines.linear(), ["b1", "b2"], "y", "id", 2)["performance"]
    assert out.count() == 6 and made.value == 200


def test_rows_of_equal_predictors_are_one_row_of_a_fit(spark):
    """Boosted trees see them by their number and mean label, and give the same; nulls stay with the fits that can take them."""
    rows = [(i, float(i * i % 7), None if i % 50 == 3 else float(i % 3), None if i % 11 == 5 else float(i * i % 7 * 3 - i % 3 + i % 2)) for i in range(600)]
    df, seen, out = spark.createDataFrame(rows, "id int, b1 double, b2 double, y double").repartition(3), [], []
    for gathers in (False, True):
        learner = pipelines.spark_learner("gbm", "regression", lambda **a: GBTRegressor(maxIter=2, maxDepth=a["depth"], seed=7), ({"depth": 1}, {"depth": 3}), gathers=gathers)

        def fit(few, *args, own=learner.fit):
            seen.append(few.count())
            return own(few, *args)

        got = pipelines.single(df, replace(learner, fit=fit), ["b1", "b2"], "y", "id", settings=pipelines.Settings(sizes=[1], folds=2))
        out.append([*got["performance"].first()] + [r["importance"] for r in got["importance"].orderBy("place").collect()])
    assert len(seen) == 20 and max(seen[10:]) < 50 < min(seen[:10])
    assert all(abs(a - b) < 1e-9 for a, b in zip(*out, strict=True)), out


def test_gathering_is_left_where_rows_differ(spark):
    rows = spark.range(100).select("id", (F.col("id") % 50).alias("b1"), F.col("id").cast("double").alias("y"))
    learner = replace(pipelines.linear(), gathers=True)
    assert pipelines.gathered(rows, learner, ["b1"], "y", []) is rows
    few = pipelines.gathered(rows.withColumn("b1", F.col("id") % 4), learner, ["b1"], "y", [])
    assert sorted((r["b1"], r["y"], r[pipelines.ROWS]) for r in few.collect()) == [(k, 48.0 + k, 25.0) for k in range(4)]


def test_trees_of_a_forest_see_their_drawn_rows_of_equal_predictors_as_one(spark):
    """The same predictions and importances as fits to every drawn row, and predictions of each kind of row are made once."""
    rows = [(i, float(i * i % 7), None if i % 50 == 3 else float(i % 3), None if i % 11 == 5 else float(i * i % 7 * 3 - i % 3 + i % 5)) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, b1 double, b2 double, y double").repartition(3)
    make, names = lambda **p: RandomForestRegressor(numTrees=2, maxDepth=p["depth"], seed=7), ["b1", "b2"]
    learner = pipelines.forest_learner("rf", 2, make, ({"depth": 3},))
    few = pipelines.gathered(df, learner, names, "y", [], "id")
    assert few.count() <= 24 and pipelines.gathered(df, learner, names, "y", []) is df
    fit = pipelines.by_kind(df, few, learner, names).fit(few, names, "y", {"depth": 3})
    got = {r["id"]: r["prediction"] for r in fit.score(df).collect()}
    want, weights = {}, []
    for t in range(2):
        times = pipelines.drawn_times(F.lit(t), F.col("id")).cast("int")
        drawn = modelling.assembled(df.withColumn("one", F.explode(F.array_repeat(F.lit(1), times))), names, "y")
        model = make(depth=3).setNumTrees(1).setBootstrap(False).setFeatureSubsetStrategy("onethird").setSeed(7 + t).fit(drawn)
        weights.append(model.featureImportances.toArray())
        for r in model.transform(modelling.assembled(df.withColumn("y", F.lit(0.0)), names, "y")).collect():
            want[r["id"]] = want.get(r["id"], 0.0) + r["prediction"] / 2
    assert len(set(want.values())) > 5 and got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    assert all(abs(fit.importance[c] - w) < 1e-9 for c, w in zip(names, sum(weights) / 2, strict=True))


def test_rows_are_drawn_a_poisson_number_of_times(spark):
    times = spark.range(40_000).select(pipelines.drawn_times(F.lit(1), F.col("id")).alias("k"), pipelines.drawn_times(F.lit(2), F.col("id")).alias("j"))
    mean, var, both, none = times.agg(F.avg("k"), F.var_pop("k"), F.covar_pop("k", "j"), F.avg((F.col("k") == 0).cast("double"))).first()
    assert abs(mean - 1) < 0.03 and abs(var - 1) < 0.05 and abs(both) < 0.03 and abs(none - 0.3679) < 0.015


def test_forests_of_a_holdout_are_fitted_to_gathered_rows(spark):
    df, seen = spark.range(800).select("id", (F.col("id") * 37 % 5).cast("double").alias("b1"), (F.col("id") * 11 % 101).cast("double").alias("y")), []
    learner = pipelines.forest_learner("rf", 2, lambda **_: RandomForestRegressor(numTrees=2, maxDepth=2, seed=1))

    def fit(few, *args, own=learner.fit):
        seen.append(few.count())
        return own(few, *args)

    out = pipelines.repeated(df, replace(learner, fit=fit), ["b1"], "y", "id", 2, settings=pipelines.Settings(folds=2))["performance"]
    assert sorted((r["run"], r["data"]) for r in out.collect()) == [(k, d) for k in (1, 2) for d in ("null", "test", "train")] and seen == [10, 10]
