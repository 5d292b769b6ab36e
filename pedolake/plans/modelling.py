"""Queries that fit models: those of closed form have SQL; of trees and forests tests see the rows and columns only."""

from __future__ import annotations

from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from ..functions.expr import rounded
from ..functions.scratch import written
from ..operators import aoa, cells, families, metrics, modelling, pipelines, scoring
from .fixtures import derived, with_inputs

_X = ["b1", "b2", "b4"]


def _rows(spark, d):
    """Complete cells with a noisy target, a fold and a class."""
    df = derived(spark, d, "cells").na.drop(subset=["b4"])
    key = (F.col("row").cast("long") * 100_000 + F.col("col")).alias("cell_id")
    target = F.col("b3") + 0.3 * F.col("b1") * F.col("b2")
    kind = F.when(target < 0.35, "low").when(target < 0.7, "middle").otherwise("high")
    return df.select(key, *_X, target.alias("target"), kind.alias("class"), (F.col("col") % 3).cast("int").alias("fold"), (F.col("row") % 4).cast("int").alias("block"))


def cv_metrics(spark, d):
    model = modelling.tuned(modelling.assembled(_rows(spark, d), _X, "target"), "fold", 3, [3, 5])
    return spark.createDataFrame([(k, float(m)) for k, m in zip((3, 5), model.avgMetrics, strict=True)], "depth int, mqi double")


def rfe_profile(spark, d):
    return modelling.rfe_profile(written(_rows(spark, d), "rows"), _X, "target", [1, 2, 3], "fold", 3)


def importance_top(spark, d):
    model = modelling.forest().fit(modelling.assembled(_rows(spark, d), _X, "target"))
    return modelling.importance(model, _X, spark)


def model_family_scores(spark, d):
    df, levels = modelling.indexed_label(written(_rows(spark, d), "rows"), "class")
    return families.family_scores(df.where("fold <> 0"), df.where("fold = 0"), _X, "label", "cell_id", levels)


def nearest_votes(spark, d):
    df = derived(spark, d, "train_new").withColumn("z", F.transform("embedding", lambda c: c.cast("double")))
    train, new = df.where("part = 'train'").select("vec_id", "fold", "z"), df.where("part = 'new'").select("vec_id", "fold", "z")
    return modelling.neighbour_votes(new, train, aoa.nearest(new, train, 7), "fold")


def qrf_quantiles(spark, d):
    rows = modelling.assembled(_rows(spark, d), _X, "target")
    model = modelling.forest().fit(rows.where("fold <> 0"))
    stored = scoring.leaf_values(model, rows.where("fold <> 0"), "target", "cell_id")
    return scoring.forest_quantiles(model, rows.where("fold = 0"), stored, "cell_id", [0.05, 0.5, 0.95])


def class_probabilities(spark, d):
    df, levels = modelling.indexed_label(_rows(spark, d), "class")
    rows = modelling.assembled(df, _X, "label")
    return scoring.class_probabilities(modelling.class_forest().fit(rows.where("fold <> 0")), rows.where("fold = 0"), "cell_id", levels)


#: Inner folds and sizes of the pipelines below.
_FAST = pipelines.Settings(sizes=[1], folds=2, threads=4)


def _forest(**params):
    return modelling.forest(trees=5, seed=7).copy({}).setMaxDepth(params["depth"])


def repeated_holdout(spark, d):
    """Two holdouts with elimination and tuning of a forest."""
    learner = pipelines.forest_learner("rf", 5, _forest, ({"depth": 3}, {"depth": 5}))
    return pipelines.repeated(_rows(spark, d), learner, _X, "target", "cell_id", 2, settings=_FAST)["performance"]


def nested_logo(spark, d):
    """Each block left out in turn; elimination and tuning of boosted trees within the others."""
    learner = pipelines.spark_learner("gbm", "regression", lambda **p: GBTRegressor(maxIter=3, maxDepth=p["depth"], seed=7), ({"depth": 2}, {"depth": 3}), gathers=True)
    return pipelines.leave_one_out(_rows(spark, d), learner, _X, "target", "cell_id", "block", _FAST)["performance"]


def single_fit(spark, d):
    """Fits and reports on all rows, without a split."""
    learner = pipelines.forest_learner("rf", 5, _forest, ({"depth": 5},))
    return pipelines.single(_rows(spark, d), learner, _X, "target", "cell_id", settings=_FAST)["performance"]


def gbm_influence(spark, d):
    """Relative influence of each predictor in boosted trees on all rows."""
    learner = pipelines.spark_learner("gbm", "regression", lambda **p: GBTRegressor(maxIter=3, maxDepth=3, seed=7), gathers=True)
    return pipelines.single(_rows(spark, d), learner, _X, "target", "cell_id")["importance"]


def class_probabilities_resampled(spark, d):
    """Probabilities on a coarser grid, whose cells take the predictors of the cell that holds their centre."""
    df, levels = modelling.indexed_label(_rows(spark, d), "class")
    model = modelling.class_forest().fit(modelling.assembled(df, _X, "label"))
    out = None
    for b in _X:
        one = cells.resample_near(derived(spark, d, "cells"), b, 2.5).withColumnRenamed("value", b)
        out = one if out is None else out.join(one, ["r", "c"])
    grid = out.na.drop().withColumn("cell_id", F.col("r").cast("long") * 100_000 + F.col("c")).withColumn("label", F.lit(0.0))
    return scoring.class_probabilities(model, modelling.assembled(grid, _X, "label"), "cell_id", levels)


def single_fit_classes(spark, d):
    """Predictors of a class by their importance in a forest on all rows, after elimination by kappa."""
    learner = pipelines.spark_learner("rf", "classification", lambda **p: modelling.class_forest(trees=5))
    settings = pipelines.Settings(sizes=[1, 2], folds=2, metric="kappa")
    return pipelines.single(_rows(spark, d), learner, _X, "class", "cell_id", settings=settings)["importance"]


def _shown(df, names, digits=4):
    return df.withColumns({n: rounded(F.col(n), digits) for n in names})


_PLAIN = pipelines.Settings(threads=4)


def repeated_linear(spark, d):
    """Three stratified holdouts of a line through one predictor, with the null model beside it."""
    out = pipelines.repeated(_rows(spark, d), pipelines.linear(), ["b1"], "target", "cell_id", 3, settings=_PLAIN)["performance"]
    return _shown(out.select("run", "data", "mae", "rmse", "nse"), ["mae", "rmse", "nse"])


def nested_logo_linear(spark, d):
    """Each block left out of a line through one predictor; pooled metrics."""
    out = pipelines.leave_one_out(_rows(spark, d), pipelines.linear(), ["b1"], "target", "cell_id", "block", _PLAIN)["performance"]
    return _shown(out, metrics.REGRESSION)


_P = ["a", "b", "c"]


def _orders(spark, d):
    """All orders with three predictors: sizes of a kind that tell something, little and nothing of the target."""
    a, b, c = (F.col(x).cast("double") for x in ("group_id", "b", "c"))
    g = derived(spark, d, "groups").withColumns({"b": F.col("row_id") % 97, "c": F.col("row_id") % 13})
    y = F.col("target") / 1000 + 3 * F.col("b") - F.col("c")
    return g.select("row_id", a.alias("a"), b.alias("b"), c.alias("c"), y.alias("y"), (F.col("group_id") % 6).cast("int").alias("unit"))


def loocv_linear(spark, d):
    """Every order left out in turn of least squares on three predictors."""
    out = pipelines.leave_one_out(_orders(spark, d), pipelines.linear(), _P, "y", "row_id", None, _PLAIN)["predictions"]
    return _shown(out.select("row_id", "y", "prediction"), ["y", "prediction"], 3)


#: Elimination among two predictors and two penalties, by inner folds of units.
_CHOICE = pipelines.Settings(sizes=[1], folds=2, metric="rmse", larger=False, tolerance=0.5)


def nested_logo_choice(spark, d):
    """Each of six units left out, with elimination and tuning within the others: what is kept, and pooled metrics."""
    out = pipelines.leave_one_out(_orders(spark, d), pipelines.linear([0.0, 0.5]), ["b", "c"], "y", "row_id", "unit", _CHOICE)
    kept = out["importance"].select(F.lit("importance").alias("part"), "run", "predictor", rounded(F.col("importance"), 4).alias("value"))
    pooled = out["performance"].select(F.lit("performance").alias("part"), F.lit("all").alias("run"), F.explode(F.create_map(*[x for m in metrics.REGRESSION for x in (F.lit(m), rounded(F.col(m), 4))])).alias("predictor", "value"))
    return kept.unionByName(pooled)


def nested_logo_classes(spark, d):
    """Each block left out of nearest class means; pooled metrics."""
    out = pipelines.leave_one_out(_rows(spark, d), pipelines.centroids(), ["b1"], "class", "cell_id", "block", _PLAIN)["performance"]
    return _shown(out.select("accuracy", "kappa", "sensitivity", "specificity", "precision"), ["accuracy", "kappa", "sensitivity", "specificity", "precision"])


def single_linear(spark, d):
    """A line on all rows, and how well it fits them."""
    return _shown(pipelines.single(_rows(spark, d), pipelines.linear(), ["b1"], "target", "cell_id", settings=_PLAIN)["performance"], metrics.REGRESSION)


_RW = """rw AS (SELECT CAST(row AS BIGINT) * 100000 + col AS cell_id, b1, b3 + 0.3 * b1 * b2 AS target, row % 4 AS block FROM cells WHERE b4 IS NOT NULL)"""
_OW = """o AS (SELECT row_id, CAST(group_id AS DOUBLE) AS a, CAST(row_id % 97 AS DOUBLE) AS b, CAST(row_id % 13 AS DOUBLE) AS c, target / 1000 + 3 * (row_id % 97) - row_id % 13 AS y, CAST(group_id % 6 AS INTEGER) AS unit FROM groups)"""
_CLASS = "CASE WHEN target < 0.35 THEN 'low' WHEN target < 0.7 THEN 'middle' ELSE 'high' END"
_PAIRS = """SELECT {g} avg(obs) AS mo, avg(pred) AS mp, var_pop(obs) AS vo, var_pop(pred) AS vp, covar_pop(obs, pred) AS co, avg(abs(pred - obs)) AS mae, avg((pred - obs) ** 2) AS mse FROM pairs {by}"""
_ALL = """SELECT round(2 * co / (vo + vp + (mo - mp) ** 2), 4) AS ccc, round(co * co / (vo * vp), 4) AS r2, round(1 - mse / vo, 4) AS nse, round(mae, 4) AS mae, round(sqrt(mse), 4) AS rmse,
 round(2 * co / (vo + vp + (mo - mp) ** 2) * (1 - mse / vo) / (mae / mo), 4) AS mqi FROM (""" + _PAIRS.format(g="", by="") + ")"
_STRATUM = " + ".join(f"CASE WHEN target > q[{k}] THEN 1 ELSE 0 END" for k in (1, 2, 3, 4))

ORACLES: dict[str, str] = {
    "nearest_votes": with_inputs("train_new", """WITH e AS (SELECT vec_id, fold, part, CAST(embedding AS DOUBLE[]) AS z FROM train_new),
      p AS (SELECT a.vec_id, b.vec_id AS id, b.fold, sqrt(list_sum(list_transform(list_zip(a.z, b.z), lambda p: (p[1] - p[2]) ** 2))) AS d FROM e a JOIN e b ON a.part = 'new' AND b.part = 'train'),
      r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, id) AS k FROM p), v AS (SELECT vec_id, fold, sum(1 / (d + 1e-9)) AS w FROM r WHERE k <= 7 GROUP BY 1, 2)
      SELECT vec_id, fold AS predicted FROM v QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, fold DESC) = 1"""),
    "single_linear": with_inputs("cells", f"WITH {_RW}, f AS (SELECT regr_slope(target, b1) AS s, regr_intercept(target, b1) AS i FROM rw), pairs AS (SELECT target AS obs, i + s * b1 AS pred FROM rw, f) {_ALL}"),
    "nested_logo_linear": with_inputs("cells", f"""WITH {_RW}, f AS (SELECT u, regr_slope(target, b1) AS s, regr_intercept(target, b1) AS i FROM rw, (SELECT unnest([0, 1, 2, 3]) AS u) WHERE block <> u GROUP BY u),
      pairs AS (SELECT target AS obs, i + s * b1 AS pred FROM rw JOIN f ON u = block) {_ALL}"""),
    "repeated_linear": with_inputs("cells", f"""WITH {_RW}, st AS (SELECT rw.*, run, {_STRATUM} AS stratum FROM (SELECT *, (SELECT quantile_cont(target, [0.2, 0.4, 0.6, 0.8]) FROM rw) AS q FROM rw) rw, (SELECT unnest([1, 2, 3]) AS run)),
      h AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY run, stratum ORDER BY md5(concat_ws('-', cell_id, run)), cell_id) <= ceil(count(*) OVER (PARTITION BY run, stratum) * 0.75) THEN 'train' ELSE 'test' END AS role FROM st),
      f AS (SELECT run, regr_slope(target, b1) AS s, regr_intercept(target, b1) AS i, avg(target) AS m FROM h WHERE role = 'train' GROUP BY run),
      pairs AS (SELECT run, role AS data, target AS obs, i + s * b1 AS pred FROM h JOIN f USING (run) UNION ALL SELECT run, 'null', target, m FROM h JOIN f USING (run) WHERE role = 'test')
      SELECT CAST(run AS INTEGER) AS run, data, round(mae, 4) AS mae, round(sqrt(mse), 4) AS rmse, round(1 - mse / vo, 4) + 0.0 AS nse FROM ({_PAIRS.format(g="run, data,", by="GROUP BY run, data")})"""),
    "loocv_linear": with_inputs("groups", f"""WITH {_OW}, m AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(y) AS my FROM o),
      z AS (SELECT row_id, y, a - ma AS a, b - mb AS b, c - mc AS c, y - my AS v, n, my FROM o, m),
      s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * b) AS bb, sum(b * c) AS bc, sum(c * c) AS cc, sum(a * v) AS av, sum(b * v) AS bv, sum(c * v) AS cv FROM z),
      k AS (SELECT *, bb * cc - bc * bc AS kaa, ac * bc - ab * cc AS kab, ab * bc - ac * bb AS kac, aa * cc - ac * ac AS kbb, ab * ac - aa * bc AS kbc, aa * bb - ab * ab AS kcc FROM s),
      i AS (SELECT *, aa * kaa + ab * kab + ac * kac AS det FROM k),
      w AS (SELECT *, (kaa * av + kab * bv + kac * cv) / det AS wa, (kab * av + kbb * bv + kbc * cv) / det AS wb, (kac * av + kbc * bv + kcc * cv) / det AS wc FROM i)
      SELECT row_id, round(y, 3) AS y, round(y - (v - wa * a - wb * b - wc * c) / (1 - 1.0 / n - (kaa * a * a + kbb * b * b + kcc * c * c + 2 * (kab * a * b + kac * a * c + kbc * b * c)) / det), 3) AS prediction FROM z, w"""),
    "nested_logo_choice": with_inputs("groups", f"""WITH {_OW}, d AS (SELECT unit, (row_number() OVER (ORDER BY md5(unit || '-0'), unit) - 1) % 2 AS fold FROM (SELECT DISTINCT unit FROM o)),
      r AS (SELECT o.*, fold FROM o JOIN d USING (unit)), u AS (SELECT unit AS u FROM d),
      t AS (SELECT u, f, r.* FROM r, u, (SELECT unnest([0, 1, 2]) AS f) WHERE unit <> u AND fold <> f),
      s AS (SELECT u, f, avg(b) AS mb, avg(c) AS mc, avg(y) AS my, var_pop(b) AS bb, covar_pop(b, c) AS bc, var_pop(c) AS cc, covar_pop(b, y) AS bv, covar_pop(c, y) AS cv, count(*) AS n FROM t GROUP BY 1, 2),
      g AS (SELECT *, bb * (1 + l) AS gb, cc * (1 + l) AS gc FROM s, (SELECT unnest([0.0, 0.5]) AS l)),
      full_ AS (SELECT *, (gc * bv - bc * cv) / (gb * gc - bc * bc) AS wb, (gb * cv - bc * bv) / (gb * gc - bc * bc) AS wc FROM g),
      best AS (SELECT u, f, abs(wb) * sqrt(bb) >= abs(wc) * sqrt(cc) AS b_first FROM full_ WHERE l = 0),
      fits AS (SELECT u, f, l, 2 AS size, wb, wc, my - wb * mb - wc * mc AS base, bb, cc, n FROM full_
        UNION ALL SELECT u, f, l, 1, CASE WHEN b_first THEN bv / gb ELSE 0 END, CASE WHEN b_first THEN 0 ELSE cv / gc END, my - CASE WHEN b_first THEN bv / gb * mb ELSE cv / gc * mc END, bb, cc, n FROM g JOIN best USING (u, f)),
      sums AS (SELECT unit, fold, count(*) AS n, sum(b) AS b, sum(c) AS c, sum(y) AS y, sum(b * b) AS bb, sum(b * c) AS bc, sum(c * c) AS cc, sum(b * y) AS bv, sum(c * y) AS cv, sum(y * y) AS yy FROM r GROUP BY 1, 2),
      held AS (SELECT fits.u, f, l, size, sqrt(sum(yy + h.n * base * base + wb * wb * h.bb + wc * wc * h.cc + 2 * (base * wb * b + base * wc * c + wb * wc * bc - base * y - wb * bv - wc * cv)) / sum(h.n)) AS rmse
        FROM fits JOIN sums h ON h.unit <> fits.u AND h.fold = f WHERE f < 2 GROUP BY ALL),
      profile AS (SELECT u, size, avg(rmse) AS rmse FROM held WHERE l = 0 GROUP BY 1, 2),
      sized AS (SELECT u, CASE WHEN max(CASE WHEN size = 1 THEN rmse END) - min(rmse) <= 0.005 * min(rmse) THEN 1 ELSE 2 END AS size FROM profile GROUP BY 1),
      -- penalties are tried on what elimination has kept from all of the training part
      wide AS (SELECT g.u, g.f, g.l, size, CASE WHEN size = 2 THEN wb WHEN k.b_first THEN bv / g.gb ELSE 0 END AS wb, CASE WHEN size = 2 THEN wc WHEN k.b_first THEN 0 ELSE cv / g.gc END AS wc, g.mb, g.mc, g.my, g.bb, g.cc, g.n, k.b_first
        FROM full_ g JOIN sized USING (u) JOIN best k ON k.u = g.u AND k.f = 2),
      based AS (SELECT *, my - wb * mb - wc * mc AS base FROM wide),
      tried AS (SELECT based.u, f, l, sqrt(sum(yy + h.n * base * base + wb * wb * h.bb + wc * wc * h.cc + 2 * (base * wb * b + base * wc * c + wb * wc * bc - base * y - wb * bv - wc * cv)) / sum(h.n)) AS rmse
        FROM based JOIN sums h ON h.unit <> based.u AND h.fold = f WHERE f < 2 GROUP BY ALL),
      tuned AS (SELECT u, arg_min(l, rmse) AS l FROM (SELECT u, l, avg(rmse) AS rmse FROM tried GROUP BY 1, 2) GROUP BY 1),
      final AS (SELECT based.* FROM based JOIN tuned USING (u, l) WHERE f = 2),
      pairs AS (SELECT y AS obs, base + wb * b + wc * c AS pred FROM r JOIN final ON u = unit), p AS ({_ALL})
      SELECT 'importance' AS part, CAST(u AS VARCHAR) AS run, 'b' AS predictor, round(abs(wb) * sqrt(bb * n), 4) AS value FROM final WHERE size = 2 OR b_first
      UNION ALL SELECT 'importance', CAST(u AS VARCHAR), 'c', round(abs(wc) * sqrt(cc * n), 4) FROM final WHERE size = 2 OR NOT b_first
      UNION ALL SELECT 'performance', 'all', name, value FROM (UNPIVOT p ON ccc, r2, nse, mae, rmse, mqi)"""),
    "nested_logo_classes": with_inputs("cells", f"""WITH {_RW}, k AS (SELECT *, {_CLASS} AS class FROM rw), m AS (SELECT u, class AS c, avg(b1) AS m FROM k, (SELECT unnest([0, 1, 2, 3]) AS u) WHERE block <> u GROUP BY ALL),
      p AS (SELECT cell_id, any_value(class) AS obs, arg_min(c, (b1 - m) ** 2) AS pred FROM (SELECT * FROM k JOIN m ON u = block ORDER BY c) GROUP BY 1),
      per AS (SELECT l.c, count(CASE WHEN obs = l.c AND pred = l.c THEN 1 END) AS t, count(CASE WHEN pred = l.c THEN 1 END) AS a, count(CASE WHEN obs = l.c THEN 1 END) AS b, count(*) AS n FROM p, (SELECT DISTINCT class AS c FROM k) l GROUP BY 1),
      w AS (SELECT sum(t) / max(n) AS po, sum(CAST(a AS DOUBLE) * b) / (max(n) * CAST(max(n) AS DOUBLE)) AS pe FROM per)
      SELECT round(any_value(po), 4) AS accuracy, round(any_value((po - pe) / (1 - pe)), 4) AS kappa, round(avg(t / nullif(b, 0)), 4) AS sensitivity, round(avg((n - a - b + t) / nullif(n - b, 0)), 4) AS specificity,
      round(avg(t / nullif(a, 0)), 4) AS precision FROM per, w"""),
}
QUERIES = [cv_metrics, rfe_profile, importance_top, model_family_scores, nearest_votes, qrf_quantiles, class_probabilities, repeated_holdout, nested_logo, single_fit,
    gbm_influence, class_probabilities_resampled, single_fit_classes, repeated_linear, nested_logo_linear, loocv_linear, nested_logo_choice, nested_logo_classes, single_linear]
