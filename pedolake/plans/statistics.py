"""Queries on cleaning, accuracy, screening and resampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import rounded
from ..operators import cleaning, metrics, resample, screening
from .fixtures import derived, table, with_inputs

_NUM = ["c_gkg", "sand_gkg", "clay_gkg", "p_mgkg", "k_mmolkg"]
_LEVELS = ["A", "N", "R"]


def _round(df, names, digits=6):
    return df.withColumns({n: rounded(F.col(n), digits) for n in names})


def _messy(spark, d):
    """predobs with values that are not finite."""
    bad = F.when(F.col("row_id") % 11 == 0, F.lit(float("nan"))).when(F.col("row_id") % 13 == 0, F.lit(float("inf")))
    return derived(spark, d, "predobs").withColumn("obs", bad.otherwise(F.when(F.col("row_id") % 17 != 0, F.col("obs"))))


_MESSY = """messy AS (SELECT row_id, run, grp, CASE WHEN row_id % 11 = 0 THEN CAST('NaN' AS DOUBLE) WHEN row_id % 13 = 0 THEN CAST('Infinity' AS DOUBLE)
  WHEN row_id % 17 <> 0 THEN obs END AS obs, pred FROM predobs)"""


def numeric_clean(spark, d):
    return cleaning.numeric_clean(_messy(spark, d), ["obs", "pred"]).select("row_id", "run", "obs", "pred")


def target_non_negative(spark, d):
    shifted = derived(spark, d, "predobs").withColumn("target", F.col("obs") - 20000.0)
    return shifted.where("target >= 0").select("row_id", rounded(F.col("target"), 4).alias("target"))


def target_check(spark, d):
    return cleaning.target_check(_messy(spark, d), "obs")


def column_diagnostic(spark, d):
    return cleaning.column_diagnostic(_messy(spark, d), ["obs", "pred"])


def bad_columns(spark, d):
    return cleaning.bad_columns(_messy(spark, d), ["obs", "pred"])


def remove_outliers(spark, d):
    df = derived(spark, d, "soil").select("row_id", "sand_gkg", "p_mgkg")
    return cleaning.remove_outliers(df, ["sand_gkg", "p_mgkg"], 0.5)


def remove_outliers_grouped(spark, d):
    df = table(spark, d, "events").select("event_id", "event_type", "value")
    return cleaning.remove_outliers(df, ["value"], 1.5, ["event_type"])


def outlier_report(spark, d):
    df = table(spark, d, "events").select("event_id", "event_type", "value")
    return _round(cleaning.outlier_report(df, ["value"], 1.5, ["event_type"]), ["lower_bound", "upper_bound"], 4)


def clean_names(spark, d):
    df = table(spark, d, "orders").select(F.col("o_orderkey").alias("Order Key"), F.col("o_totalprice").alias("totalPrice (USD)"), F.col("o_custkey").alias("CustKey"))
    return cleaning.clean_names(df)


def safe_label(spark, d):
    from ..functions.expr import safe_label as label

    return table(spark, d, "part").select("p_partkey", label(F.col("p_brand"), F.col("p_type")).alias("label"))


def map_factor_back(spark, d):
    part = table(spark, d, "part")
    dummies = part.select(F.concat(F.col("p_brand"), F.col("p_type")).alias("dummy")).distinct()
    return cleaning.map_factor_back(dummies, part.select(F.col("p_brand").alias("factor")).distinct())


def row_limit(spark, d):
    return cleaning.row_limit(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 500)


def top_k_per_group(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return cleaning.top_k(df, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3)


def regression_metrics(spark, d):
    return _round(metrics.regression_metrics(derived(spark, d, "predobs")), metrics.REGRESSION, 4)


def regression_metrics_by_group(spark, d):
    return _round(metrics.regression_metrics(derived(spark, d, "predobs"), ["grp"]), metrics.REGRESSION, 4)


def null_model_metrics(spark, d):
    df = derived(spark, d, "predobs")
    return _round(metrics.null_model_metrics(df.where("run < 4"), df.where("run = 4"), ["grp"]), ["mae", "rmse"], 4)


def performance_by_run(spark, d):
    df = derived(spark, d, "predobs").withColumn("data", F.when(F.col("row_id") % 4 == 0, "test").otherwise("train"))
    return _round(metrics.regression_metrics(df, ["run", "data"]), metrics.REGRESSION, 4)


def pooled_test_metrics(spark, d):
    """Test rows of all runs, pooled: each row is tested in the run that it falls to."""
    df = derived(spark, d, "predobs").withColumn("data", F.when(F.col("row_id") % 5 == F.col("run"), "test").otherwise("train"))
    return _round(metrics.regression_metrics(df, ["data"]), metrics.REGRESSION, 4)


def class_metrics_multiclass(spark, d):
    return _round(metrics.class_metrics(derived(spark, d, "predcls"), _LEVELS, ["run"]), metrics.CLASSES)


def class_metrics_binary(spark, d):
    two = derived(spark, d, "predcls").select("run", *[F.when(F.col(c) == "A", "A").otherwise("other").alias(c) for c in ("obs", "pred")])
    return _round(metrics.class_metrics(two, ["A", "other"]), metrics.CLASSES)


def confusion_matrix(spark, d):
    return metrics.confusion(derived(spark, d, "predcls"), [*_LEVELS, "Z"])


def group_target_mean(spark, d):
    return _round(metrics.group_target_mean(derived(spark, d, "groups"), "group_id", "target"), ["target_mean"], 4)


def class_support(spark, d):
    return metrics.class_support(derived(spark, d, "groups"), ["a", "b", "c", "z"], "class", 3)


def group_class_support(spark, d):
    one = metrics.group_classes(derived(spark, d, "groups"), "group_id", "class")
    return metrics.class_support(one, ["a", "b", "c", "z"], "first_class", 2)


def group_class_table(spark, d):
    return metrics.group_classes(derived(spark, d, "groups"), "group_id", "class").where("n_classes = 1").select("group_id", "n_rows", "first_class")


def group_class_conflicts(spark, d):
    return metrics.group_classes(derived(spark, d, "predcls"), "run", "obs").where("n_classes > 1")


def pick_size_tolerance(spark, d):
    profile = metrics.regression_metrics(derived(spark, d, "predobs").withColumn("size", F.col("run") + 2), ["size"]).select("size", "r2")
    return _round(metrics.size_within_tolerance(profile, "size", "r2", 1.5), ["r2", "best", "loss_pct"], 4)


def near_zero_variance(spark, d):
    df = derived(spark, d, "soil").withColumn("flat", F.lit(1.0)).withColumn("rare", F.when(F.col("row_id") % 50 == 0, 1.0).otherwise(0.0))
    return _round(screening.near_zero_variance(df, [*_NUM, "flat", "rare"]), ["freq_ratio", "percent_unique"])


def spearman_matrix(spark, d):
    return _round(screening.spearman(derived(spark, d, "soil"), ["c_gkg", "sand_gkg", "clay_gkg"]), ["rho"])


def high_correlation_drop(spark, d):
    df = derived(spark, d, "soil").withColumn("c_twice", F.col("c_gkg") * 2)
    return screening.high_correlation_drop(df, ["c_gkg", "c_twice", "sand_gkg"], 0.9)


def stratified_holdout(spark, d):
    df = resample.quantile_strata(derived(spark, d, "groups"), "target")
    return resample.stratified_holdout(df, "stratum", "row_id", 0.75, 7).select("row_id", "stratum", "role")


def grouped_holdout(spark, d):
    return resample.grouped_holdout(derived(spark, d, "groups"), "group_id", "target", 0.75, 7).select("row_id", "group_id", "role")


def group_kfold(spark, d):
    return resample.group_kfold(derived(spark, d, "groups"), "group_id", "row_id", 4, 2, 11)


def stratified_group_kfold(spark, d):
    return resample.stratified_group_folds(derived(spark, d, "groups"), "group_id", "class", 4, 2, 11)


def fold_leakage_check(spark, d):
    return resample.fold_leakage(stratified_group_kfold(spark, d), "group_id")


def logo_index(spark, d):
    return resample.logo_index(derived(spark, d, "groups"), "group_id", "row_id")


def loo_index(spark, d):
    return resample.loo_index(derived(spark, d, "groups"), "row_id")


def logo_holdouts(spark, d):
    return resample.leave_one_out_rows(derived(spark, d, "groups"), "group_id", "row_id")


def _index(spark, d):
    g = derived(spark, d, "groups")
    return resample.group_kfold(g, "group_id", "row_id", 4, 2, 11).join(g.select("row_id", "class"), "row_id")


def validate_folds(spark, d):
    rows = derived(spark, d, "groups")
    return resample.validate_resamples(_index(spark, d), rows.count(), rows=rows)


def validate_folds_classes(spark, d):
    n = derived(spark, d, "groups").count()
    return resample.validate_resamples(_index(spark, d), n, 2, ["a", "b", "c", "z"]).where("usable = false")


def group_split_semi(spark, d):
    g = derived(spark, d, "groups")
    return g.join(g.where("row_id % 499 = 0").select("group_id").distinct(), "group_id", "left_semi").select("row_id", "group_id")


def group_split_anti(spark, d):
    g = derived(spark, d, "groups")
    return g.join(g.where("row_id % 499 = 0").select("group_id").distinct(), "group_id", "left_anti").select("row_id", "group_id")


def cumulative_weight(spark, d):
    rows = derived(spark, d, "cells").groupBy("row").agg(F.count(F.lit(1)).alias("w"))
    return rows.withColumn("cumulative", F.sum("w").over(Window.orderBy("row").rowsBetween(Window.unboundedPreceding, 0)))


def stack_runs(spark, d):
    df = derived(spark, d, "predobs")
    out = None
    for run in range(5):  # the runs have different columns
        one = df.where(F.col("run") == run).select("row_id", "obs" if run % 2 == 0 else "pred").withColumn("run_id", F.lit(f"run_{run + 1}"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def set_difference(spark, d):
    s, c = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_nationkey").alias("k"))
    both = s.intersect(c).withColumn("side", F.lit("both"))
    return s.subtract(c).withColumn("side", F.lit("left")).unionByName(both)


def selected_predictors_wide(spark, d):
    df = table(spark, d, "part").groupBy("p_size", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    ranked = cleaning.top_k(df, ["p_size"], [F.desc("n"), "p_brand"], 3)
    name = F.concat(F.lit("run_"), F.col("rank").cast("string"))
    return ranked.withColumn("name", name).groupBy("p_size").pivot("name", ["run_1", "run_2", "run_3"]).agg(F.first("p_brand"))


_FIN = "isfinite(obs) AND isfinite(pred)"


def _reg(source, groups="", where="TRUE"):
    g = f"{groups}, " if groups else ""
    by = f"GROUP BY {groups}" if groups else ""
    return f"""SELECT {g}round(CASE WHEN vp > 0 THEN 2 * co / (vo + vp + (mo - mp) ** 2) END, 4) AS ccc, round(CASE WHEN vp > 0 THEN r ** 2 END, 4) AS r2,
      round(1 - mse / vo, 4) AS nse, round(mae, 4) AS mae, round(sqrt(mse), 4) AS rmse,
      round(CASE WHEN vp > 0 AND mo <> 0 AND mae <> 0 THEN 2 * co / (vo + vp + (mo - mp) ** 2) * (1 - mse / vo) / (mae / mo) END, 4) AS mqi
      FROM (SELECT {g}avg(obs) AS mo, avg(pred) AS mp, var_pop(obs) AS vo, var_pop(pred) AS vp, covar_pop(obs, pred) AS co, corr(obs, pred) AS r,
      avg(abs(pred - obs)) AS mae, avg((pred - obs) ** 2) AS mse FROM {source} WHERE {where} AND {_FIN} {by})"""


_PER = """per AS (SELECT run, l.level, count(CASE WHEN obs = level AND pred = level THEN 1 END) AS t, count(CASE WHEN pred = level THEN 1 END) AS a,
  count(CASE WHEN obs = level THEN 1 END) AS b, count(*) AS n FROM cls, (SELECT unnest({levels}) AS level) l GROUP BY run, l.level)"""
_CLS_VALUES = """round(avg(t / nullif(b, 0)), 6) AS sensitivity, round(avg((n - a - b + t) / nullif(n - b, 0)), 6) AS specificity,
  round(avg(t / nullif(a, 0)), 6) AS ppv, round(avg((n - a - b + t) / nullif(n - a, 0)), 6) AS npv, round(avg(t / nullif(a, 0)), 6) AS precision,
  round(avg(t / nullif(b, 0)), 6) AS recall, round(avg(2 * (t / nullif(a, 0)) * (t / nullif(b, 0)) / nullif(t / nullif(a, 0) + t / nullif(b, 0), 0)), 6) AS f1,
  round(avg(b / n), 6) AS prevalence, round(avg(t / n), 6) AS detection_rate, round(avg(a / n), 6) AS detection_prevalence,
  round(avg((t / nullif(b, 0) + (n - a - b + t) / nullif(n - b, 0)) / 2), 6) AS balanced_accuracy"""
_WHOLE = "w AS (SELECT run, sum(t) / max(n) AS po, sum(CAST(a AS DOUBLE) * b) / (max(n) * CAST(max(n) AS DOUBLE)) AS pe FROM per GROUP BY run)"
_KAPPA = "round(po, 6) AS accuracy, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa"


def _md5(ids, seed):
    return f"md5(concat_ws('-', {ids}, {seed}))"


_FOLDS = f"""WITH g AS (SELECT DISTINCT group_id FROM groups), r AS (SELECT group_id, unnest([1, 2]) AS rep FROM g),
 f AS (SELECT *, CAST((row_number() OVER (PARTITION BY rep ORDER BY {_md5('group_id', 'rep + 11')}, group_id) - 1) % 4 + 1 AS INTEGER) AS fold FROM r),
 idx AS (SELECT printf('Fold%02d.Rep%02d', k, rep) AS resample, row_id, class, CASE WHEN k = fold THEN 'holdout' ELSE 'train' END AS role
 FROM groups JOIN f USING (group_id), (SELECT unnest([1, 2, 3, 4]) AS k))"""
_VALID = """, v AS (SELECT resample, CAST(0 AS BIGINT) AS n_unknown, count(CASE WHEN role = 'train' THEN 1 END) AS n_train, count(CASE WHEN role = 'holdout' THEN 1 END) AS n_holdout,
 count(DISTINCT CASE WHEN role = 'train' THEN class END) AS n_train_classes FROM idx GROUP BY 1)"""
_SFOLDS = f"""WITH g AS (SELECT group_id, min(class) AS class FROM groups GROUP BY 1), r AS (SELECT *, unnest([1, 2]) AS rep FROM g),
 f AS (SELECT group_id, class, rep, CAST((row_number() OVER (PARTITION BY rep, class ORDER BY {_md5('group_id', 'rep + 11')}, group_id) - 1) % 4 + 1 AS INTEGER) AS fold FROM r)"""
_STRATA = "(CASE WHEN {v} > q[1] THEN 1 ELSE 0 END + CASE WHEN {v} > q[2] THEN 1 ELSE 0 END + CASE WHEN {v} > q[3] THEN 1 ELSE 0 END + CASE WHEN {v} > q[4] THEN 1 ELSE 0 END)"
_CUT = "(SELECT quantile_cont({v}, [0.2, 0.4, 0.6, 0.8]) FROM {t}) AS q"
_EV = """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, count(*) AS n FROM events GROUP BY 1)"""


def _nzv(names):
    parts = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS v FROM t" for c in names)
    return with_inputs(
        "soil",
        f"""WITH t AS (SELECT *, 1.0 AS flat, CASE WHEN row_id % 50 = 0 THEN 1.0 ELSE 0.0 END AS rare FROM soil), l AS ({parts}),
 k AS (SELECT column_name, v, count(*) AS n, row_number() OVER (PARTITION BY column_name ORDER BY count(*) DESC, v DESC) AS r FROM l WHERE v IS NOT NULL GROUP BY 1, 2),
 z AS (SELECT column_name, max(CASE WHEN r = 1 THEN n END) AS n1, max(CASE WHEN r = 2 THEN n END) AS n2, count(*) AS u FROM k GROUP BY 1),
 s AS (SELECT column_name, count(*) AS n FROM l GROUP BY 1)
 SELECT column_name, round(coalesce(n1 / n2, 0), 6) AS freq_ratio, round(100 * u / n, 6) AS percent_unique,
 u <= 1 OR (coalesce(n1 / n2, 0) > 19 AND 100 * u / n <= 10) AS "drop" FROM z JOIN s USING (column_name)""",
    )


def _rho(a, b):
    return f"""SELECT '{a}' AS column_1, '{b}' AS column_2, round(corr(ra, rb), 6) AS rho FROM (SELECT
 rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2 AS ra, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2 AS rb
 FROM soil WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


_DIAGCOL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(CASE WHEN {c} IS NULL OR isnan({c}) THEN 1 END) AS n_na, count(CASE WHEN isnan({c}) THEN 1 END) AS n_nan, "
    f"count(CASE WHEN isinf({c}) THEN 1 END) AS n_inf, count(DISTINCT CASE WHEN NOT isnan({c}) THEN {c} END) AS n_unique FROM messy"
    for c in ("obs", "pred")
)
_SUPPORT = "SELECT l.level, count(g.k) AS n, count(g.k) = 0 AS missing, count(g.k) < {least} AS too_few FROM (SELECT unnest(['a', 'b', 'c', 'z']) AS level) l LEFT JOIN {src} g ON g.k = l.level GROUP BY 1"

ORACLES = {
    "numeric_clean": with_inputs("predobs", f"WITH {_MESSY} SELECT row_id, run, round(obs, 4) AS obs, round(pred, 4) AS pred FROM messy WHERE {_FIN}"),
    "target_non_negative": with_inputs("predobs", "SELECT row_id, round(obs - 20000.0, 4) AS target FROM predobs WHERE obs - 20000.0 >= 0"),
    "target_check": with_inputs("predobs", f"WITH {_MESSY} SELECT count(*) AS n_rows, count(CASE WHEN isfinite(obs) THEN 1 END) AS n_finite, count(DISTINCT CASE WHEN isfinite(obs) THEN obs END) AS n_distinct, TRUE AS usable FROM messy"),
    "column_diagnostic": with_inputs("predobs", f"WITH {_MESSY} {_DIAGCOL}"),
    "bad_columns": with_inputs("predobs", f"WITH {_MESSY} SELECT * FROM ({_DIAGCOL}) WHERE n_na > 0 OR n_inf > 0"),
    "remove_outliers": with_inputs("soil", """WITH q AS (SELECT quantile_cont(sand_gkg, 0.25) AS a, quantile_cont(sand_gkg, 0.75) AS b FROM soil),
      s1 AS (SELECT soil.* FROM soil, q WHERE sand_gkg BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a)),
      q2 AS (SELECT quantile_cont(p_mgkg, 0.25) AS a, quantile_cont(p_mgkg, 0.75) AS b FROM s1)
      SELECT row_id, sand_gkg, p_mgkg FROM s1, q2 WHERE p_mgkg BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a)"""),
    "remove_outliers_grouped": _EV + " SELECT event_id, event_type, value FROM events JOIN q USING (event_type) WHERE value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)",
    "outlier_report": _EV + """ SELECT event_type, n AS n_before, round(a - 1.5 * (b - a), 4) AS lower_bound, round(b + 1.5 * (b - a), 4) AS upper_bound,
      count(CASE WHEN value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) THEN 1 END) AS n_after, 'value' AS column_name, 1 AS step
      FROM events JOIN q USING (event_type) GROUP BY event_type, n, a, b""",
    "clean_names": "SELECT o_orderkey AS order_key, o_totalprice AS total_price_usd, o_custkey AS cust_key FROM orders",
    "safe_label": "SELECT p_partkey, lower(regexp_replace(regexp_replace(concat_ws('_', p_brand, p_type), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS label FROM part",
    "map_factor_back": """WITH u AS (SELECT DISTINCT p_brand || p_type AS dummy FROM part), f AS (SELECT DISTINCT p_brand AS factor FROM part)
      SELECT dummy, coalesce(arg_max(factor, length(factor)), dummy) AS source FROM u LEFT JOIN f ON starts_with(dummy, factor) GROUP BY dummy""",
    "row_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500",
    "top_k_per_group": "SELECT o_orderkey, o_custkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders QUALIFY rank <= 3",
    "regression_metrics": with_inputs("predobs", _reg("predobs")),
    "regression_metrics_by_group": with_inputs("predobs", _reg("predobs", "grp")),
    "null_model_metrics": with_inputs("predobs", """SELECT grp, round(avg(abs(m - obs)), 4) AS mae, round(sqrt(avg((m - obs) ** 2)), 4) AS rmse
      FROM predobs, (SELECT avg(obs) AS m FROM predobs WHERE run < 4) WHERE run = 4 GROUP BY grp"""),
    "performance_by_run": with_inputs("predobs", "WITH pr AS (SELECT *, CASE WHEN row_id % 4 = 0 THEN 'test' ELSE 'train' END AS data FROM predobs) " + _reg("pr", "run, data")),
    "pooled_test_metrics": with_inputs("predobs", "WITH pr AS (SELECT *, CASE WHEN row_id % 5 = run THEN 'test' ELSE 'train' END AS data FROM predobs) " + _reg("pr", "data")),
    "class_metrics_multiclass": with_inputs("predcls", f"WITH cls AS (SELECT * FROM predcls), {_PER.format(levels=_LEVELS)}, {_WHOLE} SELECT run, {_KAPPA}, {_CLS_VALUES} FROM per JOIN w USING (run) GROUP BY run, po, pe"),
    "class_metrics_binary": with_inputs("predcls", f"WITH cls AS (SELECT 0 AS run, CASE WHEN obs = 'A' THEN obs ELSE 'other' END AS obs, CASE WHEN pred = 'A' THEN pred ELSE 'other' END AS pred FROM predcls), {_PER.format(levels=['A', 'other'])}, {_WHOLE} SELECT {_KAPPA}, {_CLS_VALUES} FROM per JOIN w USING (run) WHERE level = 'A' GROUP BY po, pe"),
    "confusion_matrix": with_inputs("predcls", "WITH l AS (SELECT unnest(['A', 'N', 'R', 'Z']) AS level) SELECT p.level AS pred, o.level AS obs, count(c.obs) AS n FROM l p CROSS JOIN l o LEFT JOIN predcls c ON c.pred = p.level AND c.obs = o.level GROUP BY 1, 2"),
    "group_target_mean": with_inputs("groups", "SELECT group_id, count(*) AS n_rows, round(avg(target), 4) AS target_mean FROM groups GROUP BY 1"),
    "class_support": with_inputs("groups", _SUPPORT.format(least=3, src="(SELECT class AS k FROM groups)")),
    "group_class_support": with_inputs("groups", _SUPPORT.format(least=2, src="(SELECT min(class) AS k FROM groups GROUP BY group_id)")),
    "group_class_table": with_inputs("groups", "SELECT group_id, count(*) AS n_rows, min(class) AS first_class FROM groups GROUP BY 1 HAVING count(DISTINCT class) = 1"),
    "group_class_conflicts": with_inputs("predcls", "SELECT run, count(*) AS n_rows, count(DISTINCT obs) AS n_classes, min(obs) AS first_class FROM predcls GROUP BY 1 HAVING count(DISTINCT obs) > 1"),
    "pick_size_tolerance": with_inputs("predobs", """WITH p AS (SELECT run + 2 AS size, corr(obs, pred) ** 2 AS r2 FROM predobs GROUP BY 1), b AS (SELECT max(r2) AS best FROM p)
      SELECT size, round(r2, 4) AS r2, round(best, 4) AS best, round((best - r2) / best * 100, 4) AS loss_pct FROM p, b WHERE (best - r2) / best * 100 <= 1.5 ORDER BY size LIMIT 1"""),
    "near_zero_variance": _nzv([*_NUM, "flat", "rare"]),
    "spearman_matrix": with_inputs("soil", " UNION ALL ".join(_rho(a, b) for a, b in [("c_gkg", "sand_gkg"), ("c_gkg", "clay_gkg"), ("sand_gkg", "clay_gkg")])),
    "stratified_holdout": with_inputs("groups", f"""WITH s AS (SELECT row_id, CAST({_STRATA.format(v='target')} AS INTEGER) AS stratum FROM (SELECT *, {_CUT.format(v='target', t='groups')} FROM groups))
      SELECT row_id, stratum, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY {_md5('row_id', "'7'")}, row_id) <= ceil(count(*) OVER (PARTITION BY stratum) * 0.75) THEN 'train' ELSE 'test' END AS role FROM s"""),
    "grouped_holdout": with_inputs("groups", f"""WITH m AS (SELECT group_id, avg(target) AS tm FROM groups GROUP BY 1),
      s AS (SELECT group_id, {_STRATA.format(v='tm')} AS stratum FROM (SELECT *, {_CUT.format(v='tm', t='m')} FROM m)),
      r AS (SELECT group_id, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY {_md5('group_id', "'7'")}, group_id) <= ceil(count(*) OVER (PARTITION BY stratum) * 0.75) THEN 'train' ELSE 'test' END AS role FROM s)
      SELECT row_id, group_id, role FROM groups JOIN r USING (group_id)"""),
    "group_kfold": with_inputs("groups", _FOLDS + " SELECT resample, row_id, role FROM idx"),
    "stratified_group_kfold": with_inputs("groups", _SFOLDS + " SELECT group_id, class, rep, fold FROM f"),
    "fold_leakage_check": with_inputs("groups", _SFOLDS + " SELECT rep, count(*) AS n_groups, count(CASE WHEN nf > 1 THEN 1 END) AS n_leaking FROM (SELECT rep, group_id, count(DISTINCT fold) AS nf FROM f GROUP BY 1, 2) GROUP BY 1"),
    "logo_index": with_inputs("groups", "SELECT group_id, count(*) AS n_holdout, (SELECT count(*) FROM groups) - count(*) AS n_train FROM groups GROUP BY 1"),
    "loo_index": with_inputs("groups", "SELECT row_id, count(*) AS n_holdout, (SELECT count(*) FROM groups) - count(*) AS n_train FROM groups GROUP BY 1"),
    "logo_holdouts": with_inputs("groups", "SELECT group_id AS unit, row_id FROM groups"),
    "high_correlation_drop": with_inputs("soil", "WITH c AS (SELECT abs(rho) AS r FROM (" + _rho("c_gkg", "sand_gkg") + """)) SELECT 'c_gkg' AS column_name, (1 + r) / 2 > (1 + 3 * r) / 4 AS "drop" FROM c UNION ALL SELECT 'c_twice', NOT (1 + r) / 2 > (1 + 3 * r) / 4 FROM c UNION ALL SELECT 'sand_gkg', FALSE FROM c"""),
    "validate_folds": with_inputs("groups", _FOLDS + _VALID + " SELECT *, n_train >= 2 AND n_holdout >= 2 AND n_train + n_holdout <= (SELECT count(*) FROM groups) AS usable FROM v"),
    "validate_folds_classes": with_inputs("groups", _FOLDS + _VALID + " SELECT *, FALSE AS usable FROM v WHERE n_train_classes <> 4"),
    "group_split_semi": with_inputs("groups", "SELECT row_id, group_id FROM groups WHERE group_id IN (SELECT group_id FROM groups WHERE row_id % 499 = 0)"),
    "group_split_anti": with_inputs("groups", "SELECT row_id, group_id FROM groups WHERE group_id NOT IN (SELECT group_id FROM groups WHERE row_id % 499 = 0)"),
    "cumulative_weight": with_inputs("cells", "WITH r AS (SELECT row, count(*) AS w FROM cells GROUP BY 1) SELECT row, w, CAST(sum(w) OVER (ORDER BY row) AS BIGINT) AS cumulative FROM r"),
    "stack_runs": with_inputs("predobs", "SELECT row_id, CASE WHEN run % 2 = 0 THEN obs END AS obs, CASE WHEN run % 2 = 1 THEN pred END AS pred, 'run_' || (run + 1) AS run_id FROM predobs"),
    "set_difference": """WITH s AS (SELECT s_nationkey AS k FROM supplier), c AS (SELECT c_nationkey AS k FROM customer WHERE c_custkey % 3 = 0)
      SELECT k, 'left' AS side FROM (SELECT k FROM s EXCEPT SELECT k FROM c) UNION ALL SELECT k, 'both' FROM (SELECT k FROM s INTERSECT SELECT k FROM c)""",
    "selected_predictors_wide": """WITH c AS (SELECT p_size, p_brand, row_number() OVER (PARTITION BY p_size ORDER BY count(*) DESC, p_brand) AS r FROM part GROUP BY 1, 2)
      SELECT p_size, max(CASE WHEN r = 1 THEN p_brand END) AS run_1, max(CASE WHEN r = 2 THEN p_brand END) AS run_2, max(CASE WHEN r = 3 THEN p_brand END) AS run_3 FROM c GROUP BY 1""",
}

QUERIES = [
    numeric_clean, target_non_negative, target_check, column_diagnostic, bad_columns, remove_outliers, remove_outliers_grouped, outlier_report,
    clean_names, safe_label, map_factor_back, row_limit, top_k_per_group, regression_metrics, regression_metrics_by_group, null_model_metrics,
    performance_by_run, pooled_test_metrics, class_metrics_multiclass, class_metrics_binary, confusion_matrix, group_target_mean, class_support,
    group_class_support, group_class_table, group_class_conflicts, pick_size_tolerance, near_zero_variance, spearman_matrix, high_correlation_drop,
    stratified_holdout, grouped_holdout, group_kfold, stratified_group_kfold, fold_leakage_check, logo_index, logo_holdouts, loo_index, validate_folds,
    validate_folds_classes, group_split_semi, group_split_anti, cumulative_weight, stack_runs, set_difference, selected_predictors_wide,
]
