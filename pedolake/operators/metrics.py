"""Accuracy of predictions, from one aggregation of moments or counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import finite, ratio_nonzero

# Names of the metrics.
REGRESSION = ["ccc", "r2", "nse", "mae", "rmse", "mqi"]
CLASSES = [
    "accuracy", "kappa", "sensitivity", "specificity", "ppv", "npv", "precision", "recall", "f1", "prevalence",
    "detection_rate", "detection_prevalence", "balanced_accuracy",
]


def _finite_or_null(c: Column) -> Column:
    return F.when(finite(c), c)


def regression_metrics(df: DataFrame, groups: Sequence[str] = (), obs: str = "obs", pred: str = "pred") -> DataFrame:
    """ccc, r2, nse, mae, rmse and mqi over finite pairs; all null for fewer than two pairs or a constant target."""
    o, p = F.col(obs).try_cast("double"), F.col(pred).try_cast("double")
    pairs = df.select(*groups, o.alias("o"), p.alias("p")).where(finite(F.col("o")) & finite(F.col("p")))
    o, p = F.col("o"), F.col("p")
    m = pairs.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(o).alias("mo"),
        F.avg(p).alias("mp"),
        F.var_pop(o).alias("vo"),
        F.var_pop(p).alias("vp"),
        F.covar_pop(o, p).alias("co"),
        F.avg(F.abs(p - o)).alias("mae"),
        F.avg((p - o) * (p - o)).alias("mse"),
    )
    ok = (F.col("n") >= 2) & (F.col("vo") > 0)
    ccc = F.when(F.col("vp") > 0, 2 * F.col("co") / (F.col("vo") + F.col("vp") + (F.col("mo") - F.col("mp")) ** 2))
    r2 = F.when(F.col("vp") > 0, F.col("co") * F.col("co") / (F.col("vo") * F.col("vp")))
    nse = 1 - F.col("mse") / F.col("vo")
    mqi = F.when((F.col("mo") != 0) & (F.col("mae") != 0), ccc * nse / (F.col("mae") / F.col("mo")))
    values = {"ccc": ccc, "r2": r2, "nse": nse, "mae": F.col("mae"), "rmse": F.sqrt("mse"), "mqi": mqi}
    return m.select(*groups, *[_finite_or_null(F.when(ok, v)).alias(k) for k, v in values.items()])


def null_model_metrics(train: DataFrame, test: DataFrame, groups: Sequence[str] = (), obs: str = "obs") -> DataFrame:
    """mae and rmse of predicting the mean of the training rows."""
    mean = train.agg(F.avg(obs).alias("pred"))
    out = regression_metrics(test.select(*groups, obs).join(F.broadcast(mean)), groups, obs)
    return out.select(*groups, "mae", "rmse")


def confusion(df: DataFrame, levels: Sequence[str], groups: Sequence[str] = (), obs: str = "obs", pred: str = "pred", weight: str | None = None) -> DataFrame:
    """Counts of every (pred, obs) of the levels, zeros included; rows with a null or unknown level are dropped. A weight is
    the number of rows that a row stands for."""
    known = df.where(F.col(obs).isin(list(levels)) & F.col(pred).isin(list(levels)))
    counts = known.groupBy(*groups, F.col(pred).alias("pred"), F.col(obs).alias("obs")).agg((F.sum(weight).cast("long") if weight else F.count(F.lit(1))).alias("n"))
    every = counts.select(*groups).distinct() if groups else counts.sparkSession.range(1).select()
    grid = every.withColumn("pred", F.explode(F.array(*map(F.lit, levels)))).withColumn("obs", F.explode(F.array(*map(F.lit, levels))))
    return grid.join(counts, [*groups, "pred", "obs"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def class_metrics(df: DataFrame, levels: Sequence[str], groups: Sequence[str] = (), obs: str = "obs", pred: str = "pred", weight: str | None = None) -> DataFrame:
    """Thirteen metrics; with two levels the first is the positive class, else classes are averaged without empty ratios."""
    grid = confusion(df, levels, groups, obs, pred, weight)
    tp = F.when(F.col("pred") == F.col("obs"), F.col("n")).otherwise(0)
    by_pred = grid.groupBy(*groups, F.col("pred").alias("level")).agg(F.sum("n").alias("np"), F.sum(tp).alias("tp"))
    by_obs = grid.groupBy(*groups, F.col("obs").alias("level")).agg(F.sum("n").alias("no"))
    per = by_pred.join(by_obs, [*groups, "level"])
    total = per.groupBy(*groups).agg(F.sum("np").alias("total"), F.sum("tp").alias("hits"), F.sum(F.col("np") * F.col("no")).alias("chance"))
    per = per.join(F.broadcast(total), list(groups)) if groups else per.join(F.broadcast(total))
    t, a, b, n = F.col("tp"), F.col("np"), F.col("no"), F.col("total")
    tn = n - a - b + t
    sens, spec, ppv, npv = F.try_divide(t, b), F.try_divide(tn, n - b), F.try_divide(t, a), F.try_divide(tn, n - a)
    values = {
        "sensitivity": sens, "specificity": spec, "ppv": ppv, "npv": npv, "precision": ppv, "recall": sens,
        "f1": F.try_divide(2 * ppv * sens, ppv + sens), "prevalence": F.try_divide(b, n), "detection_rate": F.try_divide(t, n),
        "detection_prevalence": F.try_divide(a, n), "balanced_accuracy": (sens + spec) / 2,
    }
    used = per.where(F.col("level") == levels[0]) if len(levels) == 2 else per
    averages = used.groupBy(*groups).agg(*[F.avg(v).alias(k) for k, v in values.items()])
    pe = F.col("chance") / (F.col("total") * F.col("total"))
    po = F.try_divide(F.col("hits"), F.col("total"))
    whole = total.select(*groups, po.alias("accuracy"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))
    return whole.join(averages, list(groups)) if groups else whole.join(averages)


def group_target_mean(df: DataFrame, group: str, target: str) -> DataFrame:
    """Rows, mean of the target and first class label of each group."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(target).alias("target_mean"))


def class_support(df: DataFrame, levels: Sequence[str], column: str, least: int) -> DataFrame:
    """Rows of each expected class (0 if absent) and whether they are enough."""
    expected = df.sparkSession.createDataFrame([(x,) for x in levels], "level string")
    seen = df.groupBy(F.col(column).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    out = expected.join(seen, "level", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return out.withColumn("missing", F.col("n") == 0).withColumn("too_few", F.col("n") < least)


def group_classes(df: DataFrame, group: str, column: str) -> DataFrame:
    """For each group its rows, number of classes and first class."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(column).alias("n_classes"), F.min(column).alias("first_class")
    )


def size_within_tolerance(profile: DataFrame, size: str, metric: str, tol: float) -> DataFrame:
    """The smallest size whose metric is at most tol per cent below the best."""
    best = profile.agg(F.max(metric).alias("best"))
    loss = ratio_nonzero(F.col("best") - F.col(metric), F.col("best")) * 100
    fit = profile.join(F.broadcast(best)).withColumn("loss_pct", loss).where(F.col("loss_pct") <= tol)
    return fit.orderBy(size).limit(1)
