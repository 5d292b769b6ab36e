"""Validation pipelines for regression and classification: a learner goes through elimination of predictors,
tuning and a final fit, within repeated holdouts, with one unit left out at a time, or on all rows.

A learner is passed in, so any family (or a model of one's own) takes the same way. Every fit is one or a
few Spark jobs over the whole training part; fits that do not depend on each other run side by side.
Inner folds are dealt by groups where groups are given, so that no group is on both sides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from threading import BoundedSemaphore

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml import Estimator
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scratch import written
from ..sources import catalog
from . import metrics, modelling, moments, resample

FOLD, ROWS, DRAWN, LABEL = "__fold", "__rows", "__drawn", "__label"
#: Units that are solved together, rows that a gathered row must stand for on average, and trees whose draws are gathered.
SOLVED, GATHERED, DRAWN_TREES = 2048, 8, 64


@dataclass(frozen=True)
class Fitted:
    """A fitted model: adds ``prediction`` to rows, and tells the importance of each predictor."""

    score: Callable[[DataFrame], DataFrame]
    importance: Mapping[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Learner:
    """A model family: its task, how it is fitted (rows, predictors, label, parameters), and the parameters to try."""

    name: str
    task: str
    fit: Callable[[DataFrame, Sequence[str], str, Mapping], Fitted]
    grid: Sequence[Mapping] = ({},)
    #: Whether it is least squares with the parameter ``penalty``, which pipelines may then fit from moments.
    moments: bool = False
    #: Whether rows of equal predictors may enter a fit as one row, with their mean label and their number in ROWS.
    gathers: bool = False
    #: Trees that each draw rows of their own: a gathered row has, for each, the number (DRAWN) and mean label (LABEL) of its drawn rows.
    trees: int = 0

    def __post_init__(self):
        if self.task not in ("regression", "classification"):
            raise ValueError(f"unknown task {self.task}")
        if not self.grid:
            raise ValueError("a learner needs at least one set of parameters")


def linear(penalties: Sequence[float] = (0.0,)) -> Learner:
    """Least squares from moments of one aggregation; a penalty adds a share of each predictor's own square sum.

    A predictor that is a combination of others gets the least of all solutions."""

    def fit(rows: DataFrame, columns: Sequence[str], label: str, params: Mapping) -> Fitted:
        scale = moments.scale_of(rows, [*columns, label])
        sums = moments.part_sums(rows.withColumn(FOLD, F.lit(0)), [FOLD], scale).first()
        n, v = (np.array([sums["n"]]), np.array([sums["sums"]])) if sums else (np.zeros(1), np.zeros((1, (len(columns) + 1) * (len(columns) + 4) // 2)))
        w, base, importance = moments.raw_units(moments.fitted(n, v, np.ones((1, len(columns))), params.get("penalty", 0.0)), scale)
        value = sum((F.lit(float(x)) * F.col(c).cast("double") for x, c in zip(w[0], columns, strict=True)), F.lit(float(base[0])))
        return Fitted(lambda df: df.withColumn("prediction", value), dict(zip(columns, map(float, importance[0]), strict=True)))

    return Learner("linear", "regression", fit, tuple({"penalty": float(x)} for x in penalties), moments=True)


def centroids() -> Learner:
    """Class of the nearest class mean, ties to the first in alphabetical order; means come from one aggregation."""

    def fit(rows: DataFrame, columns: Sequence[str], label: str, _: Mapping) -> Fitted:
        full = rows.select(F.col(label).alias("label"), *[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
        means = full.groupBy("label").agg(*[F.avg(c).alias(c) for c in columns]).orderBy("label").collect()
        far = [sum((F.col(c).cast("double") - F.lit(r[c])) ** 2 for c in columns) for r in means]
        best = F.lit(None).cast("string")
        if far:
            least = F.least(*far) if len(far) > 1 else far[0]
            best = F.coalesce(*[F.when(d == least, F.lit(r["label"])) for d, r in zip(far, means, strict=True)])
        spread = {c: float(np.ptp([r[c] for r in means])) if means else 0.0 for c in columns}
        return Fitted(lambda df: df.withColumn("prediction", best), spread)

    return Learner("centroids", "classification", fit)


def spark_learner(name: str, task: str, make: Callable[..., Estimator], grid: Sequence[Mapping] = ({},), gathers: bool = False) -> Learner:
    """A family of Spark ML: ``make`` gets the parameters. Class labels are numbered in alphabetical order.

    ``gathers`` is for families that take weights and see a row through its label's mean and weight alone, as boosted
    regression trees by squares without subsampling do (a forest draws rows: see ``forest_learner``)."""

    def fit(rows: DataFrame, columns: Sequence[str], label: str, params: Mapping) -> Fitted:
        levels: list[str] = []
        if task == "classification":
            levels = sorted(r[0] for r in rows.select(label).where(F.col(label).isNotNull()).distinct().collect())
            rows = rows.withColumn("__y", F.array_position(F.array(*map(F.lit, levels)), F.col(label)) - 1)
        weight = [ROWS] if ROWS in rows.columns else []
        estimator = make(**params).setWeightCol(ROWS) if weight else make(**params)
        model = estimator.fit(modelling.assembled(rows, columns, "__y" if levels else label).select("features", "label", *weight))
        weights = getattr(model, "featureImportances", None)
        if weights is None:  # one model for each class
            parts = [m.featureImportances.toArray() for m in getattr(model, "models", []) if hasattr(m, "featureImportances")]
            weights = np.mean(parts, 0) if parts else np.zeros(len(columns))
        else:
            weights = weights.toArray()

        def score(df: DataFrame) -> DataFrame:
            out = model.transform(modelling.assembled(df.withColumn("__one", F.lit(0.0)), columns, "__one"))
            if levels:
                out = out.withColumn("prediction", F.array(*map(F.lit, levels))[F.col("prediction").cast("int")])
            return out.select(*df.columns, "prediction")

        return Fitted(score, dict(zip(columns, map(float, weights), strict=True)))

    return Learner(name, task, fit, grid, gathers=gathers)


def forest_learner(name: str, trees: int, make: Callable[..., RandomForestRegressor], grid: Sequence[Mapping] = ({},)) -> Learner:
    """A regression forest: ``make`` gets the parameters and gives so many trees.

    Each tree draws each row a Poisson number of times, as in Spark. A split by squares sees the drawn rows of equal predictors
    through their number and mean label alone, so where rows are gathered each tree is fitted to its own of these."""
    whole = spark_learner(name, "regression", make, grid)
    for params in grid:
        one = make(**params)
        if one.getNumTrees() != trees or not one.getBootstrap() or one.getSubsamplingRate() != 1 or one.getMinInstancesPerNode() != 1 or one.getMinWeightFractionPerNode():
            raise ValueError(f"a forest of {trees} trees that draws as many rows as there are, with leaves of any size, is needed")

    def fit(rows: DataFrame, columns: Sequence[str], label: str, params: Mapping) -> Fitted:
        if f"{DRAWN}0" not in rows.columns:
            return whole.fit(rows, columns, label, params)

        def tree(t: int):
            own, weight = make(**params), f"{DRAWN}{t}"
            some = own.getFeatureSubsetStrategy()
            own = own.setNumTrees(1).setBootstrap(False).setFeatureSubsetStrategy("onethird" if some == "auto" and trees > 1 else some)
            own = own.setSeed(own.getSeed() + t).setLeafCol("").setWeightCol(weight).setPredictionCol(f"__p{t}")
            return own.fit(modelling.assembled(rows.where(F.col(weight) > 0), columns, f"{LABEL}{t}").select("features", "label", weight))

        with ThreadPoolExecutor(min(trees, 8)) as pool:
            models = list(pool.map(tree, range(trees)))
        weights = np.sum([m.featureImportances.toArray() for m in models], 0)
        weights = weights / (weights.sum() or 1.0)

        def score(df: DataFrame) -> DataFrame:
            out = modelling.assembled(df.withColumn("__one", F.lit(0.0)), columns, "__one")
            for m in models:
                out = m.transform(out)
            return out.select(*df.columns, (sum(F.col(f"__p{t}") for t in range(trees)) / trees).alias("prediction"))

        return Fitted(score, dict(zip(columns, map(float, weights), strict=True)))

    return replace(whole, fit=fit, gathers=True, trees=trees)


def drawn_times(*by: Column) -> Column:
    """How often a row is drawn with replacement: a Poisson number of mean 1, from the hash of what names the draw."""
    u, out, k, term, below = F.pmod(F.xxhash64(*by), F.lit(1 << 52)) / float(1 << 52), None, 0, np.exp(-1.0), np.exp(-1.0)
    while below < 1 - 2.0**-52:
        out = (F if out is None else out).when(u < float(below), float(k))
        k += 1
        term /= k
        below += term
    return out.otherwise(float(k))


def gathered(rows: DataFrame, learner: Learner, columns: Sequence[str], label: str, keys: Sequence[str], key: str | None = None) -> DataFrame:
    """Rows with a label that agree in keys and predictors as one, with their mean label (a class: one for each) and their
    number, where the learner allows it and that makes them far fewer; else the rows as they are.

    For trees that draw rows, named by key, these are the drawn rows of each tree, where there are not too many trees."""
    if not learner.gathers or (learner.trees and (key is None or learner.trees > DRAWN_TREES)):
        return rows
    by = [*keys, *columns, *([label] if learner.task == "classification" else [])]
    n, kinds = rows.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*by))).first()
    if kinds * GATHERED > n:
        return rows
    if learner.trees:
        drawn = rows.where(F.col(label).isNotNull()).withColumns({f"{DRAWN}{t}": drawn_times(F.lit(t), *[F.col(c) for c in (*keys, key)]) for t in range(learner.trees)})
        sums = [x for t in range(learner.trees) for w in [F.col(f"{DRAWN}{t}")] for x in (F.sum(w).alias(f"{DRAWN}{t}"), F.try_divide(F.sum(w * F.col(label)), F.sum(w)).alias(f"{LABEL}{t}"))]
        return written(drawn.groupBy(*by).agg(*sums), "gathered")
    mean = [F.avg(label).alias(label)] if learner.task == "regression" else []
    return written(rows.where(F.col(label).isNotNull()).groupBy(*by).agg(*mean, F.count(F.lit(1)).cast("double").alias(ROWS)), "gathered")


def by_kind(rows: DataFrame, few: DataFrame, learner: Learner, columns: Sequence[str]) -> Learner:
    """The learner with predictions made once for all rows of equal predictors and joined to the rows, if few are gathered."""
    if not learner.gathers or few is rows:
        return learner
    kinds = written(rows.select(*columns).distinct(), "kinds")

    def fit(*args) -> Fitted:
        own = learner.fit(*args)

        def score(df: DataFrame) -> DataFrame:
            told = own.score(kinds).withColumnsRenamed({c: f"__k_{c}" for c in columns})
            return df.join(told, [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in columns]).select(*df.columns, "prediction")

        return Fitted(score, own.importance)

    return replace(learner, fit=fit)


def _in_turn(learner: Learner, threads: int) -> Learner:
    """The learner with so many fits at once at most: each holds its rows, and pools of threads lie in each other."""
    gate = BoundedSemaphore(threads)

    def fit(*args) -> Fitted:
        with gate:
            return learner.fit(*args)

    return replace(learner, fit=fit)


def report(scored: DataFrame, task: str, label: str, levels: Sequence[str] = (), groups: Sequence[str] = ()) -> DataFrame:
    """Metrics of predictions, by task."""
    pairs = scored.select(*groups, F.col(label).alias("obs"), F.col("prediction").alias("pred"))
    return metrics.regression_metrics(pairs, groups) if task == "regression" else metrics.class_metrics(pairs, levels, groups)


def _value(scored: DataFrame, task: str, label: str, levels: Sequence[str], s: Settings) -> float:
    """The chosen metric of predictions, NaN where it is not defined."""
    if s.report:
        row = s.report(scored.select(F.col(label).alias("obs"), F.col("prediction").alias("pred"))).first().asDict()
    else:
        row = report(scored, task, label, levels).first().asDict()
    if s.metric not in row:
        raise ValueError(f"there is no metric {s.metric}")
    if row[s.metric] is None:
        return float("nan")
    if not isinstance(row[s.metric], (int, float)):
        raise TypeError(f"metric {s.metric} is not a number")
    return float(row[s.metric])


def with_folds(df: DataFrame, k: int, key: str, group: str | None, seed: int | str) -> DataFrame:
    """Adds an inner fold: groups, where there are any, are dealt in turn in the order of their draws (no group is
    parted, and few groups still fill all folds); rows by the draw of the key. The seed may be a column of runs."""
    by, start = ([seed], F.col(seed).cast("string")) if isinstance(seed, str) else ([], seed)
    if not group:
        return df.withColumn(FOLD, (F.conv(F.substring(resample.draw(start, key), 1, 8), 16, 10).cast("long") % k).cast("int"))
    turn = F.row_number().over(Window.partitionBy(*by).orderBy(resample.draw(start, group), group))  # a row for each group
    folds = df.select(*by, group).distinct().withColumn(FOLD, ((turn - 1) % k).cast("int")).withColumnsRenamed({x: f"__f_{x}" for x in (*by, group)})
    return df.join(folds, [F.col(x).eqNullSafe(F.col(f"__f_{x}")) for x in (*by, group)]).drop(*[f"__f_{x}" for x in (*by, group)])


@dataclass(frozen=True)
class Settings:
    """Sizes to try in elimination (none: keep all), inner folds, metric, and the loss in per cent that a smaller size may have.

    ``report`` is a metric function of one's own: it takes rows (obs, pred) and returns one row that has the metric."""

    sizes: Sequence[int] = ()
    folds: int = 3
    metric: str = "mqi"
    larger: bool = True
    tolerance: float = 1.5
    threads: int = 4
    report: Callable[[DataFrame], DataFrame] | None = None


def within_tolerance(profile: Mapping[int, float], tolerance: float, larger: bool) -> int:
    """The smallest size whose value is at most tolerance per cent worse than the best; the largest if none is defined."""
    sizes = sorted(profile)
    return int(moments.smallest_within(np.array([[profile[k] for k in sizes]], float), sizes, tolerance, larger)[0])


def _ranked(fit: Fitted, columns: Sequence[str]) -> list[str]:
    return sorted(columns, key=lambda c: (-fit.importance.get(c, 0.0), c))


def _defined_mean(values: Sequence[float]) -> float:
    """Mean over the folds in which a metric is defined, NaN if there is none."""
    values = [v for v in values if not np.isnan(v)]
    return float(np.mean(values)) if values else float("nan")


def eliminate(df: DataFrame, learner: Learner, columns: Sequence[str], label: str, levels: Sequence[str], s: Settings, few: DataFrame | None = None) -> tuple[list[str], dict[int, float]]:
    """Predictors kept, and the mean metric of each size: in each fold they are ranked by a fit on all of them.

    few are the rows of df as fits take them, if they are gathered."""
    few = df if few is None else few
    sizes = sorted({k for k in s.sizes if 0 < k < len(columns)} | {len(columns)})
    if len(sizes) == 1:
        return list(columns), {}

    def one(fold: int) -> dict[int, float]:
        train, held = few.where(F.col(FOLD) != fold), df.where(F.col(FOLD) == fold)
        whole = learner.fit(train, columns, label, learner.grid[0])
        ranked, out = _ranked(whole, columns), {}
        for size in sizes:
            fit = whole if size == len(columns) else learner.fit(train, ranked[:size], label, learner.grid[0])
            out[size] = _value(fit.score(held), learner.task, label, levels, s)
        return out

    with ThreadPoolExecutor(s.threads) as pool:
        parts = list(pool.map(one, range(s.folds)))
    profile = {k: _defined_mean([p[k] for p in parts]) for k in sizes}
    size = within_tolerance(profile, s.tolerance, s.larger)
    return _ranked(learner.fit(few, columns, label, learner.grid[0]), columns)[:size], profile


def tune(df: DataFrame, learner: Learner, columns: Sequence[str], label: str, levels: Sequence[str], s: Settings, few: DataFrame | None = None) -> tuple[Mapping, float | None]:
    """Parameters of the best mean metric over the folds, the first of equals; with one set there is nothing to do."""
    few = df if few is None else few
    if len(learner.grid) == 1:
        return learner.grid[0], None

    def one(job: tuple[int, int]) -> float:
        i, fold = job
        fit = learner.fit(few.where(F.col(FOLD) != fold), columns, label, learner.grid[i])
        return _value(fit.score(df.where(F.col(FOLD) == fold)), learner.task, label, levels, s)

    with ThreadPoolExecutor(s.threads) as pool:
        values = list(pool.map(one, [(i, k) for i in range(len(learner.grid)) for k in range(s.folds)]))
    means = np.array([_defined_mean(v) for v in np.reshape(values, (len(learner.grid), s.folds))])
    best = int(np.where(np.isnan(means), -np.inf, means if s.larger else -means).argmax())
    return learner.grid[best], None if np.isnan(means[best]) else float(means[best])


@dataclass(frozen=True)
class Trained:
    """What the way from elimination over tuning to the final fit gives."""

    fit: Fitted
    columns: Sequence[str]
    params: Mapping
    profile: Mapping[int, float]
    cv: float | None


def train(df: DataFrame, learner: Learner, columns: Sequence[str], label: str, levels: Sequence[str], s: Settings, few: DataFrame | None = None) -> Trained:
    """Elimination, tuning and a fit on all rows of df, which has inner folds; few are its rows gathered, if they are."""
    kept, profile = eliminate(df, learner, columns, label, levels, s, few)
    params, cv = tune(df, learner, kept, label, levels, s, few)
    return Trained(learner.fit(df if few is None else few, kept, label, params), kept, params, profile, cv)


def _levels(df: DataFrame, learner: Learner, label: str) -> list[str]:
    if learner.task == "regression":
        return []
    return sorted(r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().collect())


def _null_prediction(df: DataFrame, task: str, label: str) -> Column:
    """The model that knows no predictor: the mean, or the commonest class (the first of equals)."""
    if task == "regression":
        return F.lit(df.agg(F.avg(label)).first()[0]).cast("double")
    n = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label).first()
    return F.lit(n[0] if n else None).cast("string")


def _rows_of(spark, run, trained: Trained) -> DataFrame:
    rows = [(str(run), k + 1, c, float(trained.fit.importance.get(c, 0.0))) for k, c in enumerate(_ranked(trained.fit, trained.columns))]
    return spark.createDataFrame(rows, "run string, place int, predictor string, importance double")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def holdouts(df: DataFrame, task: str, label: str, key: str, runs: Sequence[int], p: float, group: str | None) -> DataFrame:
    """Each row once for each run, with run and role, stratified by quantiles of the target or by class.

    Whole groups where groups are given, which must not hold two classes; rows without a group are one group."""
    if not group:
        rows, stratum = (resample.quantile_strata(df, label), "stratum") if task == "regression" else (df, label)
        return resample.stratified_holdouts(rows, stratum, key, p, runs).select(*df.columns, "run", "role")
    if task == "regression":
        units = resample.quantile_strata(df.groupBy(group).agg(F.avg(label).alias("__mean")), "__mean")
    else:
        mixed = [r[0] for r in metrics.group_classes(df, group, label).where("n_classes > 1").select(group).limit(10).collect()]
        if mixed:
            raise ValueError(f"groups of more than one class: {mixed}")
        units = df.groupBy(group).agg(F.min(label).alias("stratum"))
    roles = resample.stratified_holdouts(units, "stratum", group, p, runs).select(F.col(group).alias("__group"), "run", "role")
    return df.join(roles, F.col(group).eqNullSafe(F.col("__group"))).drop("__group")


def _from_moments(learner: Learner, s: Settings) -> bool:
    """Whether all that is to be chosen follows from moments."""
    nothing = not s.sizes and len(learner.grid) == 1
    return learner.moments and (nothing or (s.metric in moments.METRICS and s.report is None))


def _chooser(learner: Learner, columns: Sequence[str], s: Settings, fold_n: np.ndarray, fold_sums: np.ndarray) -> moments.Chooser:
    penalties, order = [x.get("penalty", 0.0) for x in learner.grid], sorted(range(len(columns)), key=lambda i: columns[i])
    return moments.Chooser(len(columns), fold_n, fold_sums, s.sizes, penalties, s.metric, s.larger, s.tolerance, order)


def _fold_table(sums: Sequence, folds: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    n, v = np.zeros(folds), np.zeros((folds, q * (q + 3) // 2))
    for r in sums:
        n[r[FOLD]], v[r[FOLD]] = r["n"], r["sums"]
    return n, v


class RunLedger:
    """Runs that are finished, in a folder that all executors share: the tables of each run, then its marker.

    A marker is one file of one row with the settings, so it is there or not; a run without one is done again."""

    def __init__(self, spark: SparkSession, folder: str, settings: Mapping[str, object]):
        self.spark, self.folder, self.settings = spark, folder.rstrip("/"), {k: str(v) for k, v in settings.items()}

    def _row(self, run: int) -> DataFrame:
        fields = ", ".join(f"{k} string" for k in self.settings)
        return self.spark.createDataFrame([(run, *self.settings.values())], f"run int, {fields}")

    def finished(self, run: int) -> bool:
        """Whether a run has a marker; an error if it was made with other settings, which names the fields."""
        try:
            found = self.spark.read.parquet(f"{self.folder}/finished-{run}")
        except AnalysisException:  # no marker
            return False
        catalog.require_no_conflicts(catalog.conflicts(found, self._row(run), ["run"], list(self.settings)))
        return True

    def finish(self, run: int, tables: Mapping[str, DataFrame]) -> None:
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{self.folder}/{name}-{run}")
        self._row(run).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/finished-{run}")

    def table(self, run: int, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}-{run}")


def repeated(
    df: DataFrame, learner: Learner, columns: Sequence[str], label: str, key: str, runs: int, p: float = 0.75,
    group: str | None = None, settings: Settings = Settings(), ledger: str | None = None,
) -> dict[str, DataFrame]:
    """Repeated holdouts: performance (run, data: train, test, null; metrics), importance (run, place, predictor).

    Rows are split by quantiles of the target or by class, whole groups where groups are given. Least squares take
    the moments of all runs from one pass over the rows. With a ledger (a shared folder) each run is written when it
    is finished, and a job that is started again with the same settings and number of rows goes on behind the last."""
    df = written(df, "rows")  # strata, counts and holdouts read them many times
    levels, spark, numbers = _levels(df, learner, label), df.sparkSession, list(range(1, runs + 1))
    split = holdouts(df, learner.task, label, key, numbers, p, group)
    fast = _from_moments(learner, settings) and ledger is None
    folds = settings.folds if not fast or settings.sizes or len(learner.grid) > 1 else 1
    split = with_folds(split, folds, key, group, "run") if folds > 1 else split.withColumn(FOLD, F.lit(0))
    if not fast:
        split = written(split, "holdouts")
        trains = split.where("role = 'train'")
        few = gathered(trains, learner, columns, label, ["run", FOLD], key)
        learner = learner if few is trains else by_kind(df, few, learner, columns)
    seen = {(r["run"], r["role"]) for r in split.where(F.col(label).isNotNull()).select("run", "role").distinct().collect()}
    if any((k, role) not in seen for k in numbers for role in ("train", "test")):
        raise ValueError("a run has no rows to train or to test; there are too few rows or groups")
    if fast:
        return _repeated_from_moments(split, learner, columns, label, numbers, folds, settings)
    performance, importance, book = [], [], None
    if ledger is not None:
        fields = {"learner": learner.name, "grid": [dict(g) for g in learner.grid], "columns": list(columns), "label": label, "row_key": key, "p": p, "grouped": group}
        fields |= {k: getattr(settings, k) for k in ("sizes", "folds", "metric", "larger", "tolerance")}
        book = RunLedger(spark, ledger, fields | {"n_rows": split.where(F.col("run") == 1).count()})
    for run in numbers:
        if book and book.finished(run):
            performance.append(book.table(run, "performance"))
            importance.append(book.table(run, "importance"))
            continue
        own = split.where(F.col("run") == run).drop("run")
        trained = train(own.where("role = 'train'"), learner, columns, label, levels, settings, few.where(F.col("run") == run))
        scored = trained.fit.score(own).select("role", label, "prediction")
        nothing = own.where("role = 'test'").select(F.lit("null").alias("role"), label, _null_prediction(own.where("role = 'train'"), learner.task, label).alias("prediction"))
        one = report(scored.unionByName(nothing), learner.task, label, levels, ["role"])
        performance.append(one.withColumnRenamed("role", "data").withColumn("run", F.lit(run)))
        importance.append(_rows_of(spark, run, trained))
        if book:
            book.finish(run, {"performance": performance[-1], "importance": importance[-1]})
    return {"performance": _union(performance), "importance": _union(importance)}


def _repeated_from_moments(split: DataFrame, learner: Learner, columns: Sequence[str], label: str, runs: Sequence[int], folds: int, s: Settings) -> dict[str, DataFrame]:
    spark, q = split.sparkSession, len(columns) + 1
    scale = moments.scale_of(split, [*columns, label])
    trains = split.where("role = 'train'")
    sums = moments.part_sums(trains, ["run", FOLD], scale).collect()  # a row for each run and fold
    means = {r["run"]: r["m"] for r in trains.groupBy("run").agg(F.avg(label).alias("m")).collect()}
    models, importance = [], []
    for run in runs:
        n, v = _fold_table([r for r in sums if r["run"] == run], folds, q)
        fit, size, ranked, _ = _chooser(learner, columns, s, n, v).choose(np.zeros(1), np.zeros((1, v.shape[1])), np.array([-1]))
        w, base, weight = moments.raw_units(fit, scale)
        models.append((run, [float(x) for x in w[0]], float(base[0]), None if means.get(run) is None else float(means[run])))
        importance += [(str(run), k + 1, columns[i], float(weight[0, i])) for k, i in enumerate(ranked[0, : size[0]])]
    table = spark.createDataFrame(models, "run int, __w array<double>, __base double, __mean double")
    pairs = _predicted(split.join(table, "run"), columns).select("run", F.col("role").alias("data"), label, "prediction", "__mean")
    null = pairs.where("data = 'test'").withColumns({"data": F.lit("null"), "prediction": F.col("__mean")})
    performance = report(pairs.unionByName(null), "regression", label, (), ["run", "data"])
    return {"performance": performance, "importance": spark.createDataFrame(importance, "run string, place int, predictor string, importance double")}


def _predicted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds the prediction of the weights (__w) and base (__base) of each row; predictors of weight 0 may be null."""
    parts = [F.when(F.col("__w")[i] == 0, F.lit(0.0)).otherwise(F.col("__w")[i] * F.col(c).cast("double")) for i, c in enumerate(columns)]
    return df.withColumn("prediction", sum(parts, F.col("__base")))


def _left_out_from_moments(df: DataFrame, learner: Learner, columns: Sequence[str], label: str, key: str, unit: str | None, s: Settings) -> dict[str, DataFrame]:
    """Units are fitted by the executors, each from all moments less its own; nothing of them comes to the driver."""
    spark, by, names, p = df.sparkSession, unit or key, [*columns, label], len(columns)
    rows = df.where(F.col(by).isNotNull())
    choosing = bool(s.sizes) or len(learner.grid) > 1
    rows = with_folds(rows, s.folds, key, unit, 0) if choosing else rows.withColumn(FOLD, F.lit(0))
    scale = moments.scale_of(rows, names)
    fold_n, fold_sums = _fold_table(moments.part_sums(rows, [FOLD], scale).collect(), s.folds if choosing else 1, p + 1)
    chooser, list_of = _chooser(learner, columns, s, fold_n, fold_sums), "array<double>"

    def models(n: np.ndarray, v: np.ndarray, fold: np.ndarray) -> pd.DataFrame:
        fit, size, ranked, _ = chooser.choose(n, v, fold)
        w, base, importance = moments.raw_units(fit, scale)
        return pd.DataFrame({"__w": list(w), "__base": base, "__ranked": [r[:k].astype(np.int32) for r, k in zip(ranked, size, strict=True)], "__importance": list(importance)})

    fields = f"__w {list_of}, __base double, __ranked array<int>, __importance {list_of}"
    shown = [F.col(by).cast("string").alias("unit"), key, label, "prediction"]
    alone = unit is None and rows.groupBy(key).count().where("count > 1").isEmpty()
    if alone:  # each row is a unit: its moments are its own products, and no row is exchanged
        x = [f"__x{i}" for i in range(p + 1)]
        inputs = rows.select(key, label, *[c for c in columns if c not in (key, label)], FOLD, *[F.col(c).cast("double").alias(n) for c, n in zip(names, x, strict=True)])

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for k in range(0, len(batch), SOLVED):
                    part = batch.iloc[k : k + SOLVED].reset_index(drop=True)
                    z = scale.z(part[x].to_numpy(float))
                    full = ~np.isnan(z).any(1)
                    v = moments.vectors(np.where(full[:, None], z, 0.0))
                    yield pd.concat([part.drop(columns=[FOLD, *x]), models(full.astype(float), v, part[FOLD].to_numpy())], axis=1)

        kept = inputs.drop(FOLD, *x)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", " + fields
        solved = written(_predicted(inputs.mapInPandas(each, schema), columns).select(*shown, "__ranked", "__importance"), "left-out")
        predictions, of_units = solved.select("unit", key, label, "prediction"), solved
    else:
        own = moments.part_sums(rows, [by], scale).withColumnRenamed(by, "__unit")
        units = rows.select(by, FOLD).distinct().join(own, F.col(by) == F.col("__unit"), "left").select(by, FOLD, "n", "sums")
        width = fold_sums.shape[1]

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for k in range(0, len(batch), SOLVED):
                    part = batch.iloc[k : k + SOLVED].reset_index(drop=True)
                    v = np.array([np.zeros(width) if x is None else x for x in part.sums], float).reshape(len(part), width)
                    yield pd.concat([part[[by]], models(part.n.fillna(0).to_numpy(float), v, part[FOLD].to_numpy())], axis=1)

        of_units = units.mapInPandas(each, f"`{by}` {rows.schema[by].dataType.simpleString()}, {fields}")
        of_units = written(of_units.withColumnRenamed(by, "__unit").withColumn("unit", F.col("__unit").cast("string")), "units")
        predictions = _predicted(rows.join(of_units.drop("unit"), F.col(by) == F.col("__unit")), columns).select(*shown)
    if of_units.select("unit").limit(2).count() < 2:
        raise ValueError("at least two units are needed")
    named = F.array(*map(F.lit, columns))
    importance = of_units.select(F.col("unit").alias("run"), "__importance", F.posexplode("__ranked").alias("at", "i"))
    importance = importance.select("run", (F.col("at") + 1).alias("place"), F.get(named, "i").alias("predictor"), F.get("__importance", "i").alias("importance"))
    return {"predictions": predictions, "performance": report(predictions, "regression", label), "importance": importance}


def leave_one_out(
    df: DataFrame, learner: Learner, columns: Sequence[str], label: str, key: str, unit: str | None = None,
    settings: Settings = Settings(),
) -> dict[str, DataFrame]:
    """One unit (each group, or each row where no unit is given) left out at a time, all else nested within.

    Gives predictions (unit, key, label, prediction), performance (one row of pooled metrics) and importance.
    Least squares take any number of units in a fixed number of jobs (if the metric, where one chooses, is among
    ``moments.METRICS``). Other learners fit each unit on its own: the units' names then come to the driver. Inner
    folds are dealt by units."""
    if _from_moments(learner, settings):
        return _left_out_from_moments(df, learner, columns, label, key, unit, settings)
    levels, spark, by = _levels(df, learner, label), df.sparkSession, unit or key
    units = [r[0] for r in df.where(F.col(by).isNotNull()).select(by).distinct().orderBy(by).collect()]
    if len(units) < 2:
        raise ValueError("at least two units are needed")
    rows, learner = written(with_folds(df, settings.folds, key, unit, 0), "leave-out"), _in_turn(learner, settings.threads)
    few = gathered(rows, learner, columns, label, [unit, FOLD], key) if unit else rows
    learner = by_kind(rows, few, learner, columns)

    def one(value) -> tuple[DataFrame, DataFrame]:
        others = F.col(by) != F.lit(value)
        inner, held = rows.where(others), rows.where(F.col(by) == F.lit(value))
        trained = train(inner, learner, columns, label, levels, settings, few.where(others))
        scored = trained.fit.score(held).select(F.col(by).cast("string").alias("unit"), key, label, "prediction")
        return scored, _rows_of(spark, value, trained)

    with ThreadPoolExecutor(settings.threads) as pool:
        parts = list(pool.map(one, units))
    predictions = written(_union([p for p, _ in parts]), "left-out")
    return {"predictions": predictions, "performance": report(predictions, learner.task, label, levels), "importance": _union([i for _, i in parts])}


def single(df: DataFrame, learner: Learner, columns: Sequence[str], label: str, key: str, group: str | None = None, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """Elimination, tuning, fit and report on all rows, without a split."""
    levels, spark = _levels(df, learner, label), df.sparkSession
    rows = written(with_folds(df, settings.folds, key, group, 0), "single")
    few = gathered(rows, learner, columns, label, [FOLD], key)
    trained = train(rows, by_kind(rows, few, learner, columns), columns, label, levels, settings, few)
    return {"performance": report(trained.fit.score(rows), learner.task, label, levels), "importance": _rows_of(spark, "all", trained)}
