"""Tuned training and feature elimination over Spark ML; pipelines and families of classifiers are in their own modules."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics


class MetricEvaluator(Evaluator):
    """Evaluates predictions by a metric function of (obs, pred), once checked on a sample for its name."""

    def __init__(self, metric: str, frame_metrics: Callable[[DataFrame], DataFrame] = metrics.regression_metrics, label: str = "label", larger: bool = True):
        super().__init__()
        self.metric, self.frame_metrics, self.label, self.larger = metric, frame_metrics, label, larger

    def _evaluate(self, dataset: DataFrame) -> float:
        row = self.frame_metrics(dataset.select(F.col(self.label).alias("obs"), F.col("prediction").alias("pred"))).first()
        if self.metric not in row.asDict():
            raise ValueError(f"the metric function does not return {self.metric}")
        if row[self.metric] is not None and not isinstance(row[self.metric], (int, float)):
            raise TypeError(f"{self.metric} is not a number")
        return float("-inf" if self.larger else "inf") if row[self.metric] is None else float(row[self.metric])

    def isLargerBetter(self) -> bool:
        return self.larger


def assembled(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Complete rows with their feature vector and label."""
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip").transform(df.withColumn("label", F.col(label).cast("double"))).where("label is not null")


def forest(trees: int = 10, depth: int = 5, seed: int = 7) -> RandomForestRegressor:
    """Regression forest whose leaves can be read."""
    return RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed, leafCol="leaves")


def class_forest(trees: int = 10, depth: int = 5, seed: int = 7) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)


def tuned(df: DataFrame, folds: str, n_folds: int, depths: Sequence[int], metric: str = "mqi", parallelism: int = 2):
    """Cross-validated choice of the depth of a forest, folds given by a column."""
    est = forest()
    grid = ParamGridBuilder().addGrid(est.maxDepth, list(depths)).build()
    cv = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=MetricEvaluator(metric), numFolds=n_folds, foldCol=folds, parallelism=parallelism)
    return cv.fit(df)


def importance(model, columns: Sequence[str], spark, top: int = 15) -> DataFrame:
    """The most important predictors of a fitted ensemble, ties by name; those without influence are left out."""
    rows = sorted(((c, float(w)) for c, w in zip(columns, model.featureImportances.toArray(), strict=True) if w > 0), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows[:top])], "place int, predictor string, importance double")


def rfe_profile(df: DataFrame, columns: Sequence[str], label: str, sizes: Sequence[int], folds: str, n_folds: int, threads: int = 2) -> DataFrame:
    """Metrics of each size and fold: predictors are ranked by the fit on all of them, which also serves for their full number.

    Fits run side by side; df is read by each of them."""

    def one(fold: int) -> list[tuple]:
        train, held = df.where(F.col(folds) != fold), df.where(F.col(folds) == fold)
        full = forest().fit(assembled(train, columns, label))
        ranked = [c for _, c in sorted(zip(-full.featureImportances.toArray(), columns, strict=True))]
        out = []
        for size in sizes:
            used = ranked[:size]
            model, of = (full, columns) if len(used) == len(columns) else (forest().fit(assembled(train, used, label)), used)
            scored = model.transform(assembled(held, of, label))
            m = metrics.regression_metrics(scored.select(F.col("label").alias("obs"), F.col("prediction").alias("pred"))).first()
            out.append((fold, size, " | ".join(used), m["rmse"], m["r2"], m["mqi"]))
        return out

    with ThreadPoolExecutor(threads) as pool:
        rows = [r for part in pool.map(one, range(n_folds)) for r in part]
    return df.sparkSession.createDataFrame(rows, "fold int, size int, predictors string, rmse double, r2 double, mqi double")


def indexed_label(df: DataFrame, column: str) -> tuple[DataFrame, list[str]]:
    """Label numbers of a class column in alphabetical order."""
    model = StringIndexer(inputCol=column, outputCol="label", stringOrderType="alphabetAsc").fit(df)
    return model.transform(df), list(model.labels)


def neighbour_votes(rows: DataFrame, train: DataFrame, near: DataFrame, label: str) -> DataFrame:
    """Class of each row by votes of its nearest training rows, weighted by inverse distance (near: vec_id, near)."""
    votes = near.select("vec_id", F.explode("near").alias("n")).select("vec_id", F.col("n.id").alias("id"), (1 / (F.col("n.d") + 1e-9)).alias("w"))
    by_class = votes.join(train.select(F.col("vec_id").alias("id"), label), "id").groupBy("vec_id", label).agg(F.sum("w").alias("w"))
    return by_class.groupBy("vec_id").agg(F.max_by(label, F.struct("w", label)).alias("predicted"))


