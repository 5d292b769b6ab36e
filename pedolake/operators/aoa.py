"""Area of applicability: dissimilarity of new rows to the training rows.

Nearest training rows are found exactly and with pruning (see ``neighbours``); only the mean distance of the
training rows, a mean over all pairs, looks at all of them, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbours import distance_totals, nearest
from .order_stats import quantiles


def training_moments(train: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample deviation of each predictor."""
    rows = train.select(F.posexplode(vector).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s")).orderBy("i").collect()
    return np.array([r["m"] for r in rows]), np.array([r["s"] or 0.0 for r in rows])


def scaled(df: DataFrame, vector: str, mean: np.ndarray, sd: np.ndarray, weight: np.ndarray | None = None) -> DataFrame:
    """Vectors less the mean, over the deviation, times the weights; incomplete vectors become null."""
    w = np.ones(len(mean)) if weight is None else np.asarray(weight, float)
    m, k = (F.array(*[F.lit(float(x)) for x in v]) for v in (mean, np.divide(w, sd, out=np.zeros(len(sd)), where=sd > 0)))
    v = F.col(vector).cast("array<double>")
    z = F.zip_with(F.zip_with(v, m, lambda a, b: a - b), k, lambda a, b: a * b)
    return df.withColumn("z", F.when(~F.exists(v, lambda c: c.isNull() | F.isnan(c)), z))


def mean_distance(train: DataFrame) -> float:
    """Mean over training rows of their mean distance to the others."""
    return float(distance_totals(train).where("n > 0").select(F.avg(F.col("total") / F.col("n"))).first()[0])


def dissimilarity(rows: DataFrame, train: DataFrame, dbar: float) -> DataFrame:
    """Distance to the nearest training row over the mean training distance; null for incomplete rows."""
    out = nearest(rows, train)
    return out.withColumn("di", F.when(F.size("near") > 0, F.col("near")[0]["d"] / dbar))


def train_threshold(train: DataFrame, dbar: float) -> tuple[DataFrame, DataFrame]:
    """Training dissimilarities to other folds, and the largest within the upper whisker."""
    own = nearest(train, train, other_fold=True).withColumn("di", F.when(F.size("near") > 0, F.col("near")[0]["d"] / dbar))
    q = quantiles(own, "di", [0.25, 0.75]).select("q")
    bound = F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0])
    return own, own.join(F.broadcast(q)).where(F.col("di") <= bound).agg(F.max("di").alias("threshold"))


def whitening(train: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and a projection under which Euclidean distance is Mahalanobis distance, from all components of complete rows.

    Each partition sums its p x p moments about the mean with NumPy; the sums are added in one aggregation.
    """
    complete = train.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c))).select(F.col(vector).alias("v"))
    mean, _ = training_moments(complete, "v")

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((len(mean), len(mean))), 0
        for batch in batches:
            if len(batch):
                x = np.stack(batch.v.to_numpy()) - mean
                total, n = total + x.T @ x, n + len(x)
        if n:
            yield pd.DataFrame({"sums": [np.append(total.ravel(), n)]})

    sums = complete.mapInPandas(moments, "sums array<double>").select(F.posexplode("sums").alias("i", "s"))
    sums = np.array([r["s"] for r in sums.groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()])
    cov = sums[:-1].reshape(len(mean), len(mean)) / max(sums[-1] - 1, 1) if len(sums) else np.zeros((len(mean), len(mean)))
    # directions without variance go, at the tolerance of MASS::ginv
    values, vectors = np.linalg.eigh(np.linalg.pinv(cov, rcond=np.sqrt(np.finfo(float).eps), hermitian=True))
    return mean, vectors * np.sqrt(np.maximum(values, 0))


def projected(df: DataFrame, vector: str, mean: np.ndarray, w: np.ndarray) -> DataFrame:
    """Vectors less the mean, times the projection, as z; incomplete vectors become null."""

    @F.pandas_udf("array<double>")
    def project(vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), dtype=object)
        full = [i for i, v in enumerate(vectors) if v is not None and not np.isnan(np.asarray(v, float)).any()]
        if full:
            z = (np.stack([np.asarray(vectors.iloc[i], float) for i in full]) - mean) @ w
            for i, row in zip(full, z, strict=True):
                out.iat[i] = row
        return out

    return df.withColumn("z", project(F.col(vector).cast("array<double>")))


def coded(train: DataFrame, new: DataFrame, numeric: Sequence[str], classes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Adds a vector to both tables: numeric predictors, and a 0/1 for each level that the training rows have.

    A level that they lack is unknown, and codes as zeros at all levels of its predictor."""
    parts = [F.col(c).cast("double") for c in numeric]
    for c in classes:
        levels = [r[0] for r in train.select(c).where(F.col(c).isNotNull()).distinct().orderBy(c).collect()]
        parts += [F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0)) for v in levels]
    return train.withColumn("vector", F.array(*parts)), new.withColumn("vector", F.array(*parts))


def local_density(rows: DataFrame, train: DataFrame, dbar: float, threshold: DataFrame, most: int = 20) -> DataFrame:
    """Adds lpd, how many of the nearest training rows (``most`` at most) lie within the threshold, and its share of most."""
    out = nearest(rows, train, most).join(F.broadcast(threshold))
    lpd = F.size(F.filter("near", lambda n: n["d"] / dbar < F.col("threshold")))
    return out.withColumn("lpd", lpd).withColumn("lpd_share", F.col("lpd") / most)
