"""Mahalanobis applicability takes all predictors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pedolake.operators import aoa
from pedolake.plans import registry


def plain(train, new):
    s = np.linalg.pinv(np.cov(train, rowvar=False), rcond=np.sqrt(np.finfo(float).eps))
    far = lambda x, y: np.sqrt(np.maximum(0, np.einsum("abi,ij,abj->ab", x[:, None] - y, s, x[:, None] - y)))
    own = far(train, train)
    dbar = np.mean(own.sum(1) / (len(train) - 1))
    return far(new, train).min(1) / dbar


def test_query_against_all_components(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in rows], float)
    new = np.array([r["vec_id"] % 5 == 0 for r in rows])
    x = (x - x[~new].mean(0)) / x[~new].std(0, ddof=1)
    want = dict(zip([r["vec_id"] for r in rows if r["vec_id"] % 5 == 0], plain(x[~new], x[new]), strict=True))
    got = {r["vec_id"]: r["di"] for r in registry.queries()["aoa_mahalanobis"](spark, sf).collect()}
    gap = max(abs(got[k] - want[k]) for k in want)
    print("rows", len(want), "largest gap", gap, "mean", np.mean(list(got.values())), np.mean(list(want.values())))
    assert got.keys() == want.keys() and gap < 1e-6


def test_rank_and_incomplete_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 12))
    x[:, 11] = x[:, 0] + x[:, 1]
    rows = [(i, i % 3, v.tolist()) for i, v in enumerate(x)]
    rows += [(60, 0, [None] + [0.0] * 11), (61, 0, None), (62, 0, [float("nan")] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, fold int, z array<double>").repartition(3)
    mean, w = aoa.whitening(df, "z")
    z = {r["vec_id"]: r["z"] for r in aoa.projected(df, "z", mean, w).select("vec_id", "z").collect()}
    assert [z[i] for i in (60, 61, 62)] == [None] * 3
    s = np.linalg.pinv(np.cov(x, rowvar=False), rcond=np.sqrt(np.finfo(float).eps))
    for i, j in ((0, 1), (5, 40)):
        assert np.linalg.norm(np.subtract(z[i], z[j])) == pytest.approx(np.sqrt((x[i] - x[j]) @ s @ (x[i] - x[j])))
    out = aoa.dissimilarity(df.where(F.col("vec_id") >= 58).transform(aoa.projected, "z", mean, w), aoa.projected(df, "z", mean, w), 1.0).collect()
    assert {r["vec_id"]: r["di"] is None for r in out} == {58: False, 59: False, 60: True, 61: True, 62: True}
