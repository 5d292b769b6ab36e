"""Depth functions of soil profiles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Profiles that are fitted at once.
ONCE = 1024


def depth_weighted_mean(df: DataFrame, breaks: Sequence[float]) -> DataFrame:
    """Mean of a profile's layers over each standard depth, weighted by overlap."""
    depths = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in zip(breaks, breaks[1:], strict=False)])).alias("d")
    wide = df.where("value is not null").select("profile_id", "upper_limit", "lower_limit", "value", depths)
    overlap = F.least("lower_limit", "d.b") - F.greatest("upper_limit", "d.a")
    hit = wide.withColumn("w", overlap).where("w > 0")
    return hit.groupBy("profile_id", F.col("d.a").alias("upper"), F.col("d.b").alias("lower")).agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))


def spline_means(upper: np.ndarray, lower: np.ndarray, value: np.ndarray, breaks: Sequence[float], lam: float) -> tuple[np.ndarray, float]:
    """Equal-area quadratic smoothing spline (Bishop et al. 1999): means over standard depths, and the fit's RMSE."""
    means, rmse = splines_means(*(np.asarray(x, float)[None] for x in (upper, lower, value)), breaks, lam)
    return means[0], float(rmse[0])


def splines_means(upper: np.ndarray, lower: np.ndarray, value: np.ndarray, breaks: Sequence[float], lam: float) -> tuple[np.ndarray, np.ndarray]:
    """Such splines of profiles with equally many layers, side by side: arrays (profiles, layers)."""
    m, n = value.shape
    depths = list(zip(breaks, breaks[1:], strict=False))
    if n == 1:
        means = [np.where((upper[:, 0] < b) & (lower[:, 0] > a), value[:, 0], np.nan) for a, b in depths]
        return np.stack(means, 1), np.zeros(m)
    thick, gap = lower - upper, upper[:, 1:] - lower[:, :-1]
    r, at = np.zeros((m, n - 1, n - 1)), np.arange(n - 1)
    r[:, at, at] = 2 * (thick[:, :-1] + thick[:, 1:]) + 6 * gap
    r[:, at[:-1], at[1:]] = r[:, at[1:], at[:-1]] = thick[:, 1:-1]
    q = np.diff(np.eye(n), axis=0)
    fitted = np.linalg.solve(np.eye(n) + 6 * n * lam * q.T @ np.linalg.inv(r) @ q, value[:, :, None])
    slope = np.pad(np.linalg.solve(r, 6 * q @ fitted)[:, :, 0], ((0, 0), (1, 1)))  # at upper and lower bounds
    fitted = fitted[:, :, 0]
    b0, b1 = slope[:, :-1], slope[:, 1:]
    gamma = (b1 - b0) / (2 * thick)
    alpha = fitted - b0 * thick / 2 - gamma * thick * thick / 3
    grid = np.arange(breaks[0], breaks[-1]) + 0.5
    curve = np.full((m, len(grid)), np.nan)
    for i in range(n):
        one = lambda x, k=i: x[:, k, None]
        d = grid - one(upper)
        curve = np.where((d >= 0) & (grid < one(lower)), one(alpha) + one(b0) * d + one(gamma) * d * d, curve)
        if i + 1 < n:
            between = (gap[:, i, None] > 0) & (grid >= one(lower)) & (grid < upper[:, i + 1, None])
            curve = np.where(between, alpha[:, i + 1, None] - one(b1) * (upper[:, i + 1, None] - grid), curve)
    parts = [curve[:, (grid > a) & (grid < b)] for a, b in depths]
    there = [np.isfinite(x) for x in parts]
    with np.errstate(all="ignore"):
        means = [np.where(ok.any(1), np.where(np.isnan(x), 0.0, x).sum(1) / (~np.isnan(x)).sum(1), np.nan) for x, ok in zip(parts, there, strict=True)]
    return np.stack(means, 1), np.sqrt(np.mean((fitted - value) ** 2, axis=1))


def depth_spline(df: DataFrame, breaks: Sequence[float], lam: float = 0.1, low: float = 0.0, high: float = 1000.0, rows_per_group: int = 50_000) -> DataFrame:
    """Spline means of each profile over standard depths (clipped to low and high) and its RMSE.

    Profiles are dealt by hash to as many groups as the rows ask for, so one call fits many. A profile without any value in the
    standard depths gets the value of its first layer in the first of them.
    """
    names = [f"d_{a:g}_{b:g}" for a, b in zip(breaks, breaks[1:], strict=False)]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["profile_id", "upper_limit"])
        pid, layers = pdf["profile_id"].to_numpy(), pdf[["upper_limit", "lower_limit", "value"]].to_numpy(float)
        first = np.flatnonzero(np.append(True, pid[1:] != pid[:-1]))
        n = np.diff(np.append(first, len(pid)))
        out = []
        for k in np.unique(n):  # profiles of equally many layers are fitted together, some at once
            alike = first[n == k]
            for own in np.split(alike, range(ONCE, len(alike), ONCE)):
                x = layers[own[:, None] + np.arange(k)]
                means, rmse = splines_means(x[:, :, 0], x[:, :, 1], x[:, :, 2], breaks, lam)
                filled = ~np.isfinite(means).any(1)
                means[filled, 0] = x[filled, 0, 2]
                part = pd.DataFrame(np.clip(means, low, high), columns=names)
                out.append(part.assign(profile_id=pid[own], rmse=rmse, filled=filled)[["profile_id", *names, "rmse", "filled"]])
        return pd.concat(out)

    schema = "profile_id long, " + ", ".join(f"{n} double" for n in names) + ", rmse double, filled boolean"
    part = F.pmod(F.xxhash64("profile_id"), F.lit(max(64, df.count() // rows_per_group)))
    rows = df.where("value is not null").select(F.col("profile_id").cast("long").alias("profile_id"), "upper_limit", "lower_limit", "value", part.alias("part"))
    return rows.groupBy("part").applyInPandas(fit, schema)
