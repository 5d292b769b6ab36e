"""Screening of predictors: near-zero variance and rank correlation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import written


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("c")).select("c.*")


def near_zero_variance(df: DataFrame, columns: Sequence[str], freq_cut: float = 19.0, unique_cut: float = 10.0) -> DataFrame:
    """Ratio of the two commonest values, share of distinct values, and whether to drop the column."""
    values = _long(df, columns)
    counts = values.where("value is not null").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    # each column's two commonest values by partial aggregates: the largest, and the largest of the others
    top = counts.groupBy("column_name").agg(
        F.max(F.struct("n", "value")).alias("first"), F.count(F.lit(1)).alias("n_distinct"), F.sum("n").alias("n_values")
    )
    rest = counts.join(F.broadcast(top.select("column_name", F.col("first.value").alias("v1"))), "column_name").where("value <> v1")
    second = rest.groupBy("column_name").agg(F.max("n").alias("n2"))
    total = values.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_rows"))
    out = total.join(top, "column_name", "left").join(second, "column_name", "left")
    ratio = F.coalesce(F.col("first.n") / F.col("n2"), F.lit(0.0))
    unique = 100 * F.coalesce("n_distinct", F.lit(0)) / F.col("n_rows")
    constant = F.coalesce("n_distinct", F.lit(0)) <= 1
    return out.select(
        "column_name",
        ratio.alias("freq_ratio"),
        unique.alias("percent_unique"),
        (constant | ((ratio > freq_cut) & (unique <= unique_cut))).alias("drop"),
    )


#: Ranges of values of a column that are ranked side by side.
BUCKETS = 64


def average_ranks(counts: DataFrame, value: str, cuts: Sequence[float]) -> DataFrame:
    """Average rank of each value (value, n): values are parted by the cuts and ranked side by side, and a
    part's offset is the rows of those before it. Ties cost one row each."""
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(value))) if cuts else F.lit(0)
    placed = counts.withColumn("__b", part)
    totals = placed.groupBy("__b").agg(F.sum("n").alias("__t"))
    before = F.coalesce(F.sum("__t").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("__b", before.alias("__before"))  # a row per part, BUCKETS at most
    below = F.coalesce(F.sum("n").over(Window.partitionBy("__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("__below", below).join(F.broadcast(offsets), "__b")
    return placed.select(value, (F.col("__before") + F.col("__below") + (F.col("n") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rank correlation of each pair of columns, over rows where both are present.

    Rows are counted by pair of values first, and ranks are joined to those counts, not to rows; the
    correlation is one sum of moments about the mean rank, which ties do not move.
    """
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    probabilities = [k / BUCKETS for k in range(1, BUCKETS)]
    cuts = dict(zip(columns, (sorted(set(q)) for q in doubles.approxQuantile(list(columns), probabilities, 0.01)), strict=True))
    out = None
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            pairs = doubles.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
            pairs = written(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "pairs")
            ranks = [average_ranks(pairs.groupBy(x).agg(F.sum("n").alias("n")), x, cuts[c]).withColumnRenamed("rank", f"r{x}") for x, c in (("a", a), ("b", b))]
            total = pairs.agg(((F.sum("n") + 1) / 2).alias("m"))
            one = pairs.join(ranks[0], "a").join(ranks[1], "b").join(F.broadcast(total))
            x, y, n = F.col("ra") - F.col("m"), F.col("rb") - F.col("m"), F.col("n")
            one = one.agg(F.sum(n * x * y).alias("xy"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy"))
            rho = F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy")))
            one = one.select(F.lit(a).alias("column_1"), F.lit(b).alias("column_2"), rho.alias("rho"))
            out = one if out is None else out.unionByName(one)
    return out


def find_correlated(matrix: np.ndarray, cutoff: float) -> list[int]:
    """Columns to drop, greedily, from a small matrix of absolute correlations."""
    r = np.abs(np.asarray(matrix, float))
    n = len(r)
    off = np.where(np.eye(n, dtype=bool), np.nan, r)
    order = np.argsort(-np.nanmean(off, 1), kind="stable") if n > 1 else np.arange(n)
    live, x = np.ones(n, bool), off[np.ix_(order, order)]
    for i in range(n - 1):
        if not np.nanmax(np.where(np.outer(live, live), x, np.nan), initial=0) > cutoff:
            break
        for j in range(i + 1, n):
            if live[i] and live[j] and x[i, j] > cutoff:
                now = np.where(np.outer(live, live), x, np.nan)
                others = np.delete(now, j, 0)
                if np.nanmean(now[i]) > np.nanmean(others):
                    live[i] = False
                else:
                    live[j] = False
    return sorted(int(order[k]) for k in np.flatnonzero(~live))


def high_correlation_drop(df: DataFrame, columns: Sequence[str], cutoff: float = 0.9) -> DataFrame:
    """Columns to drop for their rank correlation; the matrix has one row per pair of columns."""
    rows = spearman(df, columns).collect()
    at = {c: k for k, c in enumerate(columns)}
    m = np.eye(len(columns))
    for r in rows:
        m[at[r["column_1"]], at[r["column_2"]]] = m[at[r["column_2"]], at[r["column_1"]]] = r["rho"] or 0.0
    gone = set(find_correlated(m, cutoff))
    return df.sparkSession.createDataFrame([(c, k in gone) for k, c in enumerate(columns)], "column_name string, drop boolean")
