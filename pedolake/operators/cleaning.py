"""Cleaning, validity checks and outlier removal of observation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import finite, rounded
from .order_stats import quantiles


def clean_names(df: DataFrame) -> DataFrame:
    """Columns renamed to snake case; equal names get a number."""
    import re

    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", c)
        name = re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_") or "x"
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def numeric_clean(df: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    """Rounds, turns NaN and infinite values to null, and drops rows with a null in any of the columns."""
    fixed = {c: F.when(finite(F.col(c)), rounded(F.col(c), digits)) for c in columns}
    return df.withColumns(fixed).na.drop(subset=list(columns))


def target_check(df: DataFrame, target: str) -> DataFrame:
    """One row: finite and distinct values of a target, and whether it can be modelled."""
    ok = finite(F.col(target).cast("double"))
    one = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(ok).alias("n_finite"),
        F.count_distinct(F.when(ok, F.col(target))).alias("n_distinct"),
    )
    return one.withColumn("usable", (F.col("n_finite") >= 3) & (F.col("n_distinct") >= 2))


def require_target(df: DataFrame, target: str) -> DataFrame:
    """df itself, or an error if the target cannot be modelled."""
    if not target_check(df, target).first()["usable"]:
        raise ValueError(f"{target} needs three finite and two distinct values")
    return df


def column_diagnostic(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """For each numeric column: missing (NaN included), NaN, infinite and distinct values."""
    sums = []
    for c in columns:
        v = F.col(c).cast("double")
        sums += [
            F.count_if(v.isNull() | F.isnan(v)).alias(f"{c}__na"),
            F.count_if(F.isnan(v)).alias(f"{c}__nan"),
            F.count_if(F.abs(v) == float("inf")).alias(f"{c}__inf"),
            F.count_distinct(F.when(~F.isnan(v), v)).alias(f"{c}__u"),
        ]
    fields = [("n_na", "na"), ("n_nan", "nan"), ("n_inf", "inf"), ("n_unique", "u")]
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{c}__{s}").alias(n) for n, s in fields]) for c in columns])
    return df.agg(*sums).select(F.explode(rows).alias("r")).select("r.*")


def bad_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns with missing, NaN or infinite values."""
    return column_diagnostic(df, columns).where("n_na > 0 or n_nan > 0 or n_inf > 0")


def require_clean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df itself, or an error that names the columns with missing, NaN or infinite values."""
    bad = [r["column_name"] for r in bad_columns(df, columns).collect()]
    if bad:
        raise ValueError(f"missing or not finite: {', '.join(bad)}")
    return df


def _bounds(df: DataFrame, column: str, groups: Sequence[str], multiplier: float) -> DataFrame:
    out = quantiles(df, column, [0.25, 0.75], groups).withColumnRenamed("n_rows", "n_before")
    spread = (F.col("q")[1] - F.col("q")[0]) * multiplier
    return out.select(*groups, "n_before", (F.col("q")[0] - spread).alias("lower_bound"), (F.col("q")[1] + spread).alias("upper_bound"))


def _within(df: DataFrame, column: str, groups: Sequence[str], multiplier: float) -> DataFrame:
    """Keeps what lies in the bounds; groups may be null, so they are joined null-safely."""
    bounds = _bounds(df, column, groups, multiplier).drop("n_before")
    renamed = bounds.toDF(*[f"__{g}" for g in groups], "lower_bound", "upper_bound")
    on = F.lit(True)
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
    joined = df.join(renamed, on) if groups else df.crossJoin(renamed)  # one row
    return joined.where(F.col(column).between(F.col("lower_bound"), F.col("upper_bound"))).select(*df.columns)


def remove_outliers(df: DataFrame, columns: Sequence[str], multiplier: float = 1.5, groups: Sequence[str] = ()) -> DataFrame:
    """Drops rows outside the interquartile bounds; bounds of a later column come from what the earlier ones left."""
    for c in columns:
        df = _within(df, c, groups, multiplier)
    return df


def outlier_report(df: DataFrame, columns: Sequence[str], multiplier: float = 1.5, groups: Sequence[str] = ()) -> DataFrame:
    """Bounds and rows before and after, for each column in turn."""
    out = None
    for k, c in enumerate(columns):
        bounds = _bounds(df, c, groups, multiplier)
        df = _within(df, c, groups, multiplier)
        left = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_after")).toDF(*[f"__{g}" for g in groups], "n_after")
        on = F.lit(True)
        for g in groups:
            on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
        one = (bounds.join(left, on, "left") if groups else bounds.join(F.broadcast(left))).drop(*[f"__{g}" for g in groups])
        one = one.withColumn("n_after", F.coalesce("n_after", F.lit(0))).withColumn("column_name", F.lit(c)).withColumn("step", F.lit(k + 1))
        out = one if out is None else out.unionByName(one)
    return out


def map_factor_back(dummies: DataFrame, factors: DataFrame) -> DataFrame:
    """For each dummy column name the factor with the longest name that it begins with, else itself."""
    joined = dummies.join(F.broadcast(factors), F.col("dummy").startswith(F.col("factor")), "left")
    best = joined.groupBy("dummy").agg(F.max_by("factor", F.length("factor")).alias("factor"))
    return best.select("dummy", F.coalesce("factor", "dummy").alias("source"))


def row_limit(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The first n rows by a total order."""
    return df.orderBy(*keys).limit(n)


def top_k(df: DataFrame, groups: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """The k first rows of each group, without ties."""
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)
