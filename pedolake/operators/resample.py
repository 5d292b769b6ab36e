"""Holdouts and folds whose draws are ordered by a hash of the id and a seed, so every run agrees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import written
from .order_stats import quantiles

def draw(seed: int | Column, *ids: str) -> Column:
    """Pseudo-random text by which rows are ordered."""
    s = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("-", *[F.col(i).cast("string") for i in ids], s).cast("binary"))


def quantile_strata(df: DataFrame, target: str, groups: int = 5) -> DataFrame:
    """Adds a stratum: the number of inner quantiles of the target that lie below a value."""
    cuts = quantiles(df, target, [k / groups for k in range(1, groups)]).select(F.col("q").alias("cuts"))
    below = F.size(F.filter("cuts", lambda c: c < F.col(target)))
    return df.join(F.broadcast(cuts)).withColumn("stratum", below.cast("int")).drop("cuts")


def drawn_places(df: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """Adds each row's place in its group by its draw, and the group's rows.

    A group is cut by the first letters of the draws into 4,096 parts that are ordered side by side; a
    part's offset is the rows of the parts before it, so no group is ordered by one task.
    """
    drawn = df.withColumn("__draw", draw(seed, key)).withColumn("__part", F.substring("__draw", 1, 3))
    sizes = drawn.groupBy(F.col(group).alias("__g"), F.col("__part").alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("__g")
    before = F.coalesce(F.sum("__n").over(w.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__g", "__p", before.alias("__before"), F.sum("__n").over(w).alias("n_group"))
    inner = F.row_number().over(Window.partitionBy(group, "__part").orderBy("__draw", key))
    placed = drawn.withColumn("__inner", inner).join(offsets, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p")))
    return placed.withColumn("place", F.col("__inner") + F.col("__before")).drop("__draw", "__part", "__g", "__p", "__before", "__inner")


def stratified_holdout(df: DataFrame, stratum: str, key: str, p: float, seed: int) -> DataFrame:
    """Marks ceil(p * n) rows of each stratum as 'train', the first by their draw."""
    placed = drawn_places(df, stratum, key, seed)
    return placed.withColumn("role", F.when(F.col("place") <= F.ceil(F.col("n_group") * p), "train").otherwise("test")).drop("place", "n_group")


def holdout_cuts(df: DataFrame, stratum: str, key: str, p: float, runs: Sequence[int]) -> DataFrame:
    """The draw and key of the last row that trains, for each run and stratum: (run, __stratum, cut_draw, cut_key).

    ceil(p * n) rows of a stratum of n train, but one less where that would leave none to test (a lone row trains).
    Rows are counted by the first letters of their draws; only the part that holds the cut is ordered.
    """
    drawn = df.select(F.col(stratum).alias("__stratum"), F.col(key).alias("cut_key"), F.explode(F.array(*map(F.lit, runs))).alias("run"))
    drawn = drawn.withColumn("cut_draw", draw(F.col("run").cast("string"), "cut_key")).withColumn("__part", F.substring("cut_draw", 1, 3))
    of_stratum = Window.partitionBy("run", "__stratum")
    n, before = F.sum("__n").over(of_stratum), F.coalesce(F.sum("__n").over(of_stratum.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    takes = F.when((F.col("n") > 1) & (F.ceil(F.col("n") * p) == F.col("n")), F.col("n") - 1).otherwise(F.ceil(F.col("n") * p))
    parts = drawn.groupBy("run", "__stratum", "__part").agg(F.count(F.lit(1)).alias("__n")).select("*", n.alias("n"), before.alias("before"))
    parts = parts.withColumn("rest", takes - F.col("before")).where((F.col("rest") > 0) & (F.col("rest") <= F.col("__n")))
    at = parts.select(F.col("run").alias("__run"), F.col("__stratum").alias("__s"), F.col("__part").alias("__p"), "rest")
    near = drawn.join(at, (F.col("run") == F.col("__run")) & F.col("__stratum").eqNullSafe(F.col("__s")) & (F.col("__part") == F.col("__p")))
    place = F.row_number().over(Window.partitionBy("run", "__stratum").orderBy("cut_draw", "cut_key"))
    return near.withColumn("__place", place).where(F.col("__place") == F.col("rest")).select("run", "__stratum", "cut_draw", "cut_key")


def stratified_holdouts(df: DataFrame, stratum: str, key: str, p: float, runs: Sequence[int]) -> DataFrame:
    """Each row once for each run, with run and role: what is drawn up to the stratum's cut trains.

    No row is exchanged: the cuts (a row for each run and stratum) are joined, and Spark sends them out if they
    are small. Rows of one key stay together."""
    cuts = written(holdout_cuts(df, stratum, key, p, runs), "cuts").withColumnRenamed("run", "__run")
    each = df.withColumn("run", F.explode(F.array(*map(F.lit, runs))))
    own = draw(F.col("run").cast("string"), key)
    joined = each.join(cuts, (F.col("run") == F.col("__run")) & F.col(stratum).eqNullSafe(F.col("__stratum")), "left")
    trains = (own < F.col("cut_draw")) | ((own == F.col("cut_draw")) & (F.col(key) <= F.col("cut_key")))
    return joined.withColumn("role", F.when(trains, "train").otherwise("test")).select(*df.columns, "run", "role")


def grouped_holdout(df: DataFrame, group: str, target: str, p: float, seed: int) -> DataFrame:
    """Whole groups to 'train' or 'test', stratified by the groups' mean target; rows without a group are one."""
    means = df.groupBy(group).agg(F.avg(target).alias("target_mean"))
    roles = stratified_holdout(quantile_strata(means, "target_mean"), "stratum", group, p, seed)
    return df.join(roles.select(F.col(group).alias("__g"), "role"), F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def group_kfold(df: DataFrame, group: str, key: str, k: int, repeats: int, seed: int) -> DataFrame:
    """Rows (resample, key, role) of repeated group folds; k is clipped to the number of groups."""
    groups = df.select(group).where(F.col(group).isNotNull()).distinct()
    n = groups.count()
    if n < 2:
        raise ValueError("at least two groups are needed")
    k = min(k, n)
    reps = groups.withColumn("rep", F.explode(F.array(*[F.lit(i) for i in range(1, repeats + 1)])))
    r = F.row_number().over(Window.partitionBy("rep").orderBy(draw((F.col("rep") + seed).cast("string"), group), group))
    folds = reps.withColumn("fold", ((r - 1) % k + 1).cast("int"))
    return _resamples(df, folds, group, key, k)


def _resamples(df: DataFrame, folds: DataFrame, group: str, key: str, k: int) -> DataFrame:
    rows = df.select(key, group).join(folds.select(group, "rep", "fold"), group)
    each = rows.withColumn("f", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return each.select(
        F.format_string("Fold%02d.Rep%02d", "f", "rep").alias("resample"), key, F.when(F.col("f") == F.col("fold"), "holdout").otherwise("train").alias("role")
    )


def stratified_group_folds(df: DataFrame, group: str, stratum: str, k: int, repeats: int, seed: int) -> DataFrame:
    """Fold of each group and repeat: groups of a class are shuffled and dealt in turn."""
    groups = df.groupBy(group).agg(F.min(stratum).alias("class"))
    reps = groups.withColumn("rep", F.explode(F.array(*[F.lit(i) for i in range(1, repeats + 1)])))
    w = Window.partitionBy("rep", "class").orderBy(draw((F.col("rep") + seed).cast("string"), group), group)
    return reps.withColumn("fold", ((F.row_number().over(w) - 1) % k + 1).cast("int"))


def fold_leakage(folds: DataFrame, group: str) -> DataFrame:
    """Groups that stand in more than one fold of a repeat, counted by repeat."""
    each = folds.groupBy("rep", group).agg(F.count_distinct("fold").alias("n_folds"))
    return each.groupBy("rep").agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("n_folds") > 1).alias("n_leaking"))


def require_stratified(folds: DataFrame, group: str) -> DataFrame:
    """The folds themselves, or an error if a class has fewer than two groups or is missing from the training part of a fold."""
    few = folds.groupBy("rep", "class").agg(F.count_distinct(group).alias("n"), F.count_distinct("fold").alias("k")).where("n < 2 or k < 2")
    bad = [r["class"] for r in few.select("class").distinct().limit(10).collect()]
    if bad:
        raise ValueError(f"classes that a training part would miss: {bad}")
    return folds


def leave_one_out_rows(df: DataFrame, unit: str, key: str) -> DataFrame:
    """The rows that each unit leaves out (unit, key); all others train. One row each, however many units there are."""
    return df.where(F.col(unit).isNotNull()).select(F.col(unit).alias("unit"), F.col(key).alias(key))


def loo_index(df: DataFrame, key: str) -> DataFrame:
    """Sizes of each leave-one-row-out resample."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_holdout"))
    return n.join(F.broadcast(total)).select(key, "n_holdout", (F.col("total") - F.col("n_holdout")).alias("n_train"))


def logo_index(df: DataFrame, group: str, key: str) -> DataFrame:
    """Sizes of each leave-one-group-out resample, from one count by group (rows are read when a unit is fitted)."""
    n = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_holdout"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return n.join(F.broadcast(total)).select(group, "n_holdout", (F.col("total") - F.col("n_holdout")).alias("n_train"))


def leave_out(df: DataFrame, key: str, value) -> DataFrame:
    """All rows with their role in the unit that leaves one value out."""
    return df.withColumn("role", F.when(F.col(key) == F.lit(value), "holdout").otherwise("train"))


def require_usable(validated: DataFrame) -> DataFrame:
    """The usable resamples, or an error if none is left."""
    left = validated.where("usable")
    if left.isEmpty():
        raise ValueError("no resample can be used")
    return left


def validate_resamples(index: DataFrame, n_rows: int, least: int = 2, classes: Sequence[str] = (), rows: DataFrame | None = None) -> DataFrame:
    """Sizes of each resample (resample, row_id, role, class) and whether it may be used.

    Rows without an id, or (where the table of rows is given) with one that it does not hold, are counted
    as unknown, and a resample with any may not be used.
    """
    train, held = F.col("role") == "train", F.col("role") == "holdout"
    unknown = F.col("row_id").isNull()
    if rows is not None:
        index = index.join(rows.select("row_id").distinct().withColumn("__known", F.lit(True)), "row_id", "left")
        unknown = F.col("__known").isNull()
    out = index.groupBy("resample").agg(
        F.count_if(unknown).alias("n_unknown"), F.count_if(train).alias("n_train"), F.count_if(held).alias("n_holdout"), F.count_distinct(F.when(train, F.col("class"))).alias("n_train_classes")
    )
    ok = (F.col("n_unknown") == 0) & (F.col("n_train") >= least) & (F.col("n_holdout") >= least) & (F.col("n_train") + F.col("n_holdout") <= n_rows)
    if classes:
        ok = ok & (F.col("n_train_classes") == len(set(classes)))
    return out.withColumn("usable", ok)
