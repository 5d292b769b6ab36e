"""Completeness of attribute tables and of attribute combinations.

Each row is reduced to a bit mask of available attributes. All combinations are then evaluated on the
distinct masks (at most 2 ** attributes, and few in practice) with their counts, so the cost is that
of one pass over the rows and of distinct masks times combinations, never rows times combinations.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import safe_ratio
from . import lattice

Ranges = Mapping[str, tuple[float, float]]
#: Combinations beyond this number are refused.
COMBINATION_LIMIT = 500_000


def available(attr: str, ranges: Ranges | None = None) -> Column:
    """Whether an attribute has a value, and one within its range if it has a range."""
    value = F.col(attr).try_cast("double")
    ok = F.col(attr).isNotNull() & ~F.coalesce(F.isnan(value), F.lit(False))
    if ranges and attr in ranges:
        ok = F.coalesce(value.between(*ranges[attr]), F.lit(False))
    return ok


def availability_mask(attrs: Sequence[str], ranges: Ranges | None = None) -> Column:
    """Bit i tells whether attribute i is available."""
    bits = [F.when(available(a, ranges), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, a in enumerate(attrs)]
    return sum(bits[1:], bits[0])


def attr_completeness(df: DataFrame, attrs: Sequence[str], ranges: Ranges | None = None) -> DataFrame:
    """Counts and shares of present and of valid values for each attribute."""
    sums = [F.count(F.lit(1)).alias("n_rows")]
    for a in attrs:
        sums += [F.count_if(available(a)).alias(f"{a}__n"), F.count_if(available(a, ranges)).alias(f"{a}__v")]
    one = df.agg(*sums)
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("attribute"),
                F.lit(bool(ranges and a in ranges)).alias("has_valid_range"),
                F.col(f"{a}__n").alias("n_non_na"),
                F.col(f"{a}__v").alias("n_valid"),
            )
            for a in attrs
        ]
    )
    out = one.select("n_rows", F.explode(rows).alias("r")).select("r.attribute", "n_rows", "r.has_valid_range", "r.n_non_na", "r.n_valid")
    return out.select(
        "attribute",
        "n_rows",
        "has_valid_range",
        "n_non_na",
        (F.col("n_rows") - F.col("n_non_na")).alias("n_na"),
        safe_ratio(F.col("n_non_na"), F.col("n_rows")).alias("pct_non_na"),
        "n_valid",
        (F.col("n_non_na") - F.col("n_valid")).alias("n_invalid"),
        safe_ratio(F.col("n_valid"), F.col("n_rows")).alias("pct_valid"),
    )


def mask_counts(df: DataFrame, attrs: Sequence[str], extra: Sequence[str] = (), ranges: Ranges | None = None) -> DataFrame:
    """Distinct masks (and extra columns) with their row counts: the one pass over the data."""
    return df.select(availability_mask(attrs, ranges).alias("mask"), *extra).groupBy("mask", *extra).agg(F.count(F.lit(1)).alias("n"))


def row_availability(df: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Histogram of the number of available attributes per row."""
    n = mask_counts(df, attrs).groupBy(F.bit_count("mask").cast("int").alias("n_available")).agg(F.sum("n").alias("n_rows"))
    total = n.agg(F.sum("n_rows").alias("total"))
    return n.join(F.broadcast(total)).select("n_available", "n_rows", safe_ratio(F.col("n_rows"), F.col("total")).alias("pct_rows"))


def attr_combinations(
    spark: SparkSession, attrs: Sequence[str], min_size: int = 2, max_size: int | None = None,
    required: Sequence[str] = (), weights: Mapping[str, float] | None = None,
) -> DataFrame:
    """Combinations with their masks, ordered by size and then by attribute positions.

    They are counted by binomials before any is made, and made size by size, so 60 attributes in threes
    are 34,220 masks; more than ``COMBINATION_LIMIT`` are refused.
    """
    n, top = len(attrs), max_size or len(attrs)
    if not 0 < n <= 63:
        raise ValueError("between 1 and 63 attributes are allowed")
    must = sum(1 << attrs.index(a) for a in required)
    c = F.col("combo_mask")
    has = [c.bitwiseAND(F.lit(1 << i)) != 0 for i in range(n)]
    free = [1 << i for i in range(n) if not must >> i & 1]
    sizes = range(max(0, min_size - len(set(required))), min(len(free), top - len(set(required))) + 1)
    if sum(math.comb(len(free), k) for k in sizes) > COMBINATION_LIMIT:
        raise ValueError(f"more than {COMBINATION_LIMIT} combinations")
    masks = [[must + sum(more)] for k in sizes for more in itertools.combinations(free, k) if must or k]
    combos = spark.createDataFrame(masks, "combo_mask long")
    places = F.array_compact(F.array(*[F.when(h, F.lit(i)) for i, h in enumerate(has)]))
    weigh = [F.when(h, F.lit(float((weights or {}).get(a, 1.0)))).otherwise(F.lit(0.0)) for a, h in zip(attrs, has, strict=True)]
    combos = combos.select(
        "combo_mask",
        F.bit_count(c).cast("int").alias("n_attributes"),
        places.alias("places"),
        F.concat_ws(" | ", *[F.when(h, F.lit(a)) for a, h in zip(attrs, has, strict=True)]).alias("attributes"),
        sum(weigh[1:], weigh[0]).alias("attribute_weight_sum"),
    )
    order = Window.orderBy("n_attributes", "places")
    return combos.withColumn("combo_id", F.row_number().over(order)).drop("places")


def combo_summary(
    spark: SparkSession, df: DataFrame, attrs: Sequence[str], unit: str | None = None, depth: Column | None = None,
    weights: Mapping[str, float] | None = None, min_size: int = 2, required: Sequence[str] = (), ranges: Ranges | None = None,
    max_size: int | None = None, more_units: Sequence[str] = (),
) -> DataFrame:
    """Complete rows, units, depth classes and scores of every combination.

    With further unit columns, the shares of units are averaged over all of them (``mean_pct_units``).
    """
    combos = attr_combinations(spark, attrs, min_size, max_size, required, weights)
    data = df.withColumn("depth_class", depth) if depth is not None else df
    extra = ([unit] if unit else []) + (["depth_class"] if depth is not None else [])
    seen = mask_counts(data, attrs, extra, ranges)
    key = ["combo_id"]
    reached = lambda counts, name: counts.join(combos.select(*key, "combo_mask"), "combo_mask").select(*key, F.col("n").alias(name))
    rows = reached(lattice.superset_sums(seen.select("mask", "n"), combos, len(attrs)), "n_rows_complete")
    total = seen.agg(F.sum("n").alias("total_rows"), *([F.count_distinct(unit).alias("total_units")] if unit else []))
    out = combos.join(F.broadcast(total)).join(rows, key, "left").withColumn("n_rows_complete", F.coalesce("n_rows_complete", F.lit(0)))
    if unit:
        units = lattice.superset_units(seen.where(F.col(unit).isNotNull()), combos, len(attrs), unit)
        out = out.join(reached(units, "n_units_complete"), key, "left")
        out = out.withColumn("n_units_complete", F.coalesce("n_units_complete", F.lit(0)))
        out = out.withColumn("pct_units_complete", safe_ratio(F.col("n_units_complete"), F.col("total_units")))
    if more_units:
        shares = unit_completeness(df, attrs, combos.select("combo_id", "combo_mask", "n_attributes", "attributes"), [*([unit] if unit else []), *more_units], ranges)
        mean = shares.groupBy(key).agg((F.sum("pct_units_complete") / (len(more_units) + bool(unit))).alias("mean_pct_units"))
        out = out.join(mean, key, "left").withColumn("mean_pct_units", F.coalesce("mean_pct_units", F.lit(0.0)))
    if depth is not None:
        depths = lattice.superset_units(seen.where("depth_class is not null"), combos, len(attrs), "depth_class")
        out = out.join(reached(depths, "n_depth_classes_complete"), key, "left")
        out = out.withColumn("n_depth_classes_complete", F.coalesce("n_depth_classes_complete", F.lit(0)))
    n = F.col("n_rows_complete")
    represents = F.log1p(n)
    if unit:
        represents = represents * F.log1p("n_units_complete")
    if depth is not None:
        represents = represents * F.log1p("n_depth_classes_complete")
    return (
        out.withColumn("attribute_weight_mean", F.col("attribute_weight_sum") / F.col("n_attributes"))
        .withColumn("pct_rows_complete", safe_ratio(n, F.col("total_rows")))
        .withColumn("n_rows_missing", F.col("total_rows") - n)
        .withColumn("weighted_score", F.col("attribute_weight_sum") * F.log1p(n))
        .withColumn("representativeness_score", represents)
        .drop("total_rows", "total_units")
    )


def _best_first(metric: str, *before: Column) -> list[Column]:
    return [*before, F.desc(metric), F.desc("n_rows_complete"), F.desc("weighted_score"), F.asc("attributes")]


def top_by_size(summary: DataFrame, n: int = 1, metric: str = "n_rows_complete") -> DataFrame:
    """The n best combinations of each size."""
    rank = F.row_number().over(Window.partitionBy("n_attributes").orderBy(*_best_first(metric)))
    return summary.withColumn("rank_in_size", rank).where(F.col("rank_in_size") <= n)


def selection_candidates(
    summary: DataFrame, priority: str, min_rows: int = 1, min_pct: float = 0.0, metric: str = "n_rows_complete"
) -> DataFrame:
    """Combinations that reach the minima, ranked by one of three priorities."""
    orders = {
        "richness_first": _best_first(metric, F.desc("n_attributes")),
        "metric_first": [F.desc(metric), F.desc("n_attributes"), F.desc("n_rows_complete"), F.desc("weighted_score"), F.asc("attributes")],
        "rows_first": [F.desc("n_rows_complete"), F.desc("n_attributes"), F.desc(metric), F.desc("weighted_score"), F.asc("attributes")],
    }
    fit = summary.where((F.col("n_rows_complete") >= min_rows) & (F.col("pct_rows_complete") >= min_pct))
    return fit.withColumn("selection_rank", F.row_number().over(Window.orderBy(*orders[priority])))


def pareto_combos(summary: DataFrame) -> DataFrame:
    """All best combinations of each size that no larger size reaches in rows."""
    sizes = summary.groupBy("n_attributes").agg(F.max("n_rows_complete").alias("size_max_rows"))
    larger = Window.orderBy(F.desc("n_attributes")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("larger_max", F.max("size_max_rows").over(larger))
    sizes = sizes.where(F.col("larger_max").isNull() | (F.col("size_max_rows") > F.col("larger_max")))
    return summary.join(F.broadcast(sizes.drop("larger_max")), "n_attributes").where("n_rows_complete = size_max_rows").drop("size_max_rows")


def marginal_loss(best: DataFrame) -> DataFrame:
    """Rows lost from each size's best combination to the next."""
    by_size = Window.orderBy("n_attributes")
    prev, n = F.lag("n_rows_complete").over(by_size), F.col("n_rows_complete")
    return best.select(
        "n_attributes",
        "attributes",
        "n_rows_complete",
        F.lag("attributes").over(by_size).alias("previous_attributes"),
        prev.alias("previous_n_rows_complete"),
        (prev - n).alias("marginal_rows_lost"),
        safe_ratio(prev - n, prev).alias("marginal_pct_lost"),
        safe_ratio(n, F.first("n_rows_complete").over(by_size.rowsBetween(Window.unboundedPreceding, 0))).alias("cumulative_pct_remaining"),
    )


def bottlenecks(summary: DataFrame, attrs: Sequence[str], completeness: DataFrame, required: Sequence[str] = ()) -> DataFrame:
    """How much each attribute costs the combinations that hold it."""
    names = F.array(*[F.struct(F.lit(a).alias("attribute"), F.lit(1 << i).cast("long").alias("bit")) for i, a in enumerate(attrs)])
    ids = pareto_combos(summary).select("combo_id", F.lit(True).alias("pareto"))
    best = top_by_size(summary).select("combo_id", F.lit(True).alias("best"))
    marked = summary.join(ids, "combo_id", "left").join(best, "combo_id", "left")
    long = marked.withColumn("a", F.explode(names)).withColumn("has", F.col("combo_mask").bitwiseAND(F.col("a.bit")) != 0)
    n, has = F.col("n_rows_complete"), F.col("has")
    out = long.groupBy(F.col("a.attribute").alias("attribute")).agg(
        F.count_if(has).alias("n_with"),
        safe_ratio(F.count_if(has), F.count(F.lit(1))).alias("pct_with"),
        F.avg(F.when(has, n)).alias("mean_rows_with"),
        F.median(F.when(has, n)).alias("median_rows_with"),
        F.avg(F.when(~has, n)).alias("mean_rows_without"),
        F.count_if(has & F.col("pareto")).alias("n_pareto_with"),
        F.count_if(has & F.col("best")).alias("n_best_with"),
    )
    out = out.join(completeness.select("attribute", "n_rows", "n_non_na", "pct_non_na"), "attribute")
    must = F.col("attribute").isin(list(required)) if required else F.lit(False)
    effect = F.when(~must, F.col("mean_rows_without") - F.col("mean_rows_with"))
    intensity = safe_ratio(effect, F.col("n_rows"))
    kind = (
        F.when(must, "required_attribute_not_evaluated")
        .when(intensity.isNull(), "not_evaluated")
        .when(intensity <= 0, "no_bottleneck_detected")
        .when(intensity <= 0.05, "low_bottleneck")
        .when(intensity <= 0.20, "moderate_bottleneck")
        .otherwise("high_bottleneck")
    )
    return out.withColumn("bottleneck_effect", effect).withColumn("bottleneck_intensity", intensity).withColumn("bottleneck_class", kind)


def missingness_correlation(df: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """Pearson correlation of missing-value indicators of each pair, from one pass; null if either never or always misses."""
    counts = mask_counts(df, attrs)
    miss = [(F.col("mask").bitwiseAND(F.lit(1 << i)) == 0).cast("double") for i in range(len(attrs))]
    n = F.col("n").cast("double")
    sums = [F.sum(n).alias("n")] + [F.sum(n * m).alias(f"s{i}") for i, m in enumerate(miss)]
    pairs = [(i, j) for i in range(len(attrs)) for j in range(i + 1, len(attrs))]
    sums += [F.sum(n * miss[i] * miss[j]).alias(f"p{i}_{j}") for i, j in pairs]
    one = counts.agg(*sums)
    rows = []
    for i, j in pairs:
        a, b, ab, m = F.col(f"s{i}"), F.col(f"s{j}"), F.col(f"p{i}_{j}"), F.col("n")
        spread = F.sqrt((m * a - a * a) * (m * b - b * b))
        rows.append(
            F.struct(
                F.lit(attrs[i]).alias("attribute_1"),
                F.lit(attrs[j]).alias("attribute_2"),
                F.when(spread > 0, (m * ab - a * b) / spread).alias("missingness_correlation"),
            )
        )
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def target_combos(summary: DataFrame, attrs: Sequence[str], targets: Sequence[str], mode: str = "all") -> DataFrame:
    """Combinations with all (or any) target attributes, and how many others they hold."""
    bits = sum(1 << attrs.index(a) for a in targets)
    both = F.col("combo_mask").bitwiseAND(F.lit(bits))
    keep = both == bits if mode == "all" else both != 0
    return summary.where(keep).withColumn("n_additional_attributes", (F.col("n_attributes") - F.bit_count(both)).cast("int"))


def target_top(summary: DataFrame, n: int) -> DataFrame:
    """The n best of target combinations."""
    order = [F.desc("n_rows_complete"), F.desc("weighted_score"), F.desc("n_attributes"), F.asc("attributes")]
    return summary.withColumn("target_rank", F.row_number().over(Window.orderBy(*order))).where(F.col("target_rank") <= n)


def target_plus(summary: DataFrame) -> DataFrame:
    """The best target combination for each number of further attributes."""
    order = Window.partitionBy("n_additional_attributes").orderBy(F.desc("n_rows_complete"), F.desc("weighted_score"), "attributes")
    fit = summary.where("n_additional_attributes >= 1")
    return fit.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def diagnostic_combos(summary: DataFrame, selected: DataFrame) -> DataFrame:
    """Best of each size, Pareto and selected combinations, each once with its first source."""
    best = top_by_size(summary).drop("rank_in_size").withColumn("source", F.lit("best_by_size")).withColumn("o", F.lit(1))
    pareto = pareto_combos(summary).withColumn("source", F.lit("pareto")).withColumn("o", F.lit(2))
    chosen = selected.where("selection_rank = 1").drop("selection_rank").withColumn("source", F.lit("selected")).withColumn("o", F.lit(3))
    every = best.unionByName(pareto).unionByName(chosen)
    first = Window.partitionBy("combo_id").orderBy("o")
    return every.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r", "o")


def depth_completeness(df: DataFrame, attrs: Sequence[str], combos: DataFrame, depth: Column) -> DataFrame:
    """Complete rows of each combination and depth class, and their share of the class."""
    seen = mask_counts(df.withColumn("depth_class", depth).where("depth_class is not null"), attrs, ["depth_class"])
    totals = seen.groupBy("depth_class").agg(F.sum("n").alias("n_rows_depth_total"))
    sums = lattice.superset_sums(seen, combos, len(attrs), ["depth_class"]).withColumnRenamed("n", "n_rows_complete")
    named = combos.select("combo_id", "n_attributes", "attributes", "combo_mask")
    out = sums.join(named, "combo_mask").drop("combo_mask").join(totals, "depth_class")
    out = out.select("combo_id", "n_attributes", "attributes", "depth_class", "n_rows_complete", "n_rows_depth_total")
    return out.withColumn("pct_rows_complete_within_depth", safe_ratio(F.col("n_rows_complete"), F.col("n_rows_depth_total")))


def unit_completeness(df: DataFrame, attrs: Sequence[str], combos: DataFrame, units: Sequence[str], ranges: Ranges | None = None) -> DataFrame:
    """Distinct units with complete rows, for each combination and unit column."""
    masked = df.select(availability_mask(attrs, ranges).alias("mask"), *[F.col(u).cast("string").alias(u) for u in units])
    long = masked.select("mask", F.explode(F.array(*[F.struct(F.lit(u).alias("unit_col"), F.col(u).alias("unit")) for u in units])).alias("u"))
    seen = long.select("mask", "u.*").where("unit is not null").distinct()
    total = seen.groupBy("unit_col").agg(F.count_distinct("unit").alias("n_units_total"))
    counts = lattice.superset_units(seen, combos, len(attrs), "unit", ["unit_col"]).withColumnRenamed("n", "n_units_complete")
    named = combos.select("combo_id", "n_attributes", "attributes", "combo_mask")
    out = counts.join(named, "combo_mask").join(total, "unit_col")
    out = out.select("combo_id", "n_attributes", "attributes", "unit_col", "n_units_complete", "n_units_total")
    return out.withColumn("pct_units_complete", safe_ratio(F.col("n_units_complete"), F.col("n_units_total")))


def selected_data(df: DataFrame, attrs: Sequence[str], chosen: DataFrame) -> DataFrame:
    """Rows that are complete for a chosen combination (one row with combo_mask)."""
    holds = F.col("mask").bitwiseAND(F.col("combo_mask")) == F.col("combo_mask")
    one = df.withColumn("mask", availability_mask(attrs)).crossJoin(chosen.select("combo_mask"))
    return one.where(holds).drop("mask", "combo_mask")


def selected_summary(df: DataFrame, attrs: Sequence[str], chosen: DataFrame, unit: str, depth: Column) -> DataFrame:
    """Rows, units and depth classes before and after a selection."""
    seen = mask_counts(df.withColumn("depth_class", depth), attrs, [unit, "depth_class"])
    one = chosen.select("combo_mask", "attributes", "n_attributes")
    keep = F.col("mask").bitwiseAND(F.col("combo_mask")) == F.col("combo_mask")
    out = seen.join(F.broadcast(one)).groupBy("attributes", "n_attributes").agg(
        F.sum("n").alias("n_rows_original"),
        F.coalesce(F.sum(F.when(keep, F.col("n"))), F.lit(0)).alias("n_rows_selected"),
        F.count_distinct(unit).alias("n_units_original"),
        F.count_distinct(F.when(keep, F.col(unit))).alias("n_units_selected"),
        F.count_distinct("depth_class").alias("n_depth_classes_original"),
        F.count_distinct(F.when(keep, F.col("depth_class"))).alias("n_depth_classes_selected"),
    )
    return (
        out.withColumnRenamed("attributes", "selected_attributes")
        .withColumn("pct_rows_selected", safe_ratio(F.col("n_rows_selected"), F.col("n_rows_original")))
        .withColumn("n_rows_removed", F.col("n_rows_original") - F.col("n_rows_selected"))
        .withColumn("pct_units_selected", safe_ratio(F.col("n_units_selected"), F.col("n_units_original")))
    )


def depth_class_exact(upper: Column, lower: Column, breaks: Sequence[float], tol: float = 1e-8) -> Column:
    """Standard interval whose bounds a layer has, else 'other'; null bounds have no class."""
    out = F.when(upper.isNull() | lower.isNull(), F.lit(None).cast("string"))
    for a, b in zip(breaks, breaks[1:], strict=False):
        out = out.when((F.abs(upper - a) <= tol) & (F.abs(lower - b) <= tol), F.lit(f"{a:g}-{b:g}"))
    return out.otherwise(F.lit("other"))


def depth_class_midpoint(upper: Column, lower: Column, breaks: Sequence[float]) -> Column:
    """Standard interval that holds a layer's midpoint: half open, the last break included."""
    mid, last = (upper + lower) / 2, breaks[-1]
    out = F.when(mid.isNull(), F.lit(None).cast("string")).when(mid < breaks[0], F.lit(f"shallower_than_{breaks[0]:g}"))
    for a, b in zip(breaks, breaks[1:], strict=False):
        out = out.when((mid >= a) & ((mid < b) | ((mid == last) & F.lit(b == last))), F.lit(f"{a:g}-{b:g}"))
    return out.otherwise(F.lit(f"deeper_than_{last:g}"))


def decision_notes(
    summary: DataFrame, completeness: DataFrame, chosen: DataFrame, weights: Mapping[str, float] | None = None, ranges: Ranges | None = None,
    ranges_used: bool = False, required: Sequence[str] = (), priority: str = "richness_first", losses: DataFrame | None = None,
    bottleneck: DataFrame | None = None, targets: DataFrame | None = None,
) -> DataFrame:
    """Ordered sentences on the settings and the results: each comes from one row of a small result."""
    spark = summary.sparkSession
    text = lambda c: F.col(c).cast("string")
    plain = [f"Candidates were ordered by selection_priority = {priority}."]
    if required:
        plain.append(f"All combinations hold the required attributes: {', '.join(required)}.")
    equal = not weights or len(set(weights.values())) == 1
    plain.append("All attributes weigh the same." if equal else "Attribute weights enter the weighted score.")
    if not ranges:
        plain.append("Completeness counts values that are not missing; no valid ranges were given.")
    else:
        plain.append(f"Valid ranges were given and {'count in' if ranges_used else 'do not count in'} the completeness of combinations.")
    size = summary.agg(F.count(F.lit(1)).alias("n")).join(completeness.agg(F.max("n_rows").alias("rows")))
    notes = [size.select(F.concat(text("n"), F.lit(" combinations were evaluated on "), text("rows"), F.lit(" rows.")).alias("note"))]
    notes += [spark.createDataFrame([(p,)], "note string") for p in plain]
    order = [F.struct(F.col("n_rows_complete"), F.col("weighted_score"))]
    best = summary.agg(F.max_by(F.struct("attributes", "n_rows_complete"), order[0]).alias("b"))
    notes.append(best.select(F.concat(F.lit("Most complete rows: "), "b.attributes", F.lit(", with "), F.col("b.n_rows_complete").cast("string"), F.lit(" rows.")).alias("note")))
    worst = completeness.agg(F.min_by("attribute", F.struct("n_non_na", "attribute")).alias("a"), F.min("n_non_na").alias("n"))
    notes.append(worst.select(F.concat(F.lit("The least complete attribute is "), "a", F.lit(" with "), text("n"), F.lit(" values.")).alias("note")))
    if losses is not None:
        step = losses.where("marginal_rows_lost is not null").agg(F.max_by(F.struct("n_attributes", "marginal_rows_lost"), F.struct("marginal_rows_lost", "n_attributes")).alias("s"))
        notes.append(step.where("s is not null").select(F.concat(F.lit("The largest loss, of "), F.col("s.marginal_rows_lost").cast("string"), F.lit(" rows, comes with size "), F.col("s.n_attributes").cast("string"), F.lit(".")).alias("note")))
    if bottleneck is not None:
        hard = bottleneck.where("bottleneck_effect > 0").agg(F.max_by("attribute", F.struct("bottleneck_effect", "attribute")).alias("a"))
        notes.append(hard.where("a is not null").select(F.concat(F.lit("The strongest bottleneck is "), "a", F.lit(".")).alias("note")))
    if targets is not None:
        one = targets.where("target_rank = 1")
        notes.append(one.select(F.concat(F.lit("Best with the targets: "), "attributes", F.lit(", with "), text("n_rows_complete"), F.lit(" rows.")).alias("note")))
    notes.append(chosen.select(F.concat(F.lit("Selected: "), "attributes", F.lit(", with "), text("n_rows_complete"), F.lit(" complete rows.")).alias("note")))
    out = None
    for k, n in enumerate(notes, 1):
        one = n.select(F.lit(k).alias("note_order"), "note")
        out = one if out is None else out.unionByName(one)
    return out
