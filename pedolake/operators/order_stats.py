"""Exact quantiles by distributed selection.

Every wanted rank has a bracket of values that is known to hold it. Round by round a sketch of bounded size
proposes a narrower one, and a counting pass tells how many rows lie below it and within it: where the rank is
within, the bracket is taken, else the part of the old one on the rank's side. When a bracket holds at most
``REST`` rows, or one value alone, those rows are sorted and the rank is read off. The sketch only makes the
rounds few (each shrinks a bracket some hundredfold); results are exact whatever it proposes. No task holds a
column's distinct values, and groups of at most ``REST`` rows need no round at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import written

#: Rows that are sorted together, marks of a sketch, and the sketch's accuracy (one over its error of rank).
REST, MARKS, ACCURACY = 65_536, 256, 4096


def _joined(df: DataFrame, small: DataFrame, groups: Sequence[str]) -> DataFrame:
    """df with the columns of its group's row in small; groups may be null. Spark sends small out only if it is small."""
    if not groups:
        return df.crossJoin(small)  # one row
    on = [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in groups]
    return df.join(small.withColumnsRenamed({g: f"__g_{g}" for g in groups}), on).drop(*[f"__g_{g}" for g in groups])


def _mark(marks: Column, place: Column) -> Column:
    """The mark at a place, which is kept within the sketch."""
    return F.get(marks, F.greatest(F.lit(0), F.least(F.lit(MARKS), place.cast("int"))))


def quantiles(
    df: DataFrame, column: str, probs: Sequence[float], groups: Sequence[str] = (), rest: int = REST, accuracy: int = ACCURACY
) -> DataFrame:
    """Quantiles with linear interpolation (type 7): one row per group (or one in all) with n_rows, n (rows with a value), least,
    most, and the array q.

    Nulls and NaN are left out; q is null where nothing is left. Groups may be null.
    """
    groups = list(groups)
    v = F.col("__v")
    rows = df.select(*groups, F.col(column).cast("double").alias("__v"))
    usable = v.isNotNull() & ~F.isnan(v)
    counts = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(usable).alias("n"), F.min(F.when(usable, v)).alias("least"), F.max(F.when(usable, v)).alias("most"))
    at = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]  # places between rows
    ranks = [r for h in at for r in (F.floor(h), F.ceil(h))]
    most = counts.agg(F.max("n")).first()[0] or 0
    if most <= rest:
        return _small(rows, usable, groups, at)
    names = range(len(ranks))
    start = [c for k in names for c in (ranks[k].alias(f"rank{k}"), F.col("least").alias(f"low{k}"), F.col("most").alias(f"high{k}"), F.lit(0).cast("long").alias(f"below{k}"), F.col("n").alias(f"m{k}"))]
    state, open_, first = written(counts.select("*", *start), "brackets"), list(names), True
    low, high, below, m, rank = ([F.col(f"{x}{k}") for k in names] for x in ("low", "high", "below", "m", "rank"))
    rows, grid = rows.where(usable), [i / MARKS for i in range(MARKS + 1)]
    while open_:
        # at first all ranks share the whole range, and so one sketch
        own = {k: 0 if first else k for k in open_}
        marks = [F.percentile_approx(v if first else F.when(v.between(low[k], high[k]), v), grid, accuracy).alias(f"s{k}") for k in sorted(set(own.values()))]
        sketches = _joined(rows, state, groups).groupBy(*groups).agg(*marks)
        proposed, slack = _joined(state, sketches, groups), 1 + MARKS / accuracy
        for k in open_:
            at_k = (rank[k] - below[k] + 0.5) / m[k] * MARKS
            lo = F.when((at_k < slack) | (m[k] <= rest), low[k]).otherwise(_mark(F.col(f"s{own[k]}"), F.floor(at_k - slack)))
            hi = F.when((at_k > MARKS - slack) | (m[k] <= rest), high[k]).otherwise(_mark(F.col(f"s{own[k]}"), F.ceil(at_k + slack)))
            lo, hi = F.greatest(lo, low[k]), F.least(hi, high[k])
            # where the marks are no narrower than the bracket, one value is tried, and left out if it is not the one
            stuck = (m[k] > rest) & (lo == low[k]) & (hi == high[k])
            mid = _mark(F.col(f"s{own[k]}"), F.floor(at_k))
            proposed = proposed.withColumns({f"lo{k}": F.when(stuck, mid).otherwise(lo), f"hi{k}": F.when(stuck, mid).otherwise(hi)})
        proposed = written(proposed.drop(*[f"s{k}" for k in set(own.values())]), "proposed")
        tallies = [c for k in open_ for c in (F.count_if(v < F.col(f"lo{k}")).alias(f"b{k}"), F.count_if(v.between(F.col(f"lo{k}"), F.col(f"hi{k}"))).alias(f"c{k}"), F.max(F.when(v < F.col(f"lo{k}"), v)).alias(f"d{k}"), F.min(F.when(v > F.col(f"hi{k}"), v)).alias(f"u{k}"))]
        state = _joined(proposed, _joined(rows, proposed, groups).groupBy(*groups).agg(*tallies), groups)
        moved = {}
        for k in open_:
            lo, hi, b, c, d, u = (F.col(f"{x}{k}") for x in ("lo", "hi", "b", "c", "d", "u"))
            under, over = rank[k] < b, rank[k] >= b + c
            moved |= {
                f"low{k}": F.when(under, low[k]).when(over, u).otherwise(lo),
                f"high{k}": F.when(under, d).when(over, high[k]).otherwise(hi),
                f"below{k}": F.when(under, below[k]).when(over, b + c).otherwise(b),
                f"m{k}": F.when(under | over, m[k]).otherwise(c),  # of a part, the whole's count is a bound
            }
        state = written(state.withColumns(moved).drop(*[f"{x}{k}" for x in ("lo", "hi", "b", "c", "d", "u") for k in open_]), "brackets")
        worst = state.agg(*[F.max(F.when(low[k] < high[k], m[k])).alias(str(k)) for k in open_]).first()
        open_, first = [k for k in open_ if (worst[str(k)] or 0) > rest], False
    near = [F.array_sort(F.collect_list(F.when(v.between(low[k], high[k]) & (low[k] < high[k]), v))).alias(f"v{k}") for k in names]
    found = _joined(state, _joined(rows, state, groups).groupBy(*groups).agg(*near), groups) if groups else state.crossJoin(_joined(rows, state, groups).agg(*near))
    values = [F.when(low[k] == high[k], low[k]).otherwise(F.get(f"v{k}", (rank[k] - below[k]).cast("int"))) for k in names]
    out = found.select(*groups, "n_rows", "n", "least", "most", F.array(*[_between(h, values[2 * i], values[2 * i + 1]) for i, h in enumerate(at)]).alias("q"))
    if not groups:
        return out
    empty = counts.where("n = 0").select(*groups, "n_rows", "n", "least", "most", F.lit(None).cast("array<double>").alias("q"))
    return out.unionByName(empty)


def _between(h: Column, lower: Column, higher: Column) -> Column:
    return F.when(lower == higher, lower).otherwise((F.ceil(h) - h) * lower + (h - F.floor(h)) * higher)


def _small(rows: DataFrame, usable: Column, groups: Sequence[str], at: Sequence[Column]) -> DataFrame:
    """Groups of few rows, sorted whole."""
    held = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_rows"), F.array_sort(F.collect_list(F.when(usable, F.col("__v")))).alias("vs")).withColumn("n", F.size("vs").cast("long"))
    q = [_between(h, F.get("vs", F.floor(h).cast("int")), F.get("vs", F.ceil(h).cast("int"))) for h in at]
    some = F.col("n") > 0
    return held.select(*groups, "n_rows", "n", F.get("vs", F.lit(0)).alias("least"), F.when(some, F.get("vs", F.col("n").cast("int") - 1)).alias("most"), F.when(some, F.array(*q)).alias("q"))
