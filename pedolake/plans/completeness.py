"""Queries of the completeness family, on the soil input."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import rounded
from ..functions.scratch import written
from ..operators import completeness as c
from .fixtures import derived, with_inputs

ATTRS = ["c_gkg", "sand_gkg", "clay_gkg", "p_mgkg", "k_mmolkg"]
WEIGHTS = {"c_gkg": 6.0, "sand_gkg": 5.0, "clay_gkg": 5.0, "k_mmolkg": 3.0, "p_mgkg": 2.0}
RANGES = {"c_gkg": (5.0, 45.0), "sand_gkg": (5000.0, 70000.0), "p_mgkg": (0.01, 0.07)}
BREAKS = [0.0, 5.0, 15.0, 30.0, 60.0, 100.0]


def _depth():
    return c.depth_class_midpoint(F.col("upper_depth_cm"), F.col("lower_depth_cm"), BREAKS)


def _soil(spark, d):
    return derived(spark, d, "soil")


def _summary(spark, d):
    return c.combo_summary(spark, _soil(spark, d), ATTRS, "coord_id", _depth(), WEIGHTS)


def _once(spark, d):
    """The summary, written once for those who use it several times."""
    return written(_summary(spark, d), "summary")


_COMBO = ["combo_id", "n_attributes", "attributes", "n_rows_complete"]


def _shown(df, *more):
    return df.select(*_COMBO, rounded(F.col("weighted_score"), 4).alias("weighted_score"), *more)


def availability_mask(spark, d):
    return _soil(spark, d).select("row_id", "coord_id", "upper_depth_cm", c.availability_mask(ATTRS).alias("mask"))


def _completeness(spark, d, ranges):
    out = c.attr_completeness(_soil(spark, d), ATTRS, ranges)
    return out.withColumn("pct_non_na", rounded(F.col("pct_non_na"))).withColumn("pct_valid", rounded(F.col("pct_valid")))


def attr_completeness(spark, d):
    return _completeness(spark, d, None)


def attr_completeness_ranges(spark, d):
    return _completeness(spark, d, RANGES)


def row_attr_availability(spark, d):
    return c.row_availability(_soil(spark, d), ATTRS).withColumn("pct_rows", rounded(F.col("pct_rows")))


def attr_combinations(spark, d):
    seen = c.attr_completeness(_soil(spark, d), ATTRS).where("n_non_na > 0").select("attribute").collect()
    names = [a for a in ATTRS if a in {r[0] for r in seen}]
    return c.attr_combinations(spark, names, 2, None, (), WEIGHTS).select("combo_id", "combo_mask", "n_attributes", "attributes", "attribute_weight_sum")


def combo_summary(spark, d):
    s = _summary(spark, d)
    return _shown(
        s,
        "attribute_weight_sum",
        rounded(F.col("attribute_weight_mean")).alias("attribute_weight_mean"),
        rounded(F.col("pct_rows_complete")).alias("pct_rows_complete"),
        "n_rows_missing",
        rounded(F.col("representativeness_score"), 4).alias("representativeness_score"),
    )


def combo_units(spark, d):
    return _summary(spark, d).select("combo_id", "attributes", "n_units_complete", rounded(F.col("pct_units_complete")).alias("pct_units_complete"))


def combo_depth(spark, d):
    return _summary(spark, d).select("combo_id", "attributes", "n_depth_classes_complete")


def best_combo_by_size(spark, d):
    return _shown(c.top_by_size(_summary(spark, d)))


def top_combo_by_size(spark, d):
    return _shown(c.top_by_size(_summary(spark, d), 3), "rank_in_size")


def selection_richness(spark, d):
    return _shown(c.selection_candidates(_summary(spark, d), "richness_first", 100, 0.05), "selection_rank")


def selection_metric(spark, d):
    return _shown(c.selection_candidates(_summary(spark, d), "metric_first", 100, 0.05), "selection_rank")


def selection_rows(spark, d):
    return _shown(c.selection_candidates(_summary(spark, d), "rows_first", 100, 0.05), "selection_rank")


def pareto_combo(spark, d):
    return _shown(c.pareto_combos(_once(spark, d)))


def marginal_loss(spark, d):
    out = c.marginal_loss(c.top_by_size(_summary(spark, d)))
    for name in ("marginal_pct_lost", "cumulative_pct_remaining"):
        out = out.withColumn(name, rounded(F.col(name)))
    return out


def bottleneck_summary(spark, d):
    out = c.bottlenecks(_once(spark, d), ATTRS, c.attr_completeness(_soil(spark, d), ATTRS), ["c_gkg"])
    for name in ("pct_with", "pct_non_na", "mean_rows_with", "median_rows_with", "mean_rows_without", "bottleneck_effect", "bottleneck_intensity"):
        out = out.withColumn(name, rounded(F.col(name), 4))
    return out


def missingness_correlation(spark, d):
    out = c.missingness_correlation(_soil(spark, d), ATTRS)
    return out.withColumn("missingness_correlation", rounded(F.col("missingness_correlation")))


def target_top(spark, d):
    return _shown(c.target_top(c.target_combos(_summary(spark, d), ATTRS, ["c_gkg", "clay_gkg"]), 5), "n_additional_attributes", "target_rank")


def target_plus_by_size(spark, d):
    return _shown(c.target_plus(c.target_combos(_summary(spark, d), ATTRS, ["c_gkg", "clay_gkg"])), "n_additional_attributes")


def target_any(spark, d):
    return _shown(c.target_combos(_summary(spark, d), ATTRS, ["c_gkg", "clay_gkg"], "any"), "n_additional_attributes")


def _selected(spark, d, priority="richness_first", summary=None):
    return c.selection_candidates(summary or _summary(spark, d), priority, 100, 0.05)


def diagnostic_combos(spark, d):
    s = _once(spark, d)
    return _shown(c.diagnostic_combos(s, _selected(spark, d, summary=s)), "source")


def _diagnostic(spark, d):
    s = _once(spark, d)
    return c.diagnostic_combos(s, _selected(spark, d, summary=s)).select("combo_id", "combo_mask", "n_attributes", "attributes")


def depth_completeness(spark, d):
    out = c.depth_completeness(_soil(spark, d), ATTRS, _diagnostic(spark, d), _depth())
    return out.withColumn("pct_rows_complete_within_depth", rounded(F.col("pct_rows_complete_within_depth")))


def unit_completeness(spark, d):
    out = c.unit_completeness(_soil(spark, d), ATTRS, _diagnostic(spark, d), ["coord_id", "profile_id"])
    return out.withColumn("pct_units_complete", rounded(F.col("pct_units_complete")))


def selected_data(spark, d):
    chosen = _selected(spark, d).where("selection_rank = 1")
    return c.selected_data(_soil(spark, d), ATTRS, chosen).select("row_id", "coord_id", *ATTRS)


def _one_summary(spark, d, priority, summary=None):
    chosen = _selected(spark, d, priority, summary).where("selection_rank = 1")
    out = c.selected_summary(_soil(spark, d), ATTRS, chosen, "coord_id", _depth())
    return out.withColumn("pct_rows_selected", rounded(F.col("pct_rows_selected"))).withColumn("pct_units_selected", rounded(F.col("pct_units_selected")))


def selected_summary(spark, d):
    return _one_summary(spark, d, "richness_first")


def priority_comparison(spark, d):
    out, s = None, _once(spark, d)
    for p in ("richness_first", "metric_first", "rows_first"):
        one = _one_summary(spark, d, p, s).withColumn("strategy", F.lit(p))
        out = one if out is None else out.unionByName(one)
    return out


def input_summary(spark, d):
    s = _summary(spark, d).agg(F.count(F.lit(1)).alias("n_combinations"), F.min("n_attributes").alias("min_size"), F.max("n_attributes").alias("max_size"))
    n = _soil(spark, d).agg(F.count(F.lit(1)).alias("n_rows"))
    return n.join(F.broadcast(s)).select(
        "n_rows",
        F.lit(len(ATTRS)).alias("n_attributes_evaluated"),
        "n_combinations",
        "min_size",
        "max_size",
        F.lit("n_rows_complete").alias("ranking_metric"),
        F.lit("richness_first").alias("selection_priority"),
        F.lit("midpoint").alias("depth_method"),
    )


def decision_notes(spark, d):
    s = _once(spark, d)
    values = c.attr_completeness(_soil(spark, d), ATTRS)
    targets = c.target_top(c.target_combos(s, ATTRS, ["c_gkg", "clay_gkg"]), 5)
    chosen = _selected(spark, d, summary=s).where("selection_rank = 1")
    losses, hard = c.marginal_loss(c.top_by_size(s)), c.bottlenecks(s, ATTRS, values, ["c_gkg"])
    return c.decision_notes(s, values, chosen, WEIGHTS, RANGES, losses=losses, bottleneck=hard, targets=targets)


def combo_several_units(spark, d):
    """Combinations of three attributes at most, with shares of units averaged over two unit columns."""
    s = c.combo_summary(spark, _soil(spark, d), ATTRS, "coord_id", max_size=3, more_units=["profile_id"])
    return s.select("combo_id", "attributes", "n_rows_complete", rounded(F.col("mean_pct_units")).alias("mean_pct_units"))


def depth_class_exact(spark, d):
    upper, lower = F.col("upper_depth_cm"), F.col("lower_depth_cm")
    kind = c.depth_class_exact(upper, lower, [0.0, 5.0, 15.0, 30.0, 45.0, 60.0, 75.0])
    return _soil(spark, d).groupBy(kind.alias("depth_class")).agg(F.count(F.lit(1)).alias("n"))


def depth_class_midpoint(spark, d):
    return _soil(spark, d).groupBy(_depth().alias("depth_class")).agg(F.count(F.lit(1)).alias("n"))


# The oracles evaluate every combination on every row, without masks of distinct rows.
_BIT = " + ".join(f"CASE WHEN {a} IS NOT NULL THEN {1 << i} ELSE 0 END" for i, a in enumerate(ATTRS))
_MID = "(upper_depth_cm + lower_depth_cm) / 2"
_CLASS = "CASE WHEN {m} < 0 THEN 'shallower_than_0' ".format(m=_MID) + " ".join(
    f"WHEN {_MID} >= {a:g} AND ({_MID} < {b:g}{f' OR {_MID} = {b:g}' if b == BREAKS[-1] else ''}) THEN '{a:g}-{b:g}'"
    for a, b in zip(BREAKS, BREAKS[1:], strict=False)
) + f" ELSE 'deeper_than_{BREAKS[-1]:g}' END"
_NAMES = "concat_ws(' | ', " + ", ".join(f"CASE WHEN combo_mask & {1 << i} <> 0 THEN '{a}' END" for i, a in enumerate(ATTRS)) + ")"
_PLACES = "list_filter([" + ", ".join(f"CASE WHEN combo_mask & {1 << i} <> 0 THEN {i} END" for i in range(len(ATTRS))) + "], lambda x: x IS NOT NULL)"
_WSUM = " + ".join(f"CASE WHEN combo_mask & {1 << i} <> 0 THEN {WEIGHTS[a]:g} ELSE 0 END" for i, a in enumerate(ATTRS))
_SUMMARY = f"""WITH m AS (SELECT *, {_BIT} AS mask, {_CLASS} AS depth_class FROM soil),
t AS (SELECT count(*) AS total_rows, count(DISTINCT coord_id) AS total_units FROM soil),
k AS (SELECT combo_mask, CAST(bit_count(combo_mask) AS INTEGER) AS n_attributes, {_NAMES} AS attributes, {_PLACES} AS places,
      CAST({_WSUM} AS DOUBLE) AS attribute_weight_sum
      FROM (SELECT CAST(unnest(range(1, {1 << len(ATTRS)})) AS BIGINT) AS combo_mask) WHERE bit_count(combo_mask) >= 2),
k2 AS (SELECT * EXCLUDE (places), CAST(row_number() OVER (ORDER BY n_attributes, places) AS INTEGER) AS combo_id FROM k),
e AS (SELECT k2.combo_id, k2.combo_mask, k2.n_attributes, k2.attributes, k2.attribute_weight_sum, count(m.mask) AS n_rows_complete,
      count(DISTINCT m.coord_id) AS n_units_complete, count(DISTINCT m.depth_class) AS n_depth_classes_complete
      FROM k2 LEFT JOIN m ON (m.mask & k2.combo_mask) = k2.combo_mask GROUP BY ALL),
s AS (SELECT e.*, e.attribute_weight_sum / e.n_attributes AS attribute_weight_mean,
      e.n_rows_complete / t.total_rows AS pct_rows_complete, t.total_rows - e.n_rows_complete AS n_rows_missing,
      e.n_units_complete / t.total_units AS pct_units_complete, e.attribute_weight_sum * ln(1 + e.n_rows_complete) AS weighted_score,
      ln(1 + e.n_rows_complete) * ln(1 + e.n_units_complete) * ln(1 + e.n_depth_classes_complete) AS representativeness_score
      FROM e, t)"""
_B = "n_rows_complete DESC, weighted_score DESC, attributes"
_BEST = f", best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY n_attributes ORDER BY {_B}) = 1)"
_PARETO = """, sizes AS (SELECT n_attributes, max(n_rows_complete) AS mx FROM s GROUP BY 1),
pareto AS (SELECT s.* FROM s JOIN sizes USING (n_attributes) WHERE s.n_rows_complete = sizes.mx
           AND sizes.mx > coalesce((SELECT max(z.mx) FROM sizes z WHERE z.n_attributes > sizes.n_attributes), -1))"""
_ORDERS = {
    "richness_first": f"n_attributes DESC, {_B}",
    "metric_first": f"n_rows_complete DESC, n_attributes DESC, {_B}",
    "rows_first": f"n_rows_complete DESC, n_attributes DESC, {_B}",
}
_SHOW = "combo_id, n_attributes, attributes, n_rows_complete, round(weighted_score, 4) AS weighted_score"


def _cand(priority, name="cand"):
    return f""", {name} AS (SELECT *, CAST(row_number() OVER (ORDER BY {_ORDERS[priority]}) AS INTEGER) AS selection_rank FROM s
    WHERE n_rows_complete >= 100 AND pct_rows_complete >= 0.05)"""


def _q(tail, body=""):
    return with_inputs("soil", _SUMMARY + tail + " " + body)


_TARGET = """, tg AS (SELECT *, CAST(n_attributes - bit_count(combo_mask & 5) AS INTEGER) AS n_additional_attributes FROM s WHERE (combo_mask & 5) {op})"""
_DIAG = (
    _BEST
    + _PARETO
    + _cand("richness_first")
    + """, diag AS (SELECT * FROM (
  SELECT combo_id, combo_mask, n_attributes, attributes, n_rows_complete, weighted_score, 'best_by_size' AS source, 1 AS o FROM best
  UNION ALL SELECT combo_id, combo_mask, n_attributes, attributes, n_rows_complete, weighted_score, 'pareto', 2 FROM pareto
  UNION ALL SELECT combo_id, combo_mask, n_attributes, attributes, n_rows_complete, weighted_score, 'selected', 3 FROM cand WHERE selection_rank = 1)
  QUALIFY row_number() OVER (PARTITION BY combo_id ORDER BY o) = 1)"""
)


def _completeness_sql(ranges):
    rows = []
    for a in ATTRS:
        v = f"count(CASE WHEN {a} BETWEEN {ranges[a][0]} AND {ranges[a][1]} THEN 1 END)" if a in ranges else f"count({a})"
        rows.append(
            f"SELECT '{a}' AS attribute, count(*) AS n_rows, {'TRUE' if a in ranges else 'FALSE'} AS has_valid_range, count({a}) AS n_non_na, "
            f"count(*) - count({a}) AS n_na, round(count({a}) / count(*), 6) AS pct_non_na, {v} AS n_valid, count({a}) - {v} AS n_invalid, "
            f"round({v} / count(*), 6) AS pct_valid FROM soil"
        )
    return with_inputs("soil", " UNION ALL ".join(rows))


def _selected_sql(priority):
    return f"""SELECT c.attributes AS selected_attributes, c.n_attributes, count(*) AS n_rows_original,
 count(CASE WHEN (m.mask & c.combo_mask) = c.combo_mask THEN 1 END) AS n_rows_selected,
 count(DISTINCT m.coord_id) AS n_units_original, count(DISTINCT CASE WHEN (m.mask & c.combo_mask) = c.combo_mask THEN m.coord_id END) AS n_units_selected,
 count(DISTINCT m.depth_class) AS n_depth_classes_original,
 count(DISTINCT CASE WHEN (m.mask & c.combo_mask) = c.combo_mask THEN m.depth_class END) AS n_depth_classes_selected,
 round(count(CASE WHEN (m.mask & c.combo_mask) = c.combo_mask THEN 1 END) / count(*), 6) AS pct_rows_selected,
 count(*) - count(CASE WHEN (m.mask & c.combo_mask) = c.combo_mask THEN 1 END) AS n_rows_removed,
 round(count(DISTINCT CASE WHEN (m.mask & c.combo_mask) = c.combo_mask THEN m.coord_id END) / count(DISTINCT m.coord_id), 6) AS pct_units_selected
 {{label}} FROM m, {priority} c WHERE c.selection_rank = 1 GROUP BY 1, 2"""


_HAS = " UNION ALL ".join(f"SELECT '{a}' AS attribute, {1 << i} AS bit, count({a}) AS n_non_na, count(*) AS n_rows FROM soil" for i, a in enumerate(ATTRS))
_CORR = " UNION ALL ".join(
    f"SELECT '{a}' AS attribute_1, '{b}' AS attribute_2, round(CASE WHEN count({a}) IN (0, count(*)) OR count({b}) IN (0, count(*)) THEN NULL "
    f"ELSE corr(CAST({a} IS NULL AS INT), CAST({b} IS NULL AS INT)) END, 6) AS missingness_correlation FROM soil"
    for i, a in enumerate(ATTRS)
    for b in ATTRS[i + 1 :]
)

ORACLES = {
    "availability_mask": with_inputs("soil", f"SELECT row_id, coord_id, upper_depth_cm, CAST({_BIT} AS BIGINT) AS mask FROM soil"),
    "attr_completeness": _completeness_sql({}),
    "attr_completeness_ranges": _completeness_sql(RANGES),
    "row_attr_availability": with_inputs("soil", f"SELECT CAST(bit_count({_BIT}) AS INTEGER) AS n_available, count(*) AS n_rows, round(count(*) / (SELECT count(*) FROM soil), 6) AS pct_rows FROM soil GROUP BY 1"),
    "attr_combinations": _q("", "SELECT combo_id, combo_mask, n_attributes, attributes, attribute_weight_sum FROM s"),
    "combo_summary": _q("", f"SELECT {_SHOW}, attribute_weight_sum, round(attribute_weight_mean, 6) AS attribute_weight_mean, round(pct_rows_complete, 6) AS pct_rows_complete, n_rows_missing, round(representativeness_score, 4) AS representativeness_score FROM s"),
    "combo_units": _q("", "SELECT combo_id, attributes, n_units_complete, round(pct_units_complete, 6) AS pct_units_complete FROM s"),
    "combo_depth": _q("", "SELECT combo_id, attributes, n_depth_classes_complete FROM s"),
    "best_combo_by_size": _q(_BEST, f"SELECT {_SHOW} FROM best"),
    "top_combo_by_size": _q("", f"SELECT {_SHOW}, CAST(row_number() OVER (PARTITION BY n_attributes ORDER BY {_B}) AS INTEGER) AS rank_in_size FROM s QUALIFY rank_in_size <= 3"),
    "selection_richness": _q(_cand("richness_first"), f"SELECT {_SHOW}, selection_rank FROM cand"),
    "selection_metric": _q(_cand("metric_first"), f"SELECT {_SHOW}, selection_rank FROM cand"),
    "selection_rows": _q(_cand("rows_first"), f"SELECT {_SHOW}, selection_rank FROM cand"),
    "pareto_combo": _q(_PARETO, f"SELECT {_SHOW} FROM pareto"),
    "marginal_loss": _q(_BEST + """, l AS (SELECT *, lag(attributes) OVER w AS previous_attributes, lag(n_rows_complete) OVER w AS previous_n_rows_complete,
      first_value(n_rows_complete) OVER w AS f FROM best WINDOW w AS (ORDER BY n_attributes))
      SELECT n_attributes, attributes, n_rows_complete, previous_attributes, previous_n_rows_complete,
      previous_n_rows_complete - n_rows_complete AS marginal_rows_lost,
      round((previous_n_rows_complete - n_rows_complete) / nullif(previous_n_rows_complete, 0), 6) AS marginal_pct_lost,
      round(n_rows_complete / nullif(f, 0), 6) AS cumulative_pct_remaining FROM l"""),
    "bottleneck_summary": _q(_BEST + _PARETO + f""", a AS ({_HAS}),
      g AS (SELECT a.attribute, a.n_rows, a.n_non_na, count(CASE WHEN s.combo_mask & a.bit <> 0 THEN 1 END) AS n_with, count(*) AS n_all,
        avg(CASE WHEN s.combo_mask & a.bit <> 0 THEN n_rows_complete END) AS mw, median(CASE WHEN s.combo_mask & a.bit <> 0 THEN n_rows_complete END) AS md,
        avg(CASE WHEN s.combo_mask & a.bit = 0 THEN n_rows_complete END) AS mo,
        count(CASE WHEN s.combo_mask & a.bit <> 0 AND s.combo_id IN (SELECT combo_id FROM pareto) THEN 1 END) AS np,
        count(CASE WHEN s.combo_mask & a.bit <> 0 AND s.combo_id IN (SELECT combo_id FROM best) THEN 1 END) AS nb FROM a, s GROUP BY ALL),
      h AS (SELECT *, CASE WHEN attribute <> 'c_gkg' THEN mo - mw END AS eff FROM g)
      SELECT attribute, n_with, round(n_with / n_all, 4) AS pct_with, round(mw, 4) AS mean_rows_with, round(md, 4) AS median_rows_with,
        round(mo, 4) AS mean_rows_without, np AS n_pareto_with, nb AS n_best_with, n_rows, n_non_na, round(n_non_na / n_rows, 4) AS pct_non_na,
        round(eff, 4) AS bottleneck_effect, round(eff / n_rows, 4) AS bottleneck_intensity,
        CASE WHEN attribute = 'c_gkg' THEN 'required_attribute_not_evaluated' WHEN eff IS NULL THEN 'not_evaluated' WHEN eff <= 0 THEN 'no_bottleneck_detected'
        WHEN eff / n_rows <= 0.05 THEN 'low_bottleneck' WHEN eff / n_rows <= 0.2 THEN 'moderate_bottleneck' ELSE 'high_bottleneck' END AS bottleneck_class FROM h"""),
    "missingness_correlation": with_inputs("soil", _CORR),
    "target_top": _q(_TARGET.format(op="= 5"), f"SELECT {_SHOW}, n_additional_attributes, CAST(row_number() OVER (ORDER BY n_rows_complete DESC, weighted_score DESC, n_attributes DESC, attributes) AS INTEGER) AS target_rank FROM tg QUALIFY target_rank <= 5"),
    "target_plus_by_size": _q(_TARGET.format(op="= 5"), f"SELECT {_SHOW}, n_additional_attributes FROM tg WHERE n_additional_attributes >= 1 QUALIFY row_number() OVER (PARTITION BY n_additional_attributes ORDER BY {_B}) = 1"),
    "target_any": _q(_TARGET.format(op="<> 0"), f"SELECT {_SHOW}, n_additional_attributes FROM tg"),
    "diagnostic_combos": _q(_DIAG, f"SELECT {_SHOW}, source FROM diag"),
    "depth_completeness": _q(_DIAG + """, dt AS (SELECT depth_class, count(*) AS n_rows_depth_total FROM m GROUP BY 1)
      SELECT c.combo_id, c.n_attributes, c.attributes, m.depth_class, count(*) AS n_rows_complete, dt.n_rows_depth_total,
      round(count(*) / dt.n_rows_depth_total, 6) AS pct_rows_complete_within_depth
      FROM diag c JOIN m ON (m.mask & c.combo_mask) = c.combo_mask JOIN dt USING (depth_class) GROUP BY c.combo_id, c.n_attributes, c.attributes, m.depth_class, dt.n_rows_depth_total"""),
    "unit_completeness": _q(_DIAG, " UNION ALL ".join(f"""SELECT c.combo_id, c.n_attributes, c.attributes, '{u}' AS unit_col, count(DISTINCT m.{u}) AS n_units_complete,
      (SELECT count(DISTINCT {u}) FROM soil) AS n_units_total, round(count(DISTINCT m.{u}) / (SELECT count(DISTINCT {u}) FROM soil), 6) AS pct_units_complete
      FROM diag c JOIN m ON (m.mask & c.combo_mask) = c.combo_mask GROUP BY 1, 2, 3""" for u in ("coord_id", "profile_id"))),
    "selected_data": _q(_cand("richness_first"), f"SELECT m.row_id, m.coord_id, {', '.join('m.' + a for a in ATTRS)} FROM m JOIN cand c ON (m.mask & c.combo_mask) = c.combo_mask WHERE c.selection_rank = 1"),
    "selected_summary": _q(_cand("richness_first"), _selected_sql("cand").format(label="")),
    "priority_comparison": _q("".join(_cand(p, "c_" + p) for p in _ORDERS), " UNION ALL ".join(_selected_sql("c_" + p).format(label=f", '{p}' AS strategy") for p in _ORDERS)),
    "input_summary": _q("", """SELECT (SELECT count(*) FROM soil) AS n_rows, 5 AS n_attributes_evaluated, count(*) AS n_combinations, min(n_attributes) AS min_size,
      max(n_attributes) AS max_size, 'n_rows_complete' AS ranking_metric, 'richness_first' AS selection_priority, 'midpoint' AS depth_method FROM s"""),
    "combo_several_units": _q("", """, u AS (SELECT count(DISTINCT coord_id) AS a, count(DISTINCT profile_id) AS b FROM soil)
      SELECT s.combo_id, s.attributes, any_value(s.n_rows_complete) AS n_rows_complete, round((count(DISTINCT m.coord_id) / any_value(u.a) + count(DISTINCT m.profile_id) / any_value(u.b)) / 2, 6) AS mean_pct_units
      FROM s LEFT JOIN m ON (m.mask & s.combo_mask) = s.combo_mask, u WHERE s.n_attributes <= 3 GROUP BY 1, 2"""),
    "decision_notes": _q(_BEST + _TARGET.format(op="= 5") + _cand("richness_first") + f""", ha AS ({_HAS}),
      ls AS (SELECT n_attributes, lag(n_rows_complete) OVER (ORDER BY n_attributes) - n_rows_complete AS lost FROM best),
      bn AS (SELECT attribute, avg(CASE WHEN s.combo_mask & bit = 0 THEN n_rows_complete END) - avg(CASE WHEN s.combo_mask & bit <> 0 THEN n_rows_complete END) AS eff FROM ha, s WHERE attribute <> 'c_gkg' GROUP BY 1)""", """
      SELECT 1 AS note_order, (SELECT count(*) FROM s) || ' combinations were evaluated on ' || (SELECT count(*) FROM soil) || ' rows.' AS note
      UNION ALL SELECT 2, 'Candidates were ordered by selection_priority = richness_first.' UNION ALL SELECT 3, 'Attribute weights enter the weighted score.'
      UNION ALL SELECT 4, 'Valid ranges were given and do not count in the completeness of combinations.'
      UNION ALL (SELECT 5, 'Most complete rows: ' || attributes || ', with ' || n_rows_complete || ' rows.' FROM s ORDER BY n_rows_complete DESC, weighted_score DESC LIMIT 1)
      UNION ALL (SELECT 6, 'The least complete attribute is ' || attribute || ' with ' || n_non_na || ' values.' FROM ha ORDER BY n_non_na, attribute LIMIT 1)
      UNION ALL (SELECT 7, 'The largest loss, of ' || lost || ' rows, comes with size ' || n_attributes || '.' FROM ls WHERE lost IS NOT NULL ORDER BY lost DESC, n_attributes DESC LIMIT 1)
      UNION ALL (SELECT 8, 'The strongest bottleneck is ' || attribute || '.' FROM bn WHERE eff > 0 ORDER BY eff DESC, attribute DESC LIMIT 1)
      UNION ALL (SELECT 9, 'Best with the targets: ' || attributes || ', with ' || n_rows_complete || ' rows.' FROM tg ORDER BY n_rows_complete DESC, weighted_score DESC, n_attributes DESC, attributes LIMIT 1)
      UNION ALL SELECT 10, 'Selected: ' || attributes || ', with ' || n_rows_complete || ' complete rows.' FROM cand WHERE selection_rank = 1"""),
    "depth_class_exact": with_inputs("soil", "SELECT CASE " + " ".join(f"WHEN abs(upper_depth_cm - {a}) <= 1e-8 AND abs(lower_depth_cm - {b}) <= 1e-8 THEN '{a}-{b}'" for a, b in [(0, 5), (5, 15), (15, 30), (30, 45), (45, 60), (60, 75)]) + " ELSE 'other' END AS depth_class, count(*) AS n FROM soil GROUP BY 1"),
    "depth_class_midpoint": with_inputs("soil", f"SELECT {_CLASS} AS depth_class, count(*) AS n FROM soil GROUP BY 1"),
}

QUERIES = [
    availability_mask, attr_completeness, attr_completeness_ranges, row_attr_availability, attr_combinations, combo_summary, combo_units,
    combo_depth, best_combo_by_size, top_combo_by_size, selection_richness, selection_metric, selection_rows, pareto_combo, marginal_loss,
    bottleneck_summary, missingness_correlation, target_top, target_plus_by_size, target_any, diagnostic_combos, depth_completeness,
    unit_completeness, selected_data, selected_summary, priority_comparison, input_summary, decision_notes, combo_several_units, depth_class_exact, depth_class_midpoint,
]
