"""Hand-made vectors and degenerate inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pedolake.operators import cells, cleaning, completeness, metrics, profiles, resample, screening, spatial, tiles
from pedolake.sources import catalog


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_regression_vector(spark):
    pairs = [(3.0, 4.5), (7.0, 6.0), (12.0, 13.0), (18.0, 16.5), (20.0, 22.0), (26.0, 25.0), (31.0, 30.0)]
    row = metrics.regression_metrics(frame(spark, pairs, "obs double, pred double")).first()
    assert row.asDict().keys() == set(metrics.REGRESSION) and all(math.isfinite(v) for v in row)
    assert row["mae"] == pytest.approx(9 / 7) and row["rmse"] == pytest.approx(math.sqrt(12.5 / 7))


@pytest.mark.parametrize("rows", [[], [(1.0, 2.0)], [(10.0, float(i)) for i in range(5)], [(None, 1.0), (float("nan"), 2.0)]])
def test_regression_degenerate(spark, rows):
    row = metrics.regression_metrics(frame(spark, rows, "obs double, pred double")).first()
    assert all(v is None for v in row)


def test_class_vector(spark):
    rows = [("clay", "clay")] * 2 + [("clay", "loam")] + [("loam", "loam")] * 2 + [("loam", "sand"), ("sand", "sand"), ("sand", "clay")]
    row = metrics.class_metrics(frame(spark, rows, "obs string, pred string"), ["clay", "loam", "sand"]).first()
    assert row["accuracy"] == pytest.approx(5 / 8) and row["kappa"] == pytest.approx((5 / 8 - 22 / 64) / (1 - 22 / 64))
    assert len(row) == 13


def test_class_one_row_has_no_kappa(spark):
    row = metrics.class_metrics(frame(spark, [("loam", "loam")], "obs string, pred string"), ["clay", "loam", "sand"]).first()
    assert row["kappa"] is None and not any(isinstance(v, float) and math.isnan(v) for v in row)


def test_fold_validation(spark):
    rows = [(name, i, "holdout" if i < held else "train", "x") for name, held in (("three", 3), ("one", 1), ("all", 13)) for i in range(13)]
    index = frame(spark, [*rows, ("three", 99, "train", "x")], "resample string, row_id int, role string, class string")
    known = spark.range(13).selectExpr("cast(id as int) as row_id")
    out = {r["resample"]: r for r in resample.validate_resamples(index, 14, rows=known).collect()}
    assert {k: r["usable"] for k, r in out.items()} == {"three": False, "one": False, "all": False} and out["three"]["n_unknown"] == 1
    out = {r["resample"]: r["usable"] for r in resample.validate_resamples(frame(spark, rows, index.schema), 13, rows=known).collect()}
    assert out == {"three": True, "one": False, "all": False}
    with pytest.raises(ValueError):
        resample.require_usable(resample.validate_resamples(index, 14, rows=known))


def test_group_folds_do_not_leak(spark):
    rows = [(g * 10 + r, f"plot{g}", ("u", "v", "w")[g % 3]) for g in range(9) for r in range(2 + 2 * (g % 2))]
    df = frame(spark, rows, "row_id int, plot string, kind string")
    folds = resample.stratified_group_folds(df, "plot", "kind", 3, 2, 5)
    assert folds.select("rep", "fold").distinct().count() == 6
    assert all(r["n_leaking"] == 0 for r in resample.fold_leakage(folds, "plot").collect())
    assert resample.require_stratified(folds, "plot") is folds
    with pytest.raises(ValueError):  # a class of one group cannot be in every training part
        resample.require_stratified(resample.stratified_group_folds(df.where("plot in ('plot0', 'plot3', 'plot1')"), "plot", "kind", 3, 1, 5), "plot")


def test_group_folds_need_two_groups(spark):
    with pytest.raises(ValueError):
        resample.group_kfold(frame(spark, [(1, "g")], "row_id int, id string"), "id", "row_id", 4, 1, 1)


def test_balanced_split():
    assert tiles.split_weights(np.full(12, 2.0), 3) == [(0, 3), (4, 7), (8, 11)]
    assert tiles.split_weights(np.array([0, 0, 0, 7, 0, 2]), 3) == [(0, 2), (3, 3), (4, 5)]
    with pytest.raises(ValueError):
        tiles.split_weights(np.zeros(6), 3)


def test_depth_classes(spark):
    df = frame(spark, [(0.0, 5.0), (50.0, 150.0), (90.0, 130.0), (None, 5.0)], "u double, l double")
    kinds = [r[0] for r in df.select(completeness.depth_class_midpoint(F.col("u"), F.col("l"), [0.0, 5.0, 100.0])).collect()]
    assert kinds == ["0-5", "5-100", "deeper_than_100", None]


def test_combinations_with_no_rows(spark):
    df = frame(spark, [], "a double, b double")
    out = completeness.combo_summary(spark, df, ["a", "b"]).collect()
    assert [r["n_rows_complete"] for r in out] == [0] and out[0]["pct_rows_complete"] is None


def test_too_many_attributes(spark):
    with pytest.raises(ValueError):
        completeness.attr_combinations(spark, [f"a{i}" for i in range(64)])


def test_outliers_keep_constant_and_drop_null(spark):
    df = frame(spark, [(1.0,), (1.0,), (1.0,), (9.0,), (None,)], "v double")
    assert sorted(r[0] for r in cleaning.remove_outliers(df, ["v"]).collect()) == [1.0, 1.0, 1.0]


def test_outliers_of_a_null_group(spark):
    df = frame(spark, [(None, 1.0), (None, 1.1), ("g", 5.0)], "g string, v double")
    assert cleaning.remove_outliers(df, ["v"], 1.5, ["g"]).count() == 3


def test_report_of_a_null_group(spark):
    df = frame(spark, [(None, 1.0), (None, 1.1), (None, 1.2), ("g", 5.0)], "g string, v double")
    out = {r["g"]: (r["n_before"], r["n_after"]) for r in cleaning.outlier_report(df, ["v"], 1.5, ["g"]).collect()}
    assert out == {None: (3, 3), "g": (1, 1)}


def test_gates_raise(spark):
    df = frame(spark, [(1.0, 2.0), (float("nan"), 3.0)], "a double, b double")
    assert cleaning.require_clean(df, ["b"]) is df
    with pytest.raises(ValueError, match="a"):
        cleaning.require_clean(df, ["a", "b"])
    with pytest.raises(ValueError):
        catalog.require_links(df.limit(0), "datasets")
    with pytest.raises(ValueError):
        catalog.require_tables(["layer", "nowhere"])
    with pytest.raises(ValueError):
        catalog.require_no_conflicts(df)


def test_paths_there_and_back(spark):
    long = "/data/soil/" + "d/" * 6000 + "x.tif"
    files = frame(spark, [("/data/soil/a/b.tif",), (long,), ("/else/b.tif",)], "file_path string")
    there = catalog.object_paths(files, "/data/soil", "gs://bucket/soil", r"\.tif$")
    back = {r["file_path"]: r["local_path"] for r in catalog.local_paths(there.where("object_uri is not null"), "gs://bucket/soil/", "/data/soil").collect()}
    assert back == {"/data/soil/a/b.tif": "/data/soil/a/b.tif", long: long}


def test_ids_from_any_column(spark):
    df = frame(spark, [("x1", "CTB0001 "), ("zz", "note"), (None, "abc1234")], "code string, note string")
    assert sorted(r[0] for r in catalog.detect_dataset_ids(df).collect()) == ["abc1234", "ctb0001"]


def test_missing_rasters_and_sizes_of_zero(spark):
    cells_ = frame(spark, [(r, c, None) for r in range(4) for c in range(4)], "row int, col int, v double")
    grid = frame(spark, [(1, 0, 1, 0, 3), (2, 2, 3, 0, 3)], "tile_id int, row_start int, row_end int, col_start int, col_end int")
    summary = tiles.tile_summary(cells_, grid, "v")
    assert [r["error_pct"] for r in summary.collect()] == [None, None]
    assert tiles.global_summary(summary).first()["status"] == "poor"
    assert tiles.tile_polygons(grid.limit(1), 0.5, 10.0).first()["wkt"] == "POLYGON ((0.0 9.0, 2.0 9.0, 2.0 10.0, 0.0 10.0, 0.0 9.0))"
    profile = frame(spark, [(2, 0.0), (3, -1.0)], "size int, r2 double")
    assert metrics.size_within_tolerance(profile, "size", "r2", 1.0).count() == 0
    coded = cells_.withColumn("v", F.when(F.col("row") == 0, F.col("col") * 1.0))
    assert [r["n_valid"] for r in tiles.tile_summary(coded, grid, "v", [1.0, 3.0]).orderBy("tile_id").collect()] == [2, 0]


def test_layers_are_aligned_and_checked(spark):
    base = cells.Grid(0.0, 40.0, 10.0, 4, 4)
    coarse = cells.Grid(0.0, 40.0, 20.0, 2, 2)
    fine = frame(spark, [(r, c, float(10 * r + c)) for r in range(4) for c in range(4)], "row int, col int, value double")
    wide = frame(spark, [(r, c, float(r * 2 + c)) for r in range(2) for c in range(2)], "row int, col int, value double")
    out = cells.align_layers({"fine": (fine, base), "wide": (wide, coarse)}, base).collect()
    assert len(out) == 16 and all(r["fine"] == 10 * r["row"] + r["col"] and r["wide"] == r["row"] // 2 * 2 + r["col"] // 2 for r in out)
    with pytest.raises(ValueError):
        cells.require_same_geometry([base, coarse])
    with pytest.raises(ValueError):
        cells.band_stack({"a": fine, "b": fine.where("row > 0")}, strict=True)


def test_missing_cells_take_a_constant(spark):
    df = frame(spark, [(0, 0, 1.0), (0, 1, None), (9, 9, None)], "row int, col int, v double")
    assert sorted(r["v"] for r in cells.focal_fill(df, "v", 3, substitute=-9.0).collect()) == [-9.0, 1.0, 1.0]


def test_find_correlated():
    m = np.array([[1, 0.95, 0.1], [0.95, 1, 0.3], [0.1, 0.3, 1]])
    assert screening.find_correlated(m, 0.9) == [1]
    assert screening.find_correlated(np.eye(3), 0.9) == []


def test_splines_side_by_side(spark):
    """Profiles of equally many layers are fitted together: by hand for two layers, with gaps, and outside of the depths."""
    rng, breaks = np.random.default_rng(2), [0.0, 5.0, 15.0, 30.0]
    upper, value = np.sort(rng.integers(0, 5, (2000, 3)) + [0, 8, 20], axis=1).astype(float), rng.normal(size=(2000, 3))
    lower = upper + rng.integers(1, 8, (2000, 3))
    means, rmse = profiles.splines_means(upper, lower, value, breaks, 0.1)
    for i in range(0, 2000, 100):
        one = profiles.spline_means(upper[i], lower[i], value[i], breaks, 0.1)
        assert np.allclose(means[i], one[0], equal_nan=True) and np.isclose(rmse[i], one[1])
    rows = [(1, 0.0, 10.0, 2.0), (1, 10.0, 30.0, 5.0), (2, 0.0, 4.0, 3.0), (3, 40.0, 50.0, 8.0), (4, 10.0, 20.0, 6.0), (4, 0.0, 10.0, 6.0)]
    got = {r["profile_id"]: r for r in profiles.depth_spline(spark.createDataFrame(rows, "profile_id int, upper_limit double, lower_limit double, value double"), breaks).collect()}
    fitted = np.linalg.solve(np.eye(2) + 1.2 / 60 * np.array([[1, -1], [-1, 1]]), [2.0, 5.0])  # 6 n lambda q' r^-1 q with r = 2 (10 + 20)
    assert np.isclose(got[1]["rmse"], np.sqrt(np.mean((fitted - [2.0, 5.0]) ** 2)))
    assert (got[2]["d_0_5"], got[2]["d_5_15"], got[3]["d_0_5"], got[3]["filled"], got[2]["filled"]) == (3.0, None, 8.0, True, False) or np.isnan(got[2]["d_5_15"])
    assert np.allclose([got[4][c] for c in ("d_0_5", "d_5_15")], 6.0)


def test_spline_of_a_flat_profile():
    means, rmse = profiles.spline_means(np.array([0.0, 10.0, 30.0]), np.array([10.0, 30.0, 60.0]), np.array([7.0, 7.0, 7.0]), [0.0, 5.0, 15.0, 30.0, 60.0], 0.1)
    assert np.allclose(means, 7.0) and rmse == pytest.approx(0, abs=1e-9)


def test_boundary_points_count_twice(spark):
    boxes = frame(spark, [(1, "p", 0.0, 5.0, 0.0, 5.0), (2, "q", 5.0, 9.0, 0.0, 5.0)], "poly_id long, class_name string, xmin double, xmax double, ymin double, ymax double")
    points = frame(spark, [(1, 5.0, 2.0), (2, 50.0, 2.0)], "point_id long, x double, y double")
    out = {r["class_name"]: r["n_points"] for r in spatial.points_to_class(points, boxes).collect()}
    assert out == {"p": 1, "q": 1, None: 1}


def test_even_window_is_refused(spark):
    with pytest.raises(ValueError):
        cells.focal_fill(spark.createDataFrame([(0, 0, 1.0)], "row int, col int, v double"), "v", 4)


def test_zero_denominators_are_null(spark):
    df = frame(spark, [(0, 0, *[0.0] * 6)], "row int, col int, blue double, green double, red double, nir double, swir1 double, swir2 double")
    row = cells.landsat_indices(df, {k: k for k in ("blue", "green", "red", "nir", "swir1", "swir2")}).first()
    assert row["ndvi"] is None and row["clay"] is None and row["brightness"] == 0.0


def test_unknown_index_is_refused(spark):
    with pytest.raises(ValueError):
        cells.landsat_indices(frame(spark, [(1.0,)], "red double"), {}, ["nope"])


def test_empty_catalogue_step_is_an_error(spark):
    pages = spark.createDataFrame([(1, "http://a", '<a href="/Soil">')], "page_id int, url string, html string")
    assert catalog.catalog_links(pages, ["^/S", "l$"], strict=True).count() == 1 and catalog.catalog_links(pages, ["^/x"]).count() == 0
    with pytest.raises(ValueError, match="no links"):
        catalog.catalog_links(pages, ["^/S", "^/x"], strict=True)
