"""Uniform and balanced tilings of cell tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import finite, plain, ratio_nonzero


def valid_cell(band: str, values: list | None = None) -> Column:
    """Whether a cell counts: a finite value, or one of the given values."""
    c = F.col(band)
    return F.coalesce(c.isin(values), F.lit(False)) if values else finite(c)


def uniform_tiles(cells: DataFrame, rows: int, cols: int, n_rows: int, n_cols: int) -> DataFrame:
    """Tile of each cell of an n_rows x n_cols grid, row by row from the top left, starting at 1."""
    high, wide = -(-n_rows // rows), -(-n_cols // cols)
    tile = F.floor(F.col("row") / high) * cols + F.floor(F.col("col") / wide) + 1
    return cells.withColumn("tile_id", tile.cast("int"))


def check_tiles(tiles: DataFrame, cells: DataFrame, band: str) -> DataFrame:
    """For each wanted tile id, whether any of its cells has a value."""
    seen = cells.groupBy("tile_id").agg((F.count(band) > 0).alias("has_data"))
    return tiles.join(seen, "tile_id", "left").withColumn("has_data", F.coalesce("has_data", F.lit(False)))


def split_weights(weights: np.ndarray, k: int) -> list[tuple[int, int]]:
    """k consecutive ranges (inclusive, from 0) of about equal weight: each end is the better of the two
    places around its cumulative target, and leaves one index for every later range."""
    w = np.asarray(weights, float)
    n, total = len(w), w.sum()
    if k > n or total <= 0:
        raise ValueError("more ranges than rows, or no weight")
    sums, target, out, start = np.cumsum(w), total / k, [], 0
    for g in range(1, k):
        high = int(np.searchsorted(sums, target * g))
        low, most = start, n - (k - g) - 1
        options = sorted({min(max(c, low), most) for c in (high - 1, high)})
        before = sums[start - 1] if start else 0.0
        end = min(options, key=lambda c: (abs(sums[c] - before - target), c))
        out.append((start, end))
        start = end + 1
    return [*out, (start, n - 1)]


def row_weights(cells: DataFrame, band: str) -> DataFrame:
    """Valid cells of each row."""
    return cells.groupBy("row").agg(F.count_if(valid_cell(band)).alias("w"))


_RANGE = "part int, low int, high int, weight long"


def _ranges(pdf: pd.DataFrame, key: str, k: int, first: int, last: int) -> pd.DataFrame:
    weights = np.zeros(last - first + 1)
    np.add.at(weights, pdf[key].to_numpy() - first, pdf["w"].to_numpy())
    cuts = split_weights(weights, k)
    return pd.DataFrame(
        [(i + 1, a + first, b + first, int(weights[a : b + 1].sum())) for i, (a, b) in enumerate(cuts)], columns=["part", "low", "high", "weight"]
    )


def balanced_row_ranges(cells: DataFrame, band: str, k: int, first: int, last: int) -> DataFrame:
    """k ranges of rows of about equal weight. What meets in one group is one count per raster row."""
    w = row_weights(cells, band).withColumn("g", F.lit(1))
    return w.groupBy("g").applyInPandas(lambda p: _ranges(p, "row", k, first, last), _RANGE).withColumnRenamed("part", "tile_row")


def balanced_tiles(cells: DataFrame, band: str, k_rows: int, k_cols: int, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Balanced row ranges, and balanced column ranges within each: one row per tile."""
    blocks = balanced_row_ranges(cells, band, k_rows, *rows).select("tile_row", F.col("low").alias("row_start"), F.col("high").alias("row_end"))
    inside = F.col("row").between(F.col("row_start"), F.col("row_end"))
    w = cells.join(F.broadcast(blocks), inside).groupBy("tile_row", "row_start", "row_end", "col").agg(F.count_if(valid_cell(band)).alias("w"))

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _ranges(pdf, "col", k_cols, *cols)
        return out.assign(tile_row=pdf.tile_row.iloc[0], row_start=pdf.row_start.iloc[0], row_end=pdf.row_end.iloc[0])

    tiles = w.groupBy("tile_row").applyInPandas(split, f"{_RANGE}, tile_row int, row_start int, row_end int")
    return tiles.select(
        ((F.col("tile_row") - 1) * k_cols + F.col("part")).alias("tile_id"), "tile_row", F.col("part").alias("tile_col"),
        "row_start", "row_end", F.col("low").alias("col_start"), F.col("high").alias("col_end"), F.col("weight").alias("n_valid_pixels"),
    )


def cells_in_tiles(cells: DataFrame, tiles: DataFrame) -> DataFrame:
    """Cells with the tile whose ranges hold them: joined by raster row, then only a row's own tiles are looked at."""
    by_row = tiles.withColumn("row", F.explode(F.sequence("row_start", "row_end").cast("array<int>")))
    return cells.join(by_row, "row").where(F.col("col").between(F.col("col_start"), F.col("col_end")))


def tile_summary(cells: DataFrame, tiles: DataFrame, band: str, values: list | None = None) -> DataFrame:
    """Pixels, valid pixels (finite ones, or those of the given values), target and error of each tile; tiles without cells count 0."""
    n = cells_in_tiles(cells, tiles.select("tile_id", "row_start", "row_end", "col_start", "col_end"))
    n = n.groupBy("tile_id").agg(F.count_if(valid_cell(band, values)).alias("n_valid"))
    out = tiles.select("tile_id", "row_start", "row_end", "col_start", "col_end").join(n, "tile_id", "left")
    total = cells.agg(F.count_if(valid_cell(band, values)).alias("all_valid")).join(tiles.agg(F.count(F.lit(1)).alias("n_tiles")))
    high, wide = (F.col(f"{c}_end").cast("long") - F.col(f"{c}_start") + 1 for c in ("row", "col"))
    pixels = high * wide  # of a large grid more than an int holds
    out = out.join(F.broadcast(total)).withColumn("n_valid", F.coalesce("n_valid", F.lit(0).cast("long"))).withColumn("n_total", pixels)
    target = F.col("all_valid") / F.col("n_tiles")
    return out.select(
        "tile_id", "n_total", "n_valid", (F.col("n_valid") / F.col("n_total")).alias("valid_fraction"), target.alias("target"),
        (F.col("n_valid") - target).alias("error"), ratio_nonzero(100 * (F.col("n_valid") - target), target).alias("error_pct"),
    )


def global_summary(summary: DataFrame) -> DataFrame:
    """Balance of a tiling in one row, with its status."""
    n, e, size, share = F.col("n_valid"), F.abs(F.col("error_pct")), F.col("n_total"), F.col("valid_fraction")
    one = summary.agg(
        F.count(F.lit(1)).alias("n_tiles"), F.sum("n_total").alias("total_pixels"), F.sum(n).alias("valid_pixels"), F.min(n).alias("min_valid"),
        F.max(n).alias("max_valid"), F.avg(n).alias("mean_valid"), F.median(n).alias("median_valid"), F.stddev_samp(n).alias("sd_valid"),
        F.avg(e).alias("mean_abs_error_pct"), F.max(e).alias("max_abs_error_pct"), F.count_if(n == 0).alias("n_empty"),
        F.percentile(n, 0.25).alias("q25_valid"), F.percentile(n, 0.75).alias("q75_valid"), F.max("target").alias("target"),
        F.max(F.abs(F.col("error"))).alias("max_abs_error"), F.min(size).alias("min_total"), F.max(size).alias("max_total"),
        F.avg(size).alias("mean_total"), F.median(size).alias("median_total"), F.min(share).alias("min_fraction"), F.max(share).alias("max_fraction"),
        F.avg(share).alias("mean_fraction"), F.median(share).alias("median_fraction"),
    )
    cv, worst = ratio_nonzero(F.col("sd_valid"), F.col("mean_valid")), F.col("max_abs_error_pct")
    status = (
        F.when(F.col("n_empty") > 0, "poor")
        .when((cv <= 0.02) & (worst <= 5), "excellent")
        .when((cv <= 0.05) & (worst <= 10), "good")
        .when((cv <= 0.10) & (worst <= 20), "acceptable")
        .otherwise("poor")
    )
    return one.withColumn("cv_valid", cv).withColumn("valid_fraction", ratio_nonzero(F.col("valid_pixels"), F.col("total_pixels"))).withColumn("status", status)


def tile_polygons(tiles: DataFrame, res: float, ymax: float) -> DataFrame:
    """Closed rings of tiles as text, from half a cell outside the outer cell centres."""
    x0, x1 = F.col("col_start") * res, (F.col("col_end") + 1) * res
    y1, y0 = ymax - F.col("row_start") * res, ymax - (F.col("row_end") + 1) * res
    point = lambda x, y: F.concat(plain(x.cast("double")), F.lit(" "), plain(y.cast("double")))
    ring = F.concat_ws(", ", point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))
    return tiles.select("tile_id", F.concat(F.lit("POLYGON (("), ring, F.lit("))")).alias("wkt"))
