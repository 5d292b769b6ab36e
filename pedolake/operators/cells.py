"""Raster algebra on cell tables: one row per cell (row, col, x, y) and one column per band.

Cell-wise indices are column expressions. Neighbourhood operators run on tiles with a halo (see ``halo``): cells are
exchanged once, and windows are array operations.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import written
from . import halo
from .order_stats import quantiles

div = F.try_divide


def _cols(bands: Mapping[str, str], names: str) -> list[Column]:
    return [F.col(bands[n]) for n in names.split()]


def _norm(a: Column, b: Column) -> Column:
    return div(a - b, a + b)


def sentinel_indices(df: DataFrame, bands: Mapping[str, str]) -> DataFrame:
    """24 spectral indices of Sentinel-2 bands (b2 ... b12); a zero denominator gives null."""
    b, g, r, e1, e2, e3, n, n2, s1, s2 = _cols(bands, "b2 b3 b4 b5 b6 b7 b8 b8a b11 b12")
    mcari = ((e1 - r) - 0.2 * (e1 - g)) * div(e1, r)
    mcari705 = ((e2 - e1) - 0.2 * (e2 - g)) * div(e2, e1)
    twice = 2 * n + 1
    out = {
        "ireci": div(e3 - r, div(e1, e2)),
        "mcari": mcari,
        "mcari705": mcari705,
        "mcariosavi": div(mcari, div(1.16 * (n - r), n + r + 0.16)),
        "mcariosavi705": div(mcari705, div(1.16 * (e2 - e1), e2 + e1 + 0.16)),
        "msr705": div(div(e2, e1) - 1, F.sqrt(div(e2, e1) + 1)),
        "nd705": _norm(e2, e1),
        "rvi": div(e2, r),
        "s2rep": 705 + 35 * div((e3 + r) / 2 - e1, e2 - e1),
        "s2wi": _norm(e1, s2),
        "seli": _norm(n2, e1),
        "twi": 2.84 * div(e1 - e2, g + s2) + div(1.25 * (g - b) - (n - b), n + 1.25 * g - 0.25 * b),
        "vi700": _norm(e1, r),
        "ndvi": _norm(n, r),
        "evi": 2.5 * div(n - r, n + 6 * r - 7.5 * b + 1),
        "savi": 1.5 * div(n - r, n + r + 0.5),
        "msavi": (twice - F.sqrt(twice * twice - 8 * (n - r))) / 2,
        "ndmi": _norm(n, s1),
        "ndmi2": _norm(n2, s1),
        "nbr": _norm(n, s2),
        "nbr2": _norm(s1, s2),
        "ndsi": _norm(r, s1),
        "ndsi2": _norm(g, s1),
        "ndwi": _norm(g, n),
    }
    return df.withColumns(out)


LANDSAT = ["ndvi", "savi", "msavi", "bsi", "mbi", "ndmi", "nbr2", "nci", "brightness", "clay", "ri", "fei", "coi", "si"]


def landsat_indices(df: DataFrame, bands: Mapping[str, str], indices: Sequence[str] = LANDSAT, savi_l: float = 0.5) -> DataFrame:
    """The wanted ones of 14 Landsat indices (blue, green, red, nir, swir1, swir2); null on a zero denominator."""
    unknown = set(indices) - set(LANDSAT)
    if unknown:
        raise ValueError(f"unknown indices: {sorted(unknown)}")
    b, g, r, n, s1, s2 = _cols(bands, "blue green red nir swir1 swir2")
    under = (2 * n + 1) * (2 * n + 1) - 8 * (n - r)
    out = {
        "ndvi": _norm(n, r),
        "savi": div((n - r) * (1 + savi_l), n + r + savi_l),
        "msavi": F.when(under >= 0, (2 * n + 1 - F.sqrt(under)) / 2),
        "bsi": div((s1 + r) - (n + b), (s1 + r) + (n + b)),
        "mbi": div(s1 - s2 - n, s1 + s2 + n) + 0.5,
        "ndmi": _norm(n, s1),
        "nbr2": _norm(s1, s2),
        "nci": _norm(s1, s2),
        "brightness": F.sqrt(b * b + g * g + r * r),
        "clay": div(s1, s2),
        "ri": div(r * r, b * g * g * g),
        "fei": div(r, s1),
        "coi": _norm(r, g),
        "si": _norm(r, b),
    }
    return df.withColumns({k: out[k] for k in indices})


def reflectance(c: Column) -> Column:
    """Surface reflectance from a scaled integer band."""
    return c * 0.0000275 - 0.2


def celsius(c: Column) -> Column:
    """Surface temperature in degrees Celsius from a scaled thermal band."""
    return c * 0.00341802 + 149.0 - 273.15


@dataclass(frozen=True)
class Grid:
    """Geometry of a layer: left and upper edge, cell size, rows and columns, and its coordinate system."""

    xmin: float
    ymax: float
    res: float
    n_rows: int
    n_cols: int
    crs: str = ""


def require_same_geometry(grids: Sequence[Grid]) -> Grid:
    """The one geometry of all layers, or an error that tells what differs."""
    for k, g in enumerate(grids[1:], 2):
        differ = [f for f in Grid.__dataclass_fields__ if getattr(g, f) != getattr(grids[0], f)]
        if differ:
            raise ValueError(f"layer {k} differs in {', '.join(differ)}")
    return grids[0]


def band_stack(bands: Mapping[str, DataFrame], grids: Sequence[Grid] = (), strict: bool = False) -> DataFrame:
    """Bands of one geometry, each a table (row, col, value), as one table of the cells that all of them have.

    Given grids must agree; strict asks that every band has every cell.
    """
    if grids:
        require_same_geometry(grids)
    out = None
    for name, df in bands.items():
        one = df.select("row", "col", F.col("value").alias(name))
        out = one if out is None else out.join(one, ["row", "col"])
    if strict:
        n = out.count()
        odd = [name for name, df in bands.items() if df.count() != n]
        if odd:
            raise ValueError(f"bands with cells that others lack: {', '.join(odd)}")
    return out


def on_grid(layer: DataFrame, own: Grid, base: Grid) -> DataFrame:
    """A layer (row, col, value) on another grid: each new cell takes the cell that holds its centre.

    A cell tells by itself which new centres it holds, so nothing is joined.
    """
    left, top = own.xmin + F.col("col") * own.res, own.ymax - F.col("row") * own.res
    first = lambda at: F.ceil(at / base.res - 0.5)  # noqa: E731  the first centre at or behind a place
    inside = lambda lo, hi, n: (F.greatest(first(lo), F.lit(0)), F.least(first(hi) - 1, F.lit(n - 1)))
    r0, r1 = inside(base.ymax - top, base.ymax - top + own.res, base.n_rows)
    c0, c1 = inside(left - base.xmin, left - base.xmin + own.res, base.n_cols)
    spans = layer.select("value", r0.alias("r0"), r1.alias("r1"), c0.alias("c0"), c1.alias("c1")).where("r0 <= r1 and c0 <= c1")
    out = spans.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1")))
    return out.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "value")


def align_layers(layers: Mapping[str, tuple[DataFrame, Grid]], base: Grid) -> DataFrame:
    """Layers on the base grid, as one table: those of its geometry as they are, others by the nearest cell."""
    out = None
    for name, (df, grid) in layers.items():
        df = df.select("row", "col", "value")
        one = (df if grid == base else on_grid(df, grid, base)).withColumnRenamed("value", name)
        out = one if out is None else out.join(one, ["row", "col"], "full")
    return out


def reproject(spark: SparkSession, layer: DataFrame, own: Grid, target: Grid, back: Callable[[Column, Column], tuple[Column, Column]]) -> DataFrame:
    """A layer (row, col, value) on a grid of another coordinate system, by the nearest cell: ``back`` takes
    target coordinates to the layer's. Target cells outside the layer are left out."""
    cells = spark.range(target.n_rows * target.n_cols).select(
        F.floor(F.col("id") / target.n_cols).cast("int").alias("r"), (F.col("id") % target.n_cols).cast("int").alias("c")
    )
    x, y = back(target.xmin + (F.col("c") + 0.5) * target.res, target.ymax - (F.col("r") + 0.5) * target.res)
    at = cells.select("r", "c", F.floor((own.ymax - y) / own.res).cast("int").alias("row"), F.floor((x - own.xmin) / own.res).cast("int").alias("col"))
    return at.join(layer, ["row", "col"]).select(F.col("r").alias("row"), F.col("c").alias("col"), "value")


def dominant_layer(df: DataFrame, layers: Sequence[str], largest: bool = True, use_abs: bool = True) -> DataFrame:
    """Layer of the largest (or least) value in each complete cell, ties to the first, and its alphabetical code."""
    values = [F.abs(F.col(c)) if use_abs else F.col(c) for c in layers]
    best = F.greatest(*values) if largest else F.least(*values)
    name = F.coalesce(*[F.when(v == best, F.lit(c)) for v, c in zip(values, layers, strict=True)])
    codes = F.create_map(*[F.lit(x) for k, c in enumerate(sorted(layers)) for x in (c, k + 1)])
    done = df.na.drop(subset=list(layers)).withColumn("dominant", name)
    return done.withColumn("code", codes[F.col("dominant")])


def ensemble_agreement(df: DataFrame, layers: Sequence[str]) -> DataFrame:
    """Per cell: distinct values (missing counts as one), the commonest value (ties to the least text) and its share of layers."""
    values = F.array(*[F.col(c).cast("string") for c in layers])
    present = F.array_compact(values)
    counted = F.transform(F.array_sort(F.array_distinct(present)), lambda v: F.struct(F.size(F.filter(present, lambda w: w == v)).alias("n"), v.alias("v")))
    best = F.aggregate(
        counted, F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("v")), lambda a, b: F.when(b["n"] > a["n"], b).otherwise(a)
    )
    out = df.withColumn("variety", F.size(F.array_distinct(values))).withColumn("__best", best)
    share = F.when(F.col("__best.n") > 0, 100.0 * F.col("__best.n") / len(layers))
    return out.withColumn("moda", F.col("__best.v")).withColumn("frequencia_moda", share).drop("__best")


def focal_fill(cells: DataFrame, band: str, n: int = 3, how: str = "avg", substitute: float | None = None) -> DataFrame:
    """Missing values of a band from a function of their n x n window (avg, sum, min, max, median); present values
    stay. What no window fills takes the substitute, if one is given."""
    if n % 2 == 0:
        raise ValueError("the window must be odd")
    filled = halo.focal(cells, band, n, how).withColumnRenamed("value", "__fill")
    return cells.join(filled, ["row", "col"], "left").withColumn(band, F.coalesce(band, "__fill", F.lit(substitute).cast("double"))).drop("__fill")


def resample_near(cells: DataFrame, band: str, factor: float) -> DataFrame:
    """Grid of factor times the cell size: each new cell takes the source cell that holds its centre."""
    source = cells.select("row", "col", F.col(band).alias("value"))
    grown = source.select(F.floor(F.col("row") / factor).cast("int").alias("r"), F.floor(F.col("col") / factor).cast("int").alias("c")).distinct()
    at = grown.select("r", "c", F.floor((F.col("r") + 0.5) * factor).cast("int").alias("row"), F.floor((F.col("c") + 0.5) * factor).cast("int").alias("col"))
    return at.join(source, ["row", "col"]).select("r", "c", "value")


def resample_sum(cells: DataFrame, band: str, factor: int) -> DataFrame:
    """Sums over blocks of factor x factor cells (a coarser grid of the same origin)."""
    return cells.groupBy(F.floor(F.col("row") / factor).cast("int").alias("r"), F.floor(F.col("col") / factor).cast("int").alias("c")).agg(
        F.sum(band).alias("value"), F.count(band).alias("n_cells")
    )


def resample_bilinear(cells: DataFrame, band: str, factor: float) -> DataFrame:
    """Bilinear values at the centres of a grid of factor times the cell size; missing neighbours take no weight."""
    return halo.resampled(cells, band, factor, lambda t: np.maximum(1 - t, 0.0), 1, 0.0)


def cubic_weight(t: np.ndarray) -> np.ndarray:
    """Catmull-Rom kernel of distances."""
    return np.where(t <= 1, 1.5 * t * t * t - 2.5 * t * t + 1, np.where(t < 2, -0.5 * t * t * t + 2.5 * t * t - 4 * t + 2, 0.0))


def spline_weight(t: np.ndarray) -> np.ndarray:
    """Cubic B-spline kernel of distances."""
    return np.where(t < 1, 2.0 / 3.0 - t * t + 0.5 * t * t * t, np.where(t < 2, (2 - t) * (2 - t) * (2 - t) / 6.0, 0.0))


def lanczos_weight(t: np.ndarray) -> np.ndarray:
    """Lanczos kernel of three lobes, of distances."""
    x = np.pi * np.where(t < 1e-9, 1.0, t)
    return np.where(t < 1e-9, 1.0, np.where(t < 3, 3 * np.sin(x) * np.sin(x / 3) / (x * x), 0.0))


#: Kernels by name, with the cells that they reach to either side.
KERNELS = {"cubic": (cubic_weight, 2), "cubicspline": (spline_weight, 2), "lanczos": (lanczos_weight, 3)}


def resample_kernel(cells: DataFrame, band: str, factor: float, kernel: str) -> DataFrame:
    """Weighted means of the cells around each new centre, weights made to sum to one over the present ones."""
    if kernel not in KERNELS:
        raise ValueError(f"unknown kernel {kernel}")
    return halo.resampled(cells, band, factor, *KERNELS[kernel], 1e-6)


#: Radius of the sphere of the web Mercator projection, in metres.
SPHERE = 6378137.0


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Spherical Mercator coordinates of degrees."""
    return F.radians(lon) * SPHERE, F.log(F.tan(F.radians(lat) / 2 + F.lit(0.7853981633974483))) * SPHERE


def inverse_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """Degrees of spherical Mercator coordinates."""
    return F.degrees(x / SPHERE), F.degrees(2 * F.atan(F.exp(y / SPHERE))) - 90.0


def sinusoidal(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Sinusoidal coordinates of degrees."""
    return F.radians(lon) * F.cos(F.radians(lat)) * SPHERE, F.radians(lat) * SPHERE


def crop_box(df: DataFrame, xmin: float, xmax: float, ymin: float, ymax: float) -> DataFrame:
    """Cells whose centre lies in a box."""
    return df.where(F.col("x").between(xmin, xmax) & F.col("y").between(ymin, ymax))


def in_ring(x: Column, y: Column, ring: Sequence[tuple[float, float]]) -> Column:
    """Even-odd test of a point against one closed ring."""
    odd = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 != y2:
            hit = (F.lit(y1) > y) != (F.lit(y2) > y)
            odd = odd + (hit & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)).cast("int")
    return odd % 2 == 1


def quantile_class(df: DataFrame, band: str, breaks: int) -> DataFrame:
    """Class 2 ... breaks + 1 of a band by its quantiles: right-closed, the least value in the first."""
    cuts = quantiles(df, band, [k / breaks for k in range(1, breaks)]).select(F.col("q").alias("cuts"))
    below = F.size(F.filter("cuts", lambda c: c < F.col(band)))
    return df.join(F.broadcast(cuts)).withColumn(f"{band}_class", (below + 2).cast("int")).drop("cuts")


def bivariate_map(df: DataFrame, xband: str, yband: str, breaks: int) -> DataFrame:
    """Classes of both bands and their common colour id, column by column through a (breaks + 1)² matrix."""
    whole = written(df.na.drop(subset=[xband, yband]), "bands")  # quantiles read them several times
    done = quantile_class(quantile_class(whole, xband, breaks), yband, breaks)
    colour = (F.col(f"{xband}_class") - 1) * (breaks + 1) + F.col(f"{yband}_class")
    return done.withColumn("colour_id", colour.cast("int"))


def grid_extent(df: DataFrame) -> DataFrame:
    """Extent of the cell centres and the latitude halfway."""
    e = df.agg(F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"), F.count(F.lit(1)).alias("n_cells"))
    return e.withColumn("median_y", (F.col("ymin") + F.col("ymax")) / 2)


def value_attribute_table(df: DataFrame, code: str, labels: DataFrame) -> DataFrame:
    """Cells of each code, with its label from a small table (code, label)."""
    n = df.where(F.col(code).isNotNull()).groupBy(F.col(code).alias("code")).agg(F.count(F.lit(1)).alias("n_cells"))
    return n.join(F.broadcast(labels), "code", "left")


# Terrain


def neighbourhood(cells: DataFrame, band: str) -> DataFrame:
    """Cells with all nine values z1 ... z9 of their 3 x 3 window (z1 top left, z5 the cell)."""
    return halo.surrounding(cells, band)


def _z() -> list[Column]:
    return [F.lit(None)] + [F.col(f"z{k}") for k in range(1, 10)]


def gradients(res: float) -> tuple[Column, Column]:
    """Eastward and northward slopes by weighted differences (rows run southwards)."""
    z = _z()
    east = ((z[3] + 2 * z[6] + z[9]) - (z[1] + 2 * z[4] + z[7])) / (8 * res)
    north = ((z[1] + 2 * z[2] + z[3]) - (z[7] + 2 * z[8] + z[9])) / (8 * res)
    return east, north


def slope_aspect(window: DataFrame, res: float) -> DataFrame:
    """Slope in degrees, and aspect in degrees clockwise from north (null where flat)."""
    east, north = gradients(res)
    aspect = F.pmod(F.degrees(F.atan2(-east, -north)) + 360.0, F.lit(360.0))
    return window.withColumn("slope", F.degrees(F.atan(F.sqrt(east * east + north * north)))).withColumn(
        "aspect", F.when((east != 0) | (north != 0), aspect)
    )


def hillshade(window: DataFrame, res: float, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """Cosine of the angle between the surface normal and the sun."""
    east, north = gradients(res)
    az, alt = F.radians(F.lit(azimuth)), F.radians(F.lit(altitude))
    lit = F.sin(alt) - F.cos(alt) * (east * F.sin(az) + north * F.cos(az))
    return window.withColumn("hillshade", lit / F.sqrt(1 + east * east + north * north))


def ruggedness(window: DataFrame) -> DataFrame:
    """Root of the summed squared differences to the eight neighbours."""
    z = _z()
    return window.withColumn("tri", F.sqrt(sum((z[k] - z[5]) * (z[k] - z[5]) for k in (1, 2, 3, 4, 6, 7, 8, 9))))


def surface_area(window: DataFrame, res: float) -> DataFrame:
    """Area of a cell on its slope."""
    east, north = gradients(res)
    return window.withColumn("surface_area", res * res * F.sqrt(1 + east * east + north * north))


def position_index(cells: DataFrame, band: str, radius: int, name: str = "tpi") -> DataFrame:
    """Cells (row, col, the band) and their value less the mean of the disc around them (the cell itself left out)."""
    near = halo.disc_mean(cells, band, radius)
    return near.select("row", "col", F.col("value").alias(band), (F.col("value") - F.col("mean")).alias(name))


def curvatures(window: DataFrame, res: float) -> DataFrame:
    """Profile, plan, tangential and further curvatures of a least-squares quadratic over the window."""
    z = _z()
    r = (z[1] + z[3] + z[4] + z[6] + z[7] + z[9] - 2 * (z[2] + z[5] + z[8])) / (3 * res * res)
    t = (z[1] + z[2] + z[3] + z[7] + z[8] + z[9] - 2 * (z[4] + z[5] + z[6])) / (3 * res * res)
    s = (z[3] + z[7] - z[1] - z[9]) / (4 * res * res)
    p = (z[3] + z[6] + z[9] - z[1] - z[4] - z[7]) / (6 * res)
    q = (z[1] + z[2] + z[3] - z[7] - z[8] - z[9]) / (6 * res)
    g = p * p + q * q
    along, across = p * p * r + 2 * p * q * s + q * q * t, q * q * r - 2 * p * q * s + p * p * t
    mean = -((1 + q * q) * r - 2 * p * q * s + (1 + p * p) * t) / (2 * F.pow(1 + g, F.lit(1.5)))
    gauss = (r * t - s * s) / F.pow(1 + g, F.lit(2.0))
    spread = F.sqrt(F.greatest(mean * mean - gauss, F.lit(0.0)))
    out = {
        "profile_curvature": -div(along, g * F.pow(1 + g, F.lit(1.5))),
        "plan_curvature": -div(across, F.pow(g, F.lit(1.5))),
        "tangential_curvature": -div(across, g * F.sqrt(1 + g)),
        "longitudinal_curvature": -2 * div(along, g),
        "cross_sectional_curvature": -2 * div(across, g),
        "general_curvature": -2 * (r + t),
        "mean_curvature": mean,
        "total_curvature": r * r + 2 * s * s + t * t,
        "minimal_curvature": mean - spread,
        "maximal_curvature": mean + spread,
    }
    return window.withColumns(out)


def vector_ruggedness(cells: DataFrame, window: DataFrame, res: float) -> DataFrame:
    """One less the length of the mean normal vector over the window."""
    east, north = gradients(res)
    size = F.sqrt(1 + east * east + north * north)
    n = window.select("row", "col", (-east / size).alias("nx"), (-north / size).alias("ny"), (1 / size).alias("nz"))
    m = halo.box_means(n, ["nx", "ny", "nz"])
    return m.select("row", "col", (1 - F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)).alias("vrm"))


def convergence(cells: DataFrame, window: DataFrame, res: float) -> DataFrame:
    """Mean angle between the neighbours' aspects and the direction to the cell, less 90 degrees."""
    return halo.convergence(slope_aspect(window, res).select("row", "col", "aspect").where("aspect is not null"), "aspect")


def landforms(cells: DataFrame, window: DataFrame, band: str, small: int, large: int, res: float) -> DataFrame:
    """Ten landforms from standardised position indices of two radii and the slope."""
    a = position_index(cells, band, small, "tpi_small").select("row", "col", "tpi_small")
    b = position_index(cells, band, large, "tpi_large").select("row", "col", "tpi_large")
    both = a.join(b, ["row", "col"]).join(slope_aspect(window, res).select("row", "col", "slope"), ["row", "col"])
    stats = both.agg(*[f(c).alias(f"{c}_{n}") for c in ("tpi_small", "tpi_large") for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    both = both.join(F.broadcast(stats))
    s, t = (div(F.col(c) - F.col(f"{c}_m"), F.col(f"{c}_s")) for c in ("tpi_small", "tpi_large"))
    kind = (
        F.when((s <= -1) & (t <= -1), "canyon")
        .when((s <= -1) & (t < 1), "midslope_drainage")
        .when(s <= -1, "upland_drainage")
        .when((s < 1) & (t <= -1), "u_valley")
        .when((s < 1) & (t < 1) & (F.col("slope") <= 5), "plain")
        .when((s < 1) & (t < 1), "open_slope")
        .when(s < 1, "upper_slope")
        .when(t <= -1, "local_ridge")
        .when(t < 1, "midslope_ridge")
        .otherwise("high_ridge")
    )
    return both.select("row", "col", kind.alias("landform"))


def diurnal_heat(window: DataFrame, res: float, alpha: float = 202.5) -> DataFrame:
    """Diurnal anisotropic heat: cosine of the aspect's distance to alpha times the slope."""
    done = slope_aspect(window, res)
    return done.withColumn("dah", F.cos(F.radians(F.lit(alpha) - F.coalesce("aspect", F.lit(0.0)))) * F.radians("slope"))
