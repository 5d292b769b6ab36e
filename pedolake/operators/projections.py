"""The interrupted homolosine projection and its inverse, and the inverse sinusoidal one, as column expressions.

The homolosine is sinusoidal up to some 41 degrees and Mollweide's beyond, each lobe about a meridian of its own.
Mollweide's auxiliary angle is found by a fixed number of Newton steps, folded over an array so that the expression
stays small. Distances are in metres on the sphere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import halo
from .cells import SPHERE

# Western bound, eastern bound and central meridian of each lobe in degrees, north and south; the
# latitude at which the parts meet (40 degrees 44 minutes 11.8 seconds), and the shift that makes them meet.
NORTH = ((-180.0, -40.0, -100.0), (-40.0, 180.0, 30.0))
SOUTH = ((-180.0, -100.0, -160.0), (-100.0, -20.0, -60.0), (-20.0, 80.0, 20.0), (80.0, 180.0, 140.0))
MEETING = 40.0 + 44.0 / 60.0 + 11.8 / 3600.0
SHIFT = 0.0528035274542

#: Newton steps; next to a pole each halves the error only.
STEPS = 60


def _lobe(lon: Column, north: Column) -> Column:
    """Central meridian of the lobe that a longitude (or an abscissa in degrees) lies in."""

    def of(lobes) -> Column:
        out = F.lit(lobes[-1][2])
        for _, east, middle in reversed(lobes[:-1]):
            out = F.when(lon < east, F.lit(middle)).otherwise(out)
        return out

    return F.when(north, of(NORTH)).otherwise(of(SOUTH))


def _within(lon: Column, north: Column, middle: Column) -> Column:
    """Whether a longitude lies in its lobe, a hair's breadth aside."""
    ok = F.lit(False)
    for side, lobes in ((north, NORTH), (~north, SOUTH)):
        for west, east, at in lobes:
            ok = ok | (side & (middle == at) & lon.between(west - 1e-9, east + 1e-9))
    return ok


def auxiliary(lat: Column) -> Column:
    """Twice Mollweide's angle of a latitude in radians."""
    goal = F.lit(math.pi) * F.sin(lat)

    def step(p: Column, _: Column) -> Column:
        slope = 1 + F.cos(p)
        return F.when(slope < 1e-14, p).otherwise(p - (p + F.sin(p) - goal) / slope)

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), lat, step)


def homolosine(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Coordinates of degrees."""
    north, phi = lat >= 0, F.radians(lat)
    middle = _lobe(lon, north)
    away, base = F.radians(lon - middle), F.radians(middle)
    theta = auxiliary(phi) / 2
    low = F.abs(lat) <= MEETING
    x = base + F.when(low, away * F.cos(phi)).otherwise(away * F.cos(theta) * (2 * math.sqrt(2) / math.pi))
    y = F.when(low, phi).otherwise(math.sqrt(2) * F.sin(theta) - F.signum(lat) * SHIFT)
    return x * SPHERE, y * SPHERE


def inverse_homolosine(x: Column, y: Column) -> tuple[Column, Column]:
    """Degrees of coordinates; null between the lobes and beyond the poles."""
    u, v = x / SPHERE, y / SPHERE
    north = v >= 0
    middle = _lobe(F.degrees(u), north)
    away = u - F.radians(middle)
    sine = (F.abs(v) + SHIFT) / math.sqrt(2)
    theta = F.asin(F.least(sine, F.lit(1.0)))
    low = F.abs(v) <= math.radians(MEETING)
    lat = F.when(low, v).otherwise(F.signum(v) * F.asin((2 * theta + F.sin(2 * theta)) / math.pi))
    lon = middle + F.degrees(F.when(low, F.try_divide(away, F.cos(v))).otherwise(F.try_divide(away * math.pi, 2 * math.sqrt(2) * F.cos(theta))))
    ok = _within(lon, north, middle) & (low | (sine <= 1.0))
    return F.when(ok, lon), F.when(ok, F.degrees(lat))


def inverse_sinusoidal(x: Column, y: Column) -> tuple[Column, Column]:
    """Degrees of sinusoidal coordinates; null beyond the edge of the map."""
    phi = y / SPHERE
    lon = F.degrees(F.try_divide(x / SPHERE, F.cos(phi)))
    ok = (F.abs(phi) <= math.pi / 2) & (F.abs(lon) <= 180.0 + 1e-9)
    return F.when(ok, lon), F.when(ok, F.degrees(phi))


def corners(layer: DataFrame) -> DataFrame:
    """Of each place (row, col) with any cell among it, the next one to the right and the two below: their values z00 ... z11."""

    def compute(t: halo.Tile | halo.Listed) -> dict:
        if isinstance(t, halo.Listed):
            t = t.spread([(-1, -1), (-1, 0), (0, -1)])
        z = {f"z{a}{b}": t.view(t.bands["value"], a, b) for a in (0, 1) for b in (0, 1)}
        there = ~(z["z00"] != z["z00"]) | ~(z["z01"] != z["z01"]) | ~(z["z10"] != z["z10"]) | ~(z["z11"] != z["z11"])
        return halo.picked(t, there, z)

    return halo.by_tile(layer, ["value"], 1, compute, "row int, col int, z00 double, z01 double, z10 double, z11 double")


def reproject_bilinear(spark, layer: DataFrame, own, target, back) -> DataFrame:
    """A layer (row, col, value) on a grid of another coordinate system, bilinear in the layer's cells; missing neighbours
    take no weight. Each target cell meets one row, which has its four neighbours."""
    ids = spark.range(target.n_rows * target.n_cols)
    r, c = F.floor(F.col("id") / target.n_cols).cast("int"), (F.col("id") % target.n_cols).cast("int")
    x, y = back(target.xmin + (F.col("c") + 0.5) * target.res, target.ymax - (F.col("r") + 0.5) * target.res)
    at = ids.select(r.alias("r"), c.alias("c")).select("r", "c", ((own.ymax - y) / own.res - 0.5).alias("u"), ((x - own.xmin) / own.res - 0.5).alias("v"))
    at = at.where("u is not null and v is not null").withColumns({"row": F.floor("u").cast("int"), "col": F.floor("v").cast("int")})
    near = at.join(corners(layer), ["row", "col"])
    parts = [(F.col(f"z{a}{b}"), (1 - F.abs(F.col("u") - F.col("row") - a)) * (1 - F.abs(F.col("v") - F.col("col") - b))) for a in (0, 1) for b in (0, 1)]
    total = sum((F.coalesce(z * w, F.lit(0.0)) for z, w in parts), F.lit(0.0))
    weight = sum((F.when(z.isNotNull(), w).otherwise(0.0) for z, w in parts), F.lit(0.0))
    return near.select(F.col("r").alias("row"), F.col("c").alias("col"), total.alias("a"), weight.alias("b")).where("b > 0").select("row", "col", (F.col("a") / F.col("b")).alias("value"))
