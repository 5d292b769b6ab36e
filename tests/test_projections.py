"""Round trips of the homolosine and the sinusoidal projection, known places, and gaps between lobes."""

import math

import pytest
from pyspark.sql import functions as F

from pedolake.operators import projections as pr
from pedolake.operators.cells import SPHERE, sinusoidal


@pytest.mark.parametrize("there, back", [(pr.homolosine, pr.inverse_homolosine), (sinusoidal, pr.inverse_sinusoidal)])
def test_round_trip_under_a_millimetre(spark, there, back):
    lons = [-179.99, -100.5, -100.0, -60.0, -40.1, -40.0, -20.0, 0.0, 12.345, 79.9, 80.0, 140.0, 179.9]
    lats = [-89.5, -75.0, -40.74, -40.73, -10.0, -1e-7, 0.0, 5.0, 40.7366, 40.7367, 60.0, 88.0]
    df = spark.createDataFrame([(a, b) for a in lons for b in lats], "lon double, lat double")
    x, y = there(F.col("lon"), F.col("lat"))
    lon, lat = back(F.col("x"), F.col("y"))
    for r in df.select("*", x.alias("x"), y.alias("y")).select("*", lon.alias("lon2"), lat.alias("lat2")).collect():
        metres = SPHERE * math.radians(1)
        assert abs(r["lat2"] - r["lat"]) * metres < 1e-3, r
        assert abs(r["lon2"] - r["lon"]) * metres * math.cos(math.radians(r["lat"])) < 1e-3, r


def test_known_places(spark):
    """Lobes' meridians keep their place, the parts meet, and the pole is where its parallel ends."""
    df = spark.createDataFrame([(30.0, 50.0), (-100.0, 10.0), (20.0, -60.0), (50.0, pr.MEETING - 1e-9), (50.0, pr.MEETING + 1e-9), (30.0, 90.0)], "lon double, lat double")
    x, y = pr.homolosine(F.col("lon"), F.col("lat"))
    a, b, c, low, high, pole = [tuple(r) for r in df.select(x, y).collect()]
    assert a[0] == pytest.approx(math.radians(30) * SPHERE) and b == pytest.approx((math.radians(-100) * SPHERE, math.radians(10) * SPHERE)) and c[0] == pytest.approx(math.radians(20) * SPHERE)
    assert low == pytest.approx(high, abs=0.5)
    assert pole[1] == pytest.approx((math.sqrt(2) - pr.SHIFT) * SPHERE, rel=1e-6)


def test_nothing_between_the_lobes(spark):
    x = (math.radians(-100) + 0.01) * SPHERE  # at 60 degrees south the lobe about -60 does not reach so far west
    df = spark.createDataFrame([(x, -1.1 * SPHERE), (0.0, 1.5 * SPHERE), (0.0, 0.0)], "x double, y double")
    lon, lat = pr.inverse_homolosine(F.col("x"), F.col("y"))
    got = [tuple(r) for r in df.select(lon, lat).collect()]
    assert got[:2] == [(None, None)] * 2 and got[2] == pytest.approx((0.0, 0.0), abs=1e-12)
