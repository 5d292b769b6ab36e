"""Coverings against an exact test in fractions: holes, parts, shared borders, points on edges and corners."""

from fractions import Fraction as Q

import numpy as np
import pytest

from pedolake.operators import polygons

SCHEMA = "poly_id int, class_name string, rings array<array<struct<x:double,y:double>>>"


def exact(rings, x, y):
    """Inside an odd number of rings, or on one."""
    odd, x, y = False, Q(x), Q(y)
    for ring in rings or []:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (x1, y1) == (x2, y2):
                continue  # a ring that is one point holds nothing
            x1, y1, x2, y2 = map(Q, (x1, y1, x2, y2))
            if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return True
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


@pytest.mark.parametrize("depth", [1, 4, 7])
def test_as_exact(spark, depth):
    rng = np.random.default_rng(12)
    star = [(round(40 + r * np.cos(t)), round(40 + r * np.sin(t))) for t, r in zip(np.linspace(0, 2 * np.pi, 90, endpoint=False), 25 + 10 * rng.random(90))]
    shapes = [
        [[(0, 0), (16, 0), (16, 16), (0, 16)], [(4, 4), (12, 4), (12, 12), (4, 12)], [(6, 6), (10, 6), (8, 9)]],  # a hole with an island
        [[(16, 0), (30, 5), (16, 16)], [(-9, -9), (-2, -9), (-5, -1)]],  # a shared border, a second part
        [star],
        [[(50, 50), (51, 50), (51, 51)]],
        [[(0, 0), (0, 0)]], [], None,
    ]
    rows = [(i, "abc"[i % 3], None if s is None else [[(float(x), float(y)) for x, y in r] for r in s]) for i, s in enumerate(shapes)]
    at = [(float(x), float(y)) for x in range(-10, 32) for y in range(-10, 20)] + [tuple(p) for p in (rng.integers(-40, 320, (400, 2)) / 4).tolist()] + [(float(x), float(y)) for x, y in star]
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(at)] + [(-1, None, 1.0)], "id int, x double, y double").repartition(3)
    got = {(r["id"], r["poly_id"]) for r in polygons.points_in_polygons(points, spark.createDataFrame(rows, SCHEMA), depth=depth).collect()}
    want = {(i, k) for i, (x, y) in enumerate(at) for k, s in enumerate(shapes) if exact(s, x, y)}
    want |= {(i, None) for i in range(-1, len(at)) if not any(i == j for j, _ in want)}
    assert got == want


def test_cells_are_apart_and_most_points_need_no_test():
    ring = [{"x": 500 * np.cos(t), "y": 500 * np.sin(t)} for t in np.linspace(0, 2 * np.pi, 2000, endpoint=False)]
    cells = polygons.covering([ring])
    area = sum(4.0 ** c[0] for c in cells if c[3])
    assert 0.9 * np.pi * 500**2 < area < np.pi * 500**2 and len(cells) < 1500
    assert max(len(c[4]) for c in cells) < 200  # of 2,000 edges
    places = {(lv, i, j) for lv, i, j, *_ in cells}
    assert all((lv + up, i >> up, j >> up) not in places for lv, i, j in places for up in range(1, 9))


def test_classes(spark):
    square = lambda x: [[(x, 0.0), (x + 1.0, 0.0), (x + 1.0, 1.0), (x, 1.0)]]
    shapes = spark.createDataFrame([(1, "a", square(0.0)), (2, "b", square(1.0)), (3, "b", square(5.0))], SCHEMA)
    points = spark.createDataFrame([(1.0, 0.5), (0.5, 0.5), (5.0, 1.0), (9.0, 9.0)], "x double, y double")
    of = lambda na: {r["class_name"]: r["n_points"] for r in polygons.points_to_class(points, shapes, na).collect()}
    assert of(True) == {"a": 2, "b": 2, None: 1} and of(False) == {"a": 2, "b": 2}
