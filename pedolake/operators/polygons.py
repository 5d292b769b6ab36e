"""Points in polygons of any rings (holes, several parts), by a hierarchical covering of cells.

A polygon is an array of closed rings; what an odd number of rings encloses is inside, so holes and parts need no
marks, and points on a ring belong to the polygon, as an intersection test counts them (a ring of one point has none). Square cells, whose sides
are powers of two on one grid, are halved where a ring passes through them, ``DEPTH`` times at most: inner cells
need no test, border cells carry the edges that a test of their points can depend on (those at their height, not
wholly to their left), outer cells go. Points meet cells by an equality of level and place, and each point meets
at most one cell of a polygon.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scratch import written

#: Halvings of a polygon's largest cells, and edges of a border cell that is not halved further.
DEPTH, FEW = 7, 8
_EDGE = ("x1", "y1", "x2", "y2")


def edges_of(rings) -> np.ndarray:
    """Rows (x1, y1, x2, y2) of all rings, closed."""
    out = []
    for ring in rings if rings is not None else []:
        p = np.array([(q["x"], q["y"]) for q in ring], float).reshape(-1, 2)
        if len(p):
            out.append(np.hstack((p, np.roll(p, -1, axis=0))))
    e = np.concatenate(out) if out else np.zeros((0, 4))
    return e[(e[:, :2] != e[:, 2:]).any(1)]


def _touched(e: np.ndarray, x0: float, y0: float, side: float) -> np.ndarray:
    """Edges that meet the closed cell (or at least come as near as its corners tell)."""
    x1, y1, x2, y2 = e.T
    box = (np.minimum(x1, x2) <= x0 + side) & (np.maximum(x1, x2) >= x0) & (np.minimum(y1, y2) <= y0 + side) & (np.maximum(y1, y2) >= y0)
    turn = np.stack([(x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) for x in (x0, x0 + side) for y in (y0, y0 + side)])
    return box & ~((turn > 0).all(0) | (turn < 0).all(0))


def _holds(e: np.ndarray, x: float, y: float) -> bool:
    x1, y1, x2, y2 = e[(e[:, 1] > y) != (e[:, 3] > y)].T
    return bool(np.count_nonzero(x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) % 2)


def covering(rings, depth: int = DEPTH) -> list[tuple[int, int, int, bool, np.ndarray]]:
    """Cells (level, column, row, inner, edges) of a polygon; the side of a level is 2**level."""
    e = edges_of(rings)
    if not len(e) or not np.isfinite(e).all():
        return []
    low, high = np.minimum(e[:, :2], e[:, 2:]).min(0), np.maximum(e[:, :2], e[:, 2:]).max(0)
    level = math.ceil(math.log2(max(float((high - low).max()), 2.0**-40)))
    span = [range(math.floor(a / 2.0**level), math.floor(b / 2.0**level) + 1) for a, b in zip(low, high, strict=True)]
    out, todo = [], [(level, i, j, e) for i in span[0] for j in span[1]]
    while todo:
        at, i, j, near = todo.pop()
        side = 2.0**at
        x0, y0 = i * side, j * side
        near = near[_touched(near, x0, y0, side)]
        if not len(near):
            if _holds(e, x0 + side / 2, y0 + side / 2):
                out.append((at, i, j, True, e[:0]))
        elif at > level - depth and len(near) > 0 and (len(near) > FEW or at > level - 2):
            todo += [(at - 1, 2 * i + a, 2 * j + b, near) for a in (0, 1) for b in (0, 1)]
        else:
            strip = (np.minimum(e[:, 1], e[:, 3]) <= y0 + side) & (np.maximum(e[:, 1], e[:, 3]) >= y0) & (np.maximum(e[:, 0], e[:, 2]) >= x0)
            out.append((at, i, j, False, e[strip]))
    return out


def cells_of(polygons: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Cells of polygons (rings: array of arrays of struct<x, y>): all other columns, level, cx, cy, inner, edges."""
    others = [c for c in polygons.columns if c != "rings"]
    edge = T.StructType([T.StructField(x, T.DoubleType()) for x in _EDGE])
    kinds = {"level": T.IntegerType(), "cx": T.LongType(), "cy": T.LongType(), "inner": T.BooleanType(), "edges": T.ArrayType(edge)}
    schema = T.StructType([polygons.schema[c] for c in others] + [T.StructField(n, k) for n, k in kinds.items()])

    shape = pa.list_(pa.struct([(x, pa.float64()) for x in _EDGE]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                cells = covering(batch.column("rings")[k].as_py(), depth)
                if cells:
                    at = pa.array([k] * len(cells))
                    level, cx, cy, inner, edges = zip(*cells, strict=True)
                    lists = pa.array([[dict(zip(_EDGE, x, strict=True)) for x in e.tolist()] for e in edges], shape)
                    made = [*(batch.column(c).take(at) for c in others), pa.array(level, pa.int32()), pa.array(cx, pa.int64()), pa.array(cy, pa.int64()), pa.array(inner), lists]
                    yield pa.record_batch(made, names=schema.fieldNames())

    return polygons.select(*others, "rings").mapInArrow(cut, schema)


def intersects(x: Column, y: Column, edges: Column) -> Column:
    """Whether an odd number of edges is passed to the right of a point, or it lies on one."""

    def crossed(e: Column) -> Column:
        over = (e["y1"] > y) != (e["y2"] > y)
        return over & (x < F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"]) + e["x1"])

    def on(e: Column) -> Column:
        between = x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
        return between & ((e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"]))

    return (F.size(F.filter(edges, crossed)) % 2 == 1) | F.exists(edges, on)


def points_in_polygons(points: DataFrame, polygons: DataFrame, keep_all: bool = True, depth: int = DEPTH) -> DataFrame:
    """Points (x, y) with the columns of each polygon that they meet; those in none have nulls, if all are kept.

    A point without coordinates is in no polygon; polygons may overlap."""
    cells = cells_of(polygons, depth)
    levels = [r["level"] for r in cells.select("level").distinct().collect()]  # a hundred at most
    # numbers are written: made twice, they could differ
    placed = written(points.withColumn("__point", F.monotonically_increasing_id()), "points") if keep_all else points
    looked = placed.withColumn("level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    side = F.pow(F.lit(2.0), F.col("level"))
    looked = looked.withColumn("cx", F.floor(F.col("x") / side)).withColumn("cy", F.floor(F.col("y") / side))
    found = looked.join(cells, ["level", "cx", "cy"]).where(F.col("inner") | intersects(F.col("x"), F.col("y"), F.col("edges")))
    found = found.drop("level", "cx", "cy", "inner", "edges")
    if not keep_all:
        return found
    return placed.join(found.select("__point", *[c for c in found.columns if c not in placed.columns]), "__point", "left").drop("__point")


def points_to_class(points: DataFrame, polygons: DataFrame, na: bool = True) -> DataFrame:
    """Points of each class of polygons (rings, class_name); those in none count as a null class if na."""
    return points_in_polygons(points, polygons.select("rings", "class_name"), na).groupBy("class_name").agg(F.count(F.lit(1)).alias("n_points"))
