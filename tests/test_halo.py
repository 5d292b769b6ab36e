"""Windows by tiles against plain loops: edges of tiles, holes, far and negative cells, every function and kernel."""

import math

import numpy as np
import pyarrow as pa
import pytest

from pedolake.operators import cells, halo, projections


@pytest.fixture(scope="module")
def grid(spark):
    """A grid with holes, missing values, negative places and a lone cell far away."""
    rng = np.random.default_rng(9)
    at = {(r, c): float(rng.normal(100, 10)) for r in range(-5, 14) for c in range(-3, 17) if rng.random() > 0.15}
    held = {k: None if rng.random() < 0.2 else v for k, v in at.items()} | {(5000, -7000): 3.0}
    df = spark.createDataFrame([(r, c, v) for (r, c), v in held.items()], "row int, col int, v double").repartition(3)
    return held, df


def near(held, r, c, offsets):
    return [held[(r + a, c + b)] for a, b in offsets if held.get((r + a, c + b)) is not None]


SQUARE = lambda h: [(a, b) for a in range(-h, h + 1) for b in range(-h, h + 1)]


def got(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


@pytest.mark.parametrize("size", [2, 4, 128])
def test_complete_windows(grid, size):
    held, df = grid
    rows = got(halo.surrounding(df, "v", size), "row", "col")
    want = {k: near(held, *k, SQUARE(1)) for k in held if len(near(held, *k, SQUARE(1))) == 9}
    assert {k: [r[f"z{i}"] for i in range(1, 10)] for k, r in rows.items()} == want and want


@pytest.mark.parametrize("how, plain", [("avg", np.mean), ("sum", np.sum), ("min", np.min), ("max", np.max), ("median", np.median)])
@pytest.mark.parametrize("size", [5, 128])
def test_focal_functions(grid, how, plain, size):
    held, df = grid
    rows = got(halo.focal(df, "v", 5, how, size), "row", "col")
    want = {k: plain(n) for k, v in held.items() if v is None and (n := near(held, *k, SQUARE(2)))}
    assert set(rows) == set(want) and all(rows[k]["value"] == pytest.approx(v, rel=1e-13) for k, v in want.items())


@pytest.mark.parametrize("radius, size", [(1, 3), (3, 4), (7, 128)])
def test_disc_means(grid, radius, size):
    held, df = grid
    disc = [(a, b) for a, b in SQUARE(radius) if 0 < a * a + b * b <= radius * radius]
    rows = got(halo.disc_mean(df, "v", radius, size), "row", "col")
    want = {k: np.mean(n) for k, v in held.items() if v is not None and (n := near(held, *k, disc))}
    assert set(rows) == set(want) and all(rows[k]["mean"] == pytest.approx(v, rel=1e-12) and rows[k]["value"] == held[k] for k, v in want.items())


@pytest.mark.parametrize("factor", [0.4, 1.0, 2.5, 6.0])
@pytest.mark.parametrize("kernel", ["bilinear", "cubic", "cubicspline", "lanczos"])
def test_kernels(grid, factor, kernel):
    held, df = grid
    held, df = {k: v for k, v in held.items() if abs(k[0]) < 100}, df.where("abs(row) < 100")
    weight, side = (lambda t: max(1 - t, 0.0), 1) if kernel == "bilinear" else cells.KERNELS[kernel]
    least = 0.0 if kernel == "bilinear" else 1e-6
    want = {}
    for r, c in {(math.floor(a / factor), math.floor(b / factor)) for a, b in held}:
        u, v = (r + 0.5) * factor - 0.5, (c + 0.5) * factor - 0.5
        total = n = 0.0
        for a in range(math.floor(u) + 1 - side, math.floor(u) + side + 1):
            for b in range(math.floor(v) + 1 - side, math.floor(v) + side + 1):
                if held.get((a, b)) is not None:
                    w = float(weight(np.float64(abs(u - a)))) * float(weight(np.float64(abs(v - b))))
                    total, n = total + w * held[(a, b)], n + w
        if n > least + 1e-12:
            want[(r, c)] = total / n
    out = cells.resample_bilinear(df, "v", factor) if kernel == "bilinear" else cells.resample_kernel(df, "v", factor, kernel)
    rows = got(out, "r", "c")
    assert set(rows) == set(want) and all(rows[k]["value"] == pytest.approx(v, rel=1e-9) for k, v in want.items())


def test_wrong_names_are_refused(grid):
    with pytest.raises(ValueError):
        halo.focal(grid[1], "v", 3, "speed")
    with pytest.raises(ValueError):
        cells.resample_kernel(grid[1], "v", 2.0, "box")


def test_cells_travel_once(grid):
    """One exchange, no join, and one row for each tile reaches the arrays."""
    plan = halo.surrounding(grid[1], "v")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert halo.tiled(grid[1], ["v"], 1, 128).count() == 5  # four around the origin, and the lone cell


def test_empty_table(spark):
    none = spark.createDataFrame([], "row int, col int, v double")
    assert halo.surrounding(none, "v").collect() == halo.disc_mean(none, "v", 2).collect() == cells.resample_bilinear(none, "v", 2.0).collect() == []


def test_nearly_empty_grids_cost_their_cells_only(spark):
    """Cells far apart: what is held is a place for each cell, not for each place of its tile."""
    df = spark.createDataFrame([(1000 * i + 64, 777 * i * i, float(i)) for i in range(60)], "row int, col int, v double")

    def held(t):
        return {"row": np.array([0]), "col": np.array([0]), "value": np.array([float(t.here.size)])}

    rows = halo.by_tile(df, ["v"], 3, held, "row int, col int, value double").collect()
    assert sum(r["value"] for r in rows) < 1000


def test_full_and_nearly_empty_tiles_agree(spark):
    """The same cells in full tiles and, spread over a larger grid, as lists of cells."""
    rng = np.random.default_rng(4)
    at = [(r, c, None if rng.random() < 0.2 else float(rng.normal())) for r in range(40) for c in range(40) if rng.random() > 0.1]
    df = spark.createDataFrame(at, "row int, col int, v double")
    for make, keys, values in ((lambda n: halo.focal(df, "v", 3, "avg", n), ("row", "col"), ["value"]), (lambda n: halo.disc_mean(df, "v", 4, n), ("row", "col"), ["value", "mean"]), (lambda n: halo.resampled(df, "v", 2.5, cells.lanczos_weight, 3, 1e-6, n), ("r", "c"), ["value"])):
        full, few = got(make(16), *keys), got(make(512), *keys)
        assert set(full) == set(few) and full
        assert all(full[k][v] == pytest.approx(few[k][v], rel=1e-12, abs=1e-12) for k in full for v in values)


def test_thin_cells_travel_as_rows(grid):
    """No lists are gathered before or after the exchange: cells are ordered by one number for their tile."""
    plan = halo.resampled(grid[1], "v", 2.5, cells.lanczos_weight, 3, 1e-6)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Sort [tile#" in plan and plan.count("Exchange hashpartitioning") == 1


def test_tiles_go_on_in_later_batches(spark, monkeypatch):
    """Tiles cut by batches come out whole, whatever the cells at once, in negative and far places too."""
    rng = np.random.default_rng(5)
    at = sorted({(r, c) for r, c in rng.integers(-40, 40, (900, 2)).tolist()} | {(-(2**31) + 400, 2**31 - 400), (2**31 - 400, -(2**31) + 400)})
    df = spark.createDataFrame([(r, c, float(i)) for i, (r, c) in enumerate(at)] + [(None, 3, 1.0), (3, None, 2.0)], "row long, col long, v double")
    one = [r.asDict() for r in halo.sorted_cells(df.coalesce(1), ["v"], 2, 16).coalesce(1).sortWithinPartitions("tile").collect()]
    rows = pa.Table.from_pylist(one, pa.schema([("tile", pa.int64()), ("row", pa.int32()), ("col", pa.int32()), ("v0", pa.float64())]))
    want = {}
    for (r, c), i in zip(at, range(len(at)), strict=True):
        for t in {((r + a) // 16, (c + b) // 16) for a in (-2, 2) for b in (-2, 2)}:
            want.setdefault(t, set()).add((r, c, float(i)))
    for at_once, batch in ((1, 1), (50, 7), (300, 1000), (1 << 18, 13)):
        monkeypatch.setattr(halo, "AT_ONCE", at_once)
        out = [r for b in halo.packed(iter(rows.to_batches(max_chunksize=batch))) for r in b.to_pylist()]
        assert len(out) == len(want)
        assert {(r["tr"], r["tc"]): {(x["row"], x["col"], x["v0"]) for x in r["cells"]} for r in out} == want
    assert {(r["tr"], r["tc"]): {(x["row"], x["col"], x["v0"]) for x in r["cells"]} for r in halo.tiled(df, ["v"], 2, 16).collect()} == want


def test_corners_need_no_cell_at_their_place(grid):
    """Each place with a value at it, to its right or below it has a row, in tiles of few cells as well."""
    held, df = grid
    rows = got(projections.corners(df.withColumnRenamed("v", "value")), "row", "col")
    there = {k: v for k, v in held.items() if v is not None}
    places = {(r - a, c - b) for r, c in there for a in (0, 1) for b in (0, 1)}
    want = {(r, c): [there.get((r + a, c + b)) for a in (0, 1) for b in (0, 1)] for r, c in places}
    assert {k: [r[f"z{a}{b}"] for a in (0, 1) for b in (0, 1)] for k, r in rows.items()} == want and len(want) > len(there)
