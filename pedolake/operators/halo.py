"""Neighbourhoods by tiles with a halo.

Cells are packed into square tiles, one row each; a cell near an edge is also packed into the tiles beyond it, so
every tile has the strip of its neighbours that its windows reach into. Cells travel once (the halo adds some
4 * reach / size to them, and no window is a join), as plain rows in the order of one number for their tile, which is
cheaper than lists where tiles have few cells; they are packed where they arrive. Windows are array operations: shifted views,
running sums along rows for wide windows, and products with kernel matrices for resampling. Tiles of few cells are worked on
together as lists of cells (see ``Listed``), so a grid that is nearly empty costs no more than its cells. A tile holds at
most (size + 2 * reach)**2 cells. Cells that are not in the table, null and NaN are missing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows and columns of a tile's inner part; cells of a tile below one in so many places are worked on as a list; places and
#: cells at once.
SIZE, SPARSE, AT_ONCE = 128, 32, 1 << 18


@dataclass(frozen=True)
class Tile:
    """Arrays of a tile: its first inner row and column, bands with halo (NaN where missing), and which cells exist."""

    row: int
    col: int
    size: int
    reach: int
    bands: dict[str, np.ndarray]
    here: np.ndarray

    def view(self, a: np.ndarray, dr: int = 0, dc: int = 0) -> np.ndarray:
        """The inner part, shifted."""
        h = self.reach
        return a[h + dr : h + dr + self.size, h + dc : h + dc + self.size]


class Listed:
    """Tiles of few cells side by side, as lists of cells: what is computed from views alone runs on them as on a tile.

    Arrays have an element for each cell, halo included, and one more for a place without a cell; a view has an element for
    each inner cell, so the work grows with the cells and not with the tiles' places."""

    def __init__(self, tile: np.ndarray, row: np.ndarray, col: np.ndarray, first_row: np.ndarray, first_col: np.ndarray, size: int, reach: int, bands: dict[str, np.ndarray]):
        self.size, self.reach, self.side = size, reach, size + 2 * reach
        i, j = row - first_row + reach, col - first_col + reach
        key = (tile * self.side + i) * self.side + j
        order = np.argsort(key, kind="stable")
        order = order[np.append(key[order][1:] != key[order][:-1], True)]  # of equal places the last
        self.key, i, j = key[order], i[order], j[order]
        self.tile, self.rows, self.cols, self.first_row, self.first_col = (x[order] for x in (tile, row, col, first_row, first_col))
        self.bands = {b: np.append(v[order], np.nan) for b, v in bands.items()}
        self.here = np.append(np.ones(len(order), bool), False)
        self.inner = np.flatnonzero((i >= reach) & (i < reach + size) & (j >= reach) & (j < reach + size))
        self.places: dict[tuple[int, int], np.ndarray] = {(0, 0): self.inner}

    def view(self, a: np.ndarray, dr: int = 0, dc: int = 0) -> np.ndarray:
        """The cells at this distance from the inner ones."""
        at = self.places.get((dr, dc))
        if at is None:
            wanted = self.key[self.inner] + dr * self.side + dc
            at = np.searchsorted(self.key, wanted)
            at[self.key[np.minimum(at, len(self.key) - 1)] != wanted] = len(self.key)
            if max(abs(dr), abs(dc)) == 1:
                self.places[dr, dc] = at
        return a[at]

    def spread(self, steps: Sequence[tuple[int, int]]) -> Listed:
        """The same tiles, where places at these distances from a cell that hold none are cells without values: what is
        computed of a place from its neighbours needs no cell at the place itself."""
        out = [np.concatenate([x + s[k] for s in steps] + [x]) for k, x in enumerate((self.rows, self.cols))]
        tile, first_row, first_col = (np.tile(x, len(steps) + 1) for x in (self.tile, self.first_row, self.first_col))
        i, j = out[0] - first_row + self.reach, out[1] - first_col + self.reach
        ok = (i >= 0) & (i < self.side) & (j >= 0) & (j < self.side)
        empty = np.full(len(self.rows) * len(steps), np.nan)  # before the cells, as of equal places the last is kept
        bands = {b: np.append(empty, v[:-1])[ok] for b, v in self.bands.items()}
        wide = Listed(tile[ok], out[0][ok], out[1][ok], first_row[ok], first_col[ok], self.size, self.reach, bands)
        wide.here = np.append(np.isin(wide.key, self.key), False)
        return wide


Compute = Callable[[Tile | Listed], dict[str, np.ndarray]]


def sorted_cells(cells: DataFrame, bands: Sequence[str], reach: int, size: int) -> DataFrame:
    """Rows (tile, row, col, v0, v1 ...) in the order of their tiles, each tile in one task; size is at least 2 * reach."""

    def key(at_row: int, at_col: int) -> Column:
        return F.floor((F.col("row") + at_row) / size) * F.lit(1 << 32) + F.floor((F.col("col") + at_col) / size)

    values = [F.col(b).cast("double").alias(f"v{k}") for k, b in enumerate(bands)]
    rows = cells.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *values)
    corners = F.array_distinct(F.array(*[key(a, b) for a in (-reach, reach) for b in (-reach, reach)]))
    tiles = F.when(key(-reach, -reach) == key(reach, reach), F.array(key(reach, reach))).otherwise(corners)  # most cells are in one
    dealt = rows.select(F.explode(tiles).alias("tile"), *rows.columns)
    return dealt.where("tile is not null").repartition("tile").sortWithinPartitions("tile")


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each tile (tr, tc, cells) of rows in the order of their tiles, some AT_ONCE cells at a time."""

    def lists(rows: pa.RecordBatch) -> pa.RecordBatch:
        tile = rows.column("tile").to_numpy()
        starts = np.append(0, np.flatnonzero(tile[1:] != tile[:-1]) + 1)
        tr = (tile[starts] + (1 << 31)) >> 32
        own = pa.StructArray.from_arrays(rows.columns[1:], names=rows.schema.names[1:])
        cells = pa.ListArray.from_arrays(pa.array(np.append(starts, len(tile)).astype(np.int32)), own)
        return pa.record_batch([pa.array(x.astype(np.int32)) for x in (tr, tile[starts] - (tr << 32))] + [cells], names=["tr", "tc", "cells"])

    held, n, enough = [], 0, AT_ONCE
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= enough:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            tile = rows.column("tile").to_numpy()
            last = int(np.searchsorted(tile, tile[-1]))  # the last tile may go on in the next batch
            if last:
                yield lists(rows.slice(0, last))
            held, n = [rows.slice(last)], n - last
            enough = max(AT_ONCE, 2 * n)
    if n:
        yield lists(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def tiled(cells: DataFrame, bands: Sequence[str], reach: int, size: int) -> DataFrame:
    """One row per tile: tr, tc, cells (structs of row, col and v0, v1 ...)."""
    fields = ", ".join(["row: int", "col: int", *[f"v{k}: double" for k in range(len(bands))]])
    return sorted_cells(cells, bands, reach, size).mapInArrow(packed, f"tr int, tc int, cells array<struct<{fields}>>")


def by_tile(cells: DataFrame, bands: Sequence[str], reach: int, compute: Compute, schema: str, size: int = SIZE) -> DataFrame:
    """Runs compute on each tile of cells (row, col, bands): it returns columns of the schema; NaN becomes null."""
    size = max(size, 2 * reach)
    names, kinds = zip(*(f.strip().split(" ") for f in schema.split(",")), strict=True)

    def made(out: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        columns = [pa.array(out[n].astype(np.int32)) if k == "int" else pa.array(out[n], pa.float64(), from_pandas=True) for n, k in zip(names, kinds, strict=True)]
        if len(columns[0]):
            yield pa.record_batch(columns, names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = size + 2 * reach
        for batch in packed(batches):
            first_row, first_col = (batch.column(c).to_numpy().astype(np.int64) * size for c in ("tr", "tc"))
            lists = batch.column("cells")
            flat, counts = lists.flatten(), lists.value_lengths().to_numpy()
            ends = np.append(0, np.cumsum(counts))
            column = lambda name: flat.field(name).to_numpy(zero_copy_only=False)
            rows, cols, values = column("row").astype(np.int64), column("col").astype(np.int64), [column(f"v{k}").astype(np.float64) for k in range(len(bands))]
            few = counts * SPARSE < side * side
            for t in np.flatnonzero(~few):
                own = slice(ends[t], ends[t + 1])
                at = (rows[own] - first_row[t] + reach, cols[own] - first_col[t] + reach)
                here = np.zeros((side, side), bool)
                here[at] = True
                held = {}
                for b, v in zip(bands, values, strict=True):
                    held[b] = np.full((side, side), np.nan)
                    held[b][at] = v[own]
                yield from made(compute(Tile(int(first_row[t]), int(first_col[t]), size, reach, held, here)))
            of_few = np.flatnonzero(few)
            for part in np.split(of_few, np.flatnonzero(np.diff(np.cumsum(counts[of_few]) // AT_ONCE)) + 1):
                if counts[part].sum():
                    tile = np.repeat(np.arange(len(part)), counts[part])
                    own = np.arange(len(tile)) + np.repeat(ends[part] - np.append(0, np.cumsum(counts[part])[:-1]), counts[part])
                    yield from made(compute(Listed(tile, rows[own], cols[own], first_row[part][tile], first_col[part][tile], size, reach, {b: v[own] for b, v in zip(bands, values, strict=True)})))

    return sorted_cells(cells, bands, reach, size).mapInArrow(run, schema)


def picked(tile: Tile | Listed, mask: np.ndarray, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Rows of the inner cells of a mask."""
    if isinstance(tile, Listed):
        at = tile.inner[mask]
        return {"row": tile.rows[at], "col": tile.cols[at]} | {n: a[mask] for n, a in columns.items()}
    i, j = np.nonzero(mask)
    return {"row": i + tile.row, "col": j + tile.col} | {n: a[i, j] for n, a in columns.items()}


def surrounding(cells: DataFrame, band: str, size: int = SIZE) -> DataFrame:
    """Cells whose 3 x 3 window is complete, with its values z1 ... z9 (z1 top left, z5 the cell)."""

    def compute(t: Tile | Listed) -> dict[str, np.ndarray]:
        z = {f"z{3 * (a + 1) + b + 2}": t.view(t.bands[band], a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)}
        return picked(t, np.isfinite(np.stack(list(z.values()))).all(0), z)

    return by_tile(cells, [band], 1, compute, "row int, col int, " + ", ".join(f"z{k} double" for k in range(1, 10)), size)


def _running(name: str, t: Tile | Listed, band: str, h: int) -> np.ndarray:
    """A function of the present values of the (2h + 1)**2 window of each inner cell, NaN without any."""
    v = t.bands[band]
    there = ~np.isnan(v)
    views = lambda a: (t.view(a, i, j) for i in range(-h, h + 1) for j in range(-h, h + 1))
    n = sum(x.astype(np.int32) for x in views(there))
    with np.errstate(all="ignore"):
        if name in ("avg", "mean", "sum"):
            total = np.zeros(n.shape)
            for x in views(np.where(there, v, 0.0)):
                total += x
            out = total if name == "sum" else total / n
        elif name in ("min", "max"):
            pick, none = (np.minimum, np.inf) if name == "min" else (np.maximum, -np.inf)
            out = np.full(n.shape, none)
            for x in views(np.where(there, v, none)):
                out = pick(out, x)
        elif name == "median":
            stack = np.sort(np.stack(list(views(v))), axis=0)  # missing values last
            low, high = (np.take_along_axis(stack, np.maximum(k, 0)[None], 0)[0] for k in ((n - 1) // 2, n // 2))
            out = (low + high) / 2
        else:
            raise ValueError(f"unknown focal function {name}")
    return np.where(n > 0, out, np.nan)


def focal(cells: DataFrame, band: str, n: int, how: str, size: int = SIZE) -> DataFrame:
    """Of each missing cell (row, col): value, a function by name of its n x n window; cells without any neighbour are left out."""
    if how not in ("avg", "mean", "sum", "min", "max", "median"):
        raise ValueError(f"unknown focal function {how}")

    def compute(t: Tile | Listed) -> dict[str, np.ndarray]:
        out = _running(how, t, band, n // 2)
        return picked(t, t.view(t.here) & np.isnan(t.view(t.bands[band])) & ~np.isnan(out), {"value": out})

    return by_tile(cells, [band], n // 2, compute, "row int, col int, value double", size)


def disc_mean(cells: DataFrame, band: str, radius: int, size: int = SIZE) -> DataFrame:
    """Of each present cell (row, col): value, and mean, of the other present cells within the radius.

    Each row of the disc is a difference of running sums, so a cell costs 2 * radius + 1 steps."""

    def compute(t: Tile | Listed) -> dict[str, np.ndarray]:
        v = t.bands[band]
        there = ~np.isnan(v)
        if isinstance(t, Listed):
            total, n, own = np.zeros(len(t.inner)), np.zeros(len(t.inner)), np.where(there, v, 0.0)
            for a in range(-radius, radius + 1):
                w = math.isqrt(radius * radius - a * a)
                for b in range(-w, w + 1):
                    if a or b:
                        total += t.view(own, a, b)
                        n += t.view(there, a, b)
            with np.errstate(all="ignore"):
                return picked(t, t.view(there) & (n > 0), {"value": t.view(v), "mean": total / n})
        middle = np.nanmean(v) if there.any() else 0.0  # keeps running sums small
        runs = [np.pad(np.cumsum(x, axis=1), ((0, 0), (1, 0))) for x in (np.where(there, v - middle, 0.0), there.astype(np.float64))]
        total, n, h = -np.where(there, v - middle, 0.0), -there.astype(np.float64), t.reach
        total, n = t.view(total).copy(), t.view(n).copy()
        for a in range(-radius, radius + 1):
            w = math.isqrt(radius * radius - a * a)
            rows = slice(h + a, h + a + t.size)
            for out, run in zip((total, n), runs, strict=True):
                out += run[rows, h + w + 1 : h + w + 1 + t.size] - run[rows, h - w : h - w + t.size]
        with np.errstate(all="ignore"):
            mean = total / n + middle
        return picked(t, t.view(there) & (n > 0.5), {"value": t.view(v), "mean": mean})

    return by_tile(cells, [band], radius, compute, "row int, col int, value double, mean double", size)


def box_means(cells: DataFrame, bands: Sequence[str], size: int = SIZE) -> DataFrame:
    """Of each cell (row, col): the means of the bands over the present cells of its 3 x 3 window."""

    def compute(t: Tile | Listed) -> dict[str, np.ndarray]:
        return picked(t, t.view(~np.isnan(t.bands[bands[0]])), {b: _running("avg", t, b, 1) for b in bands})

    return by_tile(cells, bands, 1, compute, "row int, col int, " + ", ".join(f"{b} double" for b in bands), size)


def convergence(cells: DataFrame, aspect: str, size: int = SIZE) -> DataFrame:
    """Of each cell with an aspect (row, col): mean angle between its neighbours' aspects and the way to it, less 90 degrees."""

    def compute(t: Tile | Listed) -> dict[str, np.ndarray]:
        v = t.bands[aspect]
        total, n = (np.zeros(t.view(v).shape) for _ in range(2))
        for a in (-1, 0, 1):
            for b in (-1, 0, 1):
                if a or b:
                    to_cell = (math.degrees(math.atan2(-b, a)) + 360.0) % 360.0
                    turn = np.abs((t.view(v, a, b) - to_cell + 540.0) % 360.0 - 180.0)
                    there = ~np.isnan(turn)
                    total += np.where(there, turn, 0.0)
                    n += there
        with np.errstate(all="ignore"):
            out = total / n - 90.0
        return picked(t, t.view(~np.isnan(v)) & (n > 0), {"convergence": out})

    return by_tile(cells, [aspect], 1, compute, "row int, col int, convergence double", size)


def resampled(cells: DataFrame, band: str, factor: float, weight: Callable[[np.ndarray], np.ndarray], side: int, least: float, size: int = SIZE) -> DataFrame:
    """Of each cell (r, c) of a grid of factor times the cell size that some cell lies in: value, the weighted mean of the
    present cells around its centre. The kernel is separable: a tile's values are two matrix products, and where cells are
    few, each adds to the new centres around it."""
    reach = max(side, math.ceil(factor / 2) + 1)

    def places(first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """New rows whose centres lie in the inner part, and the kernel's weight of each row of the tile."""
        new = np.arange(math.floor(first / factor) - 1, math.floor((first + n) / factor) + 2)
        u = (new + 0.5) * factor - 0.5
        own = (np.floor(u) >= first) & (np.floor(u) < first + n)
        new, u = new[own], u[own]
        at = np.arange(first - reach, first + n + reach)
        near = (at > np.floor(u)[:, None] - side) & (at <= np.floor(u)[:, None] + side)
        return new, np.where(near, weight(np.abs(u[:, None] - at)), 0.0)

    def listed(t: Listed) -> dict[str, np.ndarray]:
        """Each cell adds to the few new centres within its reach; only those that some cell lies in are kept."""
        wide = math.ceil(t.size / factor) + 4

        def rank(new: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Place of a new row within its tile, where its centre lies, and whether that is in the tile's inner part."""
            u = (new + 0.5) * factor - 0.5
            return new - np.floor(first / factor).astype(np.int64) + 2, u, (np.floor(u) >= first) & (np.floor(u) < first + t.size)

        def key(r: np.ndarray, c: np.ndarray, tile: np.ndarray) -> np.ndarray:
            return (tile * wide + r) * wide + c

        new = [np.floor(x / factor).astype(np.int64) for x in (t.rows, t.cols)]
        (r, _, in_r), (c, _, in_c) = (rank(x, first) for x, first in zip(new, (t.first_row, t.first_col), strict=True))
        own = in_r & in_c
        lies, at = np.unique(key(r, c, t.tile)[own], return_index=True)
        r, c = (x[own][at] for x in new)
        total, n, v = np.zeros(len(lies)), np.zeros(len(lies)), t.bands[band][:-1]
        there = np.flatnonzero(~np.isnan(v))
        steps = range(math.ceil(2 * side / factor) + 2)

        def near(x: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            start, out = np.floor((x - side + 0.5) / factor - 0.5).astype(np.int64), []
            for k in steps:
                place, u, inside = rank(start + k, first)
                out.append((place, np.abs(u - x), inside & (x > np.floor(u) - side) & (x <= np.floor(u) + side)))
            return out

        by_row, by_col = near(t.rows[there], t.first_row[there]), near(t.cols[there], t.first_col[there])
        for place_r, far_r, in_r in by_row if len(lies) else ():
            for place_c, far_c, in_c in by_col:
                k = np.flatnonzero(in_r & in_c)
                wanted = key(place_r[k], place_c[k], t.tile[there[k]])
                at = np.minimum(np.searchsorted(lies, wanted), len(lies) - 1)
                found = lies[at] == wanted
                k, at = k[found], at[found]
                w = weight(far_r[k]) * weight(far_c[k])
                total += np.bincount(at, w * v[there[k]], len(lies))
                n += np.bincount(at, w, len(lies))
        kept = n > least
        return {"r": r[kept], "c": c[kept], "value": total[kept] / n[kept]}

    def compute(t: Tile | Listed) -> dict[str, np.ndarray]:
        if isinstance(t, Listed):
            return listed(t)
        (r, by_row), (c, by_col) = places(t.row, t.size), places(t.col, t.size)
        v = t.bands[band]
        there = ~np.isnan(v)
        total, n = by_row @ np.where(there, v, 0.0) @ by_col.T, by_row @ there.astype(np.float64) @ by_col.T
        i, j = np.nonzero(t.here)
        lies = np.zeros((len(r), len(c)), bool)
        a, b = (np.floor((x + first - reach) / factor).astype(int) - (new[0] if len(new) else 0) for x, first, new in ((i, t.row, r), (j, t.col, c)))
        ok = (a >= 0) & (a < len(r)) & (b >= 0) & (b < len(c))
        lies[a[ok], b[ok]] = True
        i, j = np.nonzero(lies & (n > least))
        return {"r": r[i], "c": c[j], "value": total[i, j] / n[i, j]}

    return by_tile(cells, [band], reach, compute, "r int, c int, value double", size)
