"""Exact nearest neighbours of rows among training rows, pruned by pivots and the triangle inequality.

A bounded sample of training rows serves as pivots. Every training row belongs to its nearest pivot, and the rows
of a pivot are cut into blocks by their distance to it, so a block has a pivot and a least and a largest distance:
no row of it is nearer to a query than the query's distance to the pivot, and to its own, tells. Blocks hold a bounded number of
rows (equal rows are dealt over several), and their list, of at most some ten thousand entries, is all that is
sent to every task.

A query first meets the blocks that can be nearest, which gives it a distance that its k-th neighbour cannot
exceed; then it meets only the blocks that may hold nearer rows. A task holds a group of blocks whose pivots follow
each other along their widest direction; queries travel to a group once, in packs, with the blocks of it that they
want. A group that many queries look for is held by several tasks. Distances of what is kept are taken from
differences. Where nothing can be pruned, all pairs are looked at, in slabs of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import written

#: Pivots at most, rows of a block at least aimed at, blocks of a table, marks by which a pivot's rows are cut,
#: queries that one holder of a group serves, and blocks that a query meets at first.
PIVOTS, BLOCK, BLOCKS, MARKS, SERVED, FIRST = 1024, 2048, 32_768, 64, 65_536, 4
#: Rows of a group, groups of a table that needs no more, queries and rows that are compared at once, and bounds that a task
#: holds at once.
GROUP, GROUPS, QUERIES, SLAB, HELD = 131_072, 4, 512, 2048, 1 << 20
#: Rows of a side of the comparison of all pairs, and sides of a table that needs no more.
SIDE, SIDES = 65_536, 8
#: Relative slack of bounds against rounding.
SLACK = 1e-9
_FIELDS = ["block", "kind", "rows", "ids", "folds", "z", "limits", "wants"]
_PACK = "block long, kind int, rows binary, ids binary, folds binary, z binary, limits binary, wants binary"


def gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all pairs, by products; good to some 1e-8 of the vectors' length."""
    return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _packs(block: np.ndarray, kind: int, rows, ids, folds, z, limits, wants) -> pa.RecordBatch:
    """One row for each block of what belongs to it."""
    order = np.argsort(block, kind="stable")
    block = block[order]
    cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    ends = np.r_[cuts[1:], len(block)]
    columns = [np.ascontiguousarray(x[order]) for x in (rows, ids, folds, z, limits, wants)]
    made = [pa.array([c[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()) for c in columns]
    return pa.record_batch([pa.array(block[cuts].astype(np.int64)), pa.array(np.full(len(cuts), kind, np.int32)), *made], names=_FIELDS)


@dataclass
class Blocks:
    """Training rows in packed blocks, and what tasks need to know of them."""

    packs: DataFrame
    pivots: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    n: np.ndarray
    fold_low: np.ndarray
    fold_high: np.ndarray
    group: np.ndarray

    def bounds(self, z: np.ndarray, folds: np.ndarray, other_fold: bool) -> np.ndarray:
        """Least possible distance of each query to each block's rows; infinite where all rows are of its own fold."""
        far = gaps(z, self.pivots)
        beyond = ((far - far.min(1, keepdims=True)) / 2)[:, self.pivot]  # a pivot's rows are nearer to it than to the query's pivot
        far = far[:, self.pivot]
        least = np.maximum(0.0, np.maximum(np.maximum(far - self.high, self.low - far), beyond) - SLACK * (1 + far))
        if other_fold:
            least[(self.fold_low == self.fold_high) & (self.fold_low == folds[:, None])] = np.inf
        return least

    def nearest(self, least: np.ndarray, k: int) -> np.ndarray:
        """Marks the blocks that each query meets at first: the few of the least bounds that hold enough rows."""
        few = min(FIRST, least.shape[1])
        at = np.argpartition(least, few - 1, axis=1)[:, :few]
        at = np.take_along_axis(at, np.argsort(np.take_along_axis(least, at, 1), axis=1, kind="stable"), 1)
        before = np.cumsum(self.n[at], 1) - self.n[at]
        out = np.zeros(least.shape, bool)
        np.put_along_axis(out, at, before < 2 * k + 1, 1)
        return out & np.isfinite(least)


def _keyed(df: DataFrame, other_fold: bool) -> DataFrame:
    fold: Column = F.xxhash64("fold") if other_fold else F.lit(0).cast("long")
    return df.where("z is not null").select(F.col("vec_id").cast("long").alias("id"), fold.alias("fold"), "z")


def blocks_of(train: DataFrame, other_fold: bool = False, block_rows: int = BLOCK) -> Blocks | None:
    """Cuts the training rows (vec_id, z, fold if asked) into blocks; None if there are none."""
    rows = _keyed(train, other_fold)
    n = rows.count()
    if not n:
        return None
    most = min(PIVOTS, int(np.ceil(2 * np.sqrt(n))))
    pivots = np.array([r["z"] for r in rows.select("z", F.xxhash64("id", "z").alias("h")).orderBy("h").limit(most).collect()], float)
    pivots = np.unique(pivots, axis=0)
    middle = pivots - pivots.mean(0)
    pivots = pivots[np.argsort(middle @ np.linalg.svd(middle, full_matrices=False)[2][0])]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = gaps(_matrix(batch.column("z")), pivots)
                at = far.argmin(1)
                made = [*batch.columns, pa.array(at.astype(np.int32)), pa.array(far[np.arange(len(at)), at])]
                yield pa.record_batch(made, names=["id", "fold", "z", "pivot", "far"])

    placed = written(rows.mapInArrow(assign, "id long, fold long, z array<double>, pivot int, far double"), "placed")
    block_rows = max(block_rows, -(-n // BLOCKS))
    rings = F.least(F.lit(MARKS), F.ceil(F.col("n") / block_rows))
    marks = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("far", [i / MARKS for i in range(1, MARKS)], 1000).alias("marks")).withColumn("rings", rings)
    ringed = placed.join(marks.select("pivot", "marks", "rings"), "pivot")
    below = F.size(F.filter("marks", lambda m: m < F.col("far")))
    ringed = ringed.withColumn("ring", F.when(F.col("rings") == 1, 0).otherwise(F.floor(below * F.col("rings") / MARKS))).drop("marks", "rings")
    # a ring of many equal distances is dealt over several blocks
    sizes = ringed.groupBy("pivot", "ring").agg(F.ceil(F.count(F.lit(1)) / (2 * block_rows)).alias("parts"))
    dealt = ringed.join(sizes, ["pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("id", "z"), F.col("parts"))).drop("parts")
    dealt = written(dealt, "dealt")
    listed = dealt.groupBy("pivot", "ring", "part").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count(F.lit(1)).alias("n"), F.min("fold").alias("a"), F.max("fold").alias("b"))
    listed = sorted(listed.collect(), key=lambda r: (r["pivot"], r["ring"], r["part"]))  # a row for each block
    numbers = dealt.sparkSession.createDataFrame([(r["pivot"], r["ring"], r["part"], i) for i, r in enumerate(listed)], "pivot int, ring long, part long, block long")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                block, ids, folds, z = batch.column("block").to_numpy(), batch.column("id").to_numpy(), batch.column("fold").to_numpy(), _matrix(batch.column("z"))
                yield _packs(block, 0, ids, ids, folds, z, np.zeros(len(ids)), np.zeros(len(ids), np.uint8))

    numbered = dealt.withColumn("ring", F.col("ring").cast("long")).join(numbers, ["pivot", "ring", "part"]).select("block", "id", "fold", "z")
    packs = written(numbered.mapInArrow(pack, _PACK), "blocks")
    column = lambda name, kind=float: np.array([r[name] for r in listed], kind)
    sizes, aim = column("n", int), min(GROUP, max(-(-n // GROUPS), SLAB))
    group = np.cumsum(sizes) // aim
    return Blocks(packs, pivots, column("pivot", int), column("low"), column("high"), sizes, column("a", np.int64), column("b", np.int64), np.unique(group, return_inverse=True)[1])


def _unpacked(batch: pa.RecordBatch, i: int, dims: int) -> tuple[np.ndarray, ...]:
    raw = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)
    return raw("rows", np.int64), raw("ids", np.int64), raw("folds", np.int64), raw("z", np.float64).reshape(-1, dims), raw("limits", np.float64)


class Nearest:
    """The k nearest rows found so far of each query of a pack, within its limit, nearest first, ties by id."""

    def __init__(self, z, ids, folds, limits, k: int, other_fold: bool):
        self.z, self.ids, self.folds, self.limits, self.k, self.other_fold = z, ids, folds, limits.copy(), k, other_fold
        self.q, self.d, self.near = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)

    def meet(self, at: np.ndarray, y, y_ids, y_folds, wanted: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """The queries at these places meet rows, or those of the blocks that they want (a matrix, and each row's block).

        Where all have limits, only what the limits leave is looked at more closely."""
        z, k, limits = self.z[at], self.k, self.limits[at]
        own, theirs = (self.folds[at], y_folds) if self.other_fold else (self.ids[at], y_ids)
        length, y_length = (z * z).sum(1), (y * y).sum(1)
        d = z @ y.T
        d *= -2.0
        d += length[:, None]
        d += y_length
        slack = 1e-7 * (1 + np.sqrt(np.maximum(length, y_length.max(initial=0))))  # products may be off by that
        i = j = None
        if np.isfinite(limits).all():
            i, j = np.divmod(np.flatnonzero(d <= ((limits + slack) ** 2)[:, None]), max(1, len(y)))
            kept = own[i] != theirs[j]
            if wanted is not None:
                kept &= wanted[0][i, wanted[1][j]]
            i, j = i[kept], j[kept]
        if i is None or len(i) > 4 * k * len(at):  # the k-th of these rows may tell more than the limit
            d = np.sqrt(np.maximum(d, 0.0, out=d), out=d)
            d[theirs == own[:, None]] = np.inf
            if wanted is not None:
                d[~wanted[0][:, wanted[1]]] = np.inf
            if k < d.shape[1]:
                limits = np.minimum(limits, np.partition(d, k - 1, axis=1)[:, k - 1])
            i, j = np.nonzero(d <= (limits + slack)[:, None])
            i, j = (x[np.isfinite(d[i, j])] for x in (i, j))
        if not len(i):
            return
        q = np.concatenate((self.q, at[i]))
        exact = np.concatenate((self.d, np.sqrt(((z[i] - y[j]) ** 2).sum(1))))
        near = np.concatenate((self.near, y_ids[j]))
        order = np.lexsort((near, exact, q))
        q, exact, near = q[order], exact[order], near[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        full = rank == k - 1
        self.limits[q[full]] = np.minimum(self.limits[q[full]], exact[full])
        self.q, self.d, self.near = q[rank < k], exact[rank < k], near[rank < k]


def _search(blocks: Blocks, packs: DataFrame, k: int, other_fold: bool) -> DataFrame:
    """Packs of queries meet their groups: (row, near: its k nearest there, looked: rows compared)."""
    spark, dims, n_groups = packs.sparkSession, blocks.pivots.shape[1], int(blocks.group.max()) + 1
    packs = written(packs.withColumnRenamed("block", "group"), "queries")
    asked = packs.groupBy("group").agg((F.sum(F.length("rows")) / 8).cast("long").alias("q")).orderBy("group").collect()  # a row for each group
    most = -(-2 * spark.sparkContext.defaultParallelism // n_groups)
    holders = [max(1, -(-r["q"] // SERVED), min(-(-r["q"] // 1024), most)) for r in asked]
    starts, tasks = np.cumsum([0, *holders[:-1]]), max(1, sum(holders))
    wanted = spark.createDataFrame([(r["group"], h, int(s)) for r, h, s in zip(asked, holders, starts, strict=False)], "group long, holders int, start int")
    grouped = spark.createDataFrame([(i, int(g)) for i, g in enumerate(blocks.group)], "block long, group long")
    held = blocks.packs.join(F.broadcast(grouped), "block").join(F.broadcast(wanted), "group").withColumn("holder", F.explode(F.sequence(F.lit(0), F.col("holders") - 1)))
    asked = packs.withColumn("block", F.lit(0).cast("long")).join(F.broadcast(wanted), "group").withColumn("holder", F.pmod(F.xxhash64("rows"), F.col("holders")).cast("int"))
    both = held.unionByName(asked).withColumn("task", F.col("start") + F.col("holder")).drop("holders", "start")
    both = both.repartitionById(tasks, F.col("task")).drop("task").sortWithinPartitions("group", "holder", "kind", "block")  # each holder is a task

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, own, starts = None, [], None, None
        for batch in batches:
            for i, (group, holder, kind, block) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("group", "holder", "kind", "block")), strict=True)):
                if (group, holder) != at:
                    at, parts, own = (group, holder), [], None
                if kind == 0:
                    parts.append((block, *_unpacked(batch, i, dims)[1:4]))
                    continue
                if own is None:
                    numbers = np.concatenate([np.full(len(x[1]), x[0]) for x in parts])  # rising
                    own = [np.concatenate(x) for x in list(zip(*parts, strict=True))[1:]]
                    starts = np.append(np.searchsorted(numbers, np.unique(numbers)), len(numbers))
                rows, ids, folds, z, limits = _unpacked(batch, i, dims)
                wants = np.unpackbits(np.frombuffer(batch.column("wants")[i].as_buffer(), np.uint8).reshape(len(rows), -1), axis=1)[:, : len(starts) - 1].astype(bool)
                for a in range(0, len(rows), QUERIES):
                    s = slice(a, a + QUERIES)
                    best, looked = Nearest(z[s], ids[s], folds[s], limits[s], k, other_fold), np.zeros(len(rows[s]), np.int64)
                    if wants[s].mean() > 0.3:  # so many that whole slabs are quicker
                        some, of_block = np.arange(len(rows[s])), np.repeat(np.arange(len(starts) - 1), np.diff(starts))
                        for lo in range(0, len(own[0]), SLAB):
                            part = slice(lo, lo + SLAB)  # blocks that were met before are not wanted again
                            best.meet(some, own[2][part], own[0][part], own[1][part], (wants[s], of_block[part]))
                        looked += len(own[0])
                    else:
                        for b in np.flatnonzero(wants[s].any(0)):
                            some = np.flatnonzero(wants[s][:, b])
                            for lo in range(starts[b], starts[b + 1], SLAB):
                                hi = min(lo + SLAB, starts[b + 1])
                                best.meet(some, own[2][lo:hi], own[0][lo:hi], own[1][lo:hi])
                            looked[some] += starts[b + 1] - starts[b]
                    cuts = np.searchsorted(best.q, np.arange(len(rows[s]) + 1)).astype(np.int32)
                    structs = pa.StructArray.from_arrays([pa.array(best.d), pa.array(best.near)], names=["d", "id"])
                    yield pa.record_batch([pa.array(rows[s]), pa.ListArray.from_arrays(cuts, structs), pa.array(looked)], names=["row", "near", "looked"])

    return both.mapInArrow(meet, "row long, near array<struct<d:double,id:long>>, looked long")


def nearest(rows: DataFrame, train: DataFrame, k: int = 1, other_fold: bool = False, block_rows: int = BLOCK) -> DataFrame:
    """Adds near, the distances and ids of the k nearest training rows (ties by id), and looked, the rows compared.

    rows and train have vec_id, z (an array, null for incomplete rows) and, if asked, fold. A row is not its own
    neighbour (rows of one vec_id are one); if asked, nor are rows of its fold. Incomplete rows have no neighbours.
    """
    kind = "array<struct<d:double,id:long>>"
    blocks = blocks_of(train, other_fold, block_rows)
    if blocks is None:
        return rows.withColumn("near", F.array().cast(kind)).withColumn("looked", F.lit(0).cast("long"))
    rows = written(rows.withColumn("__row", F.monotonically_increasing_id()), "asking")
    fold = F.xxhash64("fold") if other_fold else F.lit(0).cast("long")
    asking = rows.where("z is not null").select(F.col("__row").alias("row"), F.coalesce(F.col("vec_id").cast("long"), F.lit(np.iinfo(np.int64).min)).alias("id"), fold.alias("fold"), "z")
    tasks = blocks.packs.sparkSession.sparkContext.defaultParallelism
    sent = asking.repartition(tasks)
    light = Blocks(None, *[getattr(blocks, x) for x in ("pivots", "pivot", "low", "high", "n", "fold_low", "fold_high", "group")])
    cuts = np.append(np.searchsorted(light.group, np.unique(light.group)), len(light.group))
    at_once = max(16, min(1024, HELD // len(light.group)))

    def send(again: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, at_once):
                    part = batch.slice(a, at_once)
                    row, ids, folds = (part.column(c).to_numpy() for c in ("row", "id", "fold"))
                    z = _matrix(part.column("z"))
                    least = light.bounds(z, folds, other_fold)
                    first = light.nearest(least, k)
                    limits = part.column("reach").to_numpy() if again else np.full(len(row), np.inf)
                    want = (least <= limits[:, None]) & np.isfinite(least) & ~first if again else first
                    for g, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        q = np.flatnonzero(want[:, lo:hi].any(1))
                        if len(q):
                            yield _packs(np.full(len(q), g), 1, row[q], ids[q], folds[q], z[q], limits[q], np.packbits(want[q, lo:hi], axis=1))

        return run

    best = lambda df: df.groupBy("row").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"), F.sum("looked").alias("looked"))
    begun = written(best(_search(blocks, sent.mapInArrow(send(False), _PACK), k, other_fold)), "begun")
    # the k-th distance so far; without k neighbours there is no limit
    reach = F.when(F.size("near") >= k, F.col("near")[k - 1]["d"]).otherwise(F.lit(float("inf")))
    again = asking.join(begun.select("row", reach.alias("reach")), "row", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    found = best(begun.unionByName(_search(blocks, again.mapInArrow(send(True), _PACK), k, other_fold)))
    out = rows.join(found.withColumnRenamed("row", "__row"), "__row", "left").drop("__row")
    return out.withColumns({"near": F.coalesce("near", F.array().cast(kind)), "looked": F.coalesce("looked", F.lit(0).cast("long"))})


def _added(z, ids, y, y_ids, same: bool) -> tuple[np.ndarray, ...]:
    """Sums of distances, and their numbers, of each row of one side to the rows of other ids on the other, and the reverse."""
    total, n, y_total, y_n = np.zeros(len(z)), np.full(len(z), len(y)), np.zeros(len(y)), np.full(len(y), len(z))
    length, y_length = (z * z).sum(1), (y * y).sum(1)
    for a in range(0, len(z), QUERIES):
        i = slice(a, a + QUERIES)
        for b in range(0, len(y), SLAB):
            j = slice(b, b + SLAB)
            d = z[i] @ y[j].T
            d *= -2.0
            d += length[i, None]
            d += y_length[j]
            np.sqrt(np.maximum(d, 0.0, out=d), out=d)
            if np.isin(ids[i], y_ids[j]).any():
                own = ids[i, None] == y_ids[j]
                d[own] = 0.0
                n[i] -= own.sum(1)
                y_n[j] -= own.sum(0)
            total[i] += d.sum(1)
            if not same:
                y_total[j] += d.sum(0)
    return total, n, y_total, y_n


def paired(rows: DataFrame, groups: int) -> DataFrame:
    """Rows (row, id, z) in packs, dealt over groups, with a partition for each two of them and for each against itself."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, ids, z = batch.column("row").to_numpy(), batch.column("id").to_numpy(), _matrix(batch.column("z"))
                yield _packs(row % groups, 0, row, ids, np.zeros(len(row), np.int64), z, np.zeros(len(row)), np.zeros(len(row), np.uint8))

    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("other")
    sent = rows.mapInArrow(pack, _PACK).select("block", "rows", "ids", "z", other)
    low, high = F.least("block", "other"), F.greatest("block", "other")
    sent = sent.withColumns({"pair": (high * (high + 1) / 2 + low).cast("int"), "kind": (F.col("block") > F.col("other")).cast("int")})
    return sent.repartitionById(groups * (groups + 1) // 2, F.col("pair")).select("kind", "rows", "ids", "z")


def distance_totals(train: DataFrame, group_rows: int = SIDE) -> DataFrame:
    """For each complete training row the sum of its distances to all rows of other vec_ids, and their number.

    A mean over all pairs has to see all pairs, each once. Rows are dealt over groups of bounded size, and a task holds two of
    them (or one against itself); a group goes to as many tasks as there are groups, which are few unless the table asks for more."""
    rows = written(_keyed(train, False).withColumn("row", F.monotonically_increasing_id()), "pairs")
    n = rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-n // group_rows), min(-(-n // 1024), max(SIDES, int(np.ceil(np.sqrt(2 * cores))))))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[list, list] = ([], [])
        for batch in batches:
            for i, kind in enumerate(batch.column("kind").to_pylist()):
                row, ids = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in ("rows", "ids"))
                sides[kind].append((row, ids, np.frombuffer(batch.column("z")[i].as_buffer(), np.float64).reshape(len(row), -1)))
        if not sides[0]:  # a group without rows
            return
        row, ids, z = (np.concatenate(x) for x in zip(*sides[0], strict=True))
        of_row, of_ids, of_z = (np.concatenate(x) for x in zip(*(sides[1] or sides[0]), strict=True))
        total, n, y_total, y_n = _added(z, ids, of_z, of_ids, not sides[1])
        yield pa.record_batch([pa.array(row), pa.array(total), pa.array(n)], names=["row", "total", "n"])
        if sides[1]:
            yield pa.record_batch([pa.array(of_row), pa.array(y_total), pa.array(y_n)], names=["row", "total", "n"])

    return paired(rows, groups).mapInArrow(add, "row long, total double, n long").groupBy("row").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
