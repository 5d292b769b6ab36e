"""Hard negatives of anchors by exact integer inner products, several candidates to a multiplication.

Components become integers. The components of several candidates are biased to be non-negative and stand in
separate fields of one wide integer; one multiplication by the anchor's component multiplies them all, and
after the sum over dimensions each field holds one whole inner product (plus a known amount that keeps it
non-negative). Where two fields fit into the 53 bits that doubles hold exactly, the wide integers are doubles,
and the sums are matrix products; wider fields stand in long integers, ``WIDE`` candidates in one.

1. Rows are packed into blocks of up to ``PACK`` vectors, written once. Candidates are dealt into groups by
   block; anchors are packed the same way and each block of anchors goes to every group.
2. A task holds one group, meets the anchors block by block, and tells for each anchor the best of its own
   label; the best of all groups are its positives.
3. The anchors go out again with their positives' scores, and each task tells the best rows of other labels
   within each positive's band of scores. Scores that cannot enter are dropped by one comparison.

Tasks emit a few rows for each anchor and never a pair. The anchors are a stated part of all rows, and each
meets all rows, so the work is anchors x rows; groups hold up to ``GROUP`` vectors.

Defined results: rows with a null id, null label, null or empty vector, null or non-finite components, or
components of 2**24 and more after scaling take no part; vectors of different lengths do not meet. Rows that
share an id are rows of their own: each is an anchor, and may be another's positive. Anchors without positives,
and positives without negatives, give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, tune

#: Vectors of a block that is exchanged, of a group that a task holds, and of its blocks of products.
PACK, GROUP, BLOCK = 1024, 262_144, 2048
#: Candidates in one long integer, and the limit of a component.
WIDE, LIMIT = 64, 1 << 24
_PACKED = "dims int, n int, rows binary, ids binary, labels binary, vectors binary"


@dataclass(frozen=True)
class MiningParams:
    """Scaling of components, positives of an anchor, negatives of a positive, and the band of scores in percent."""

    scale: int = 256
    positives: int = 5
    negatives: int = 3
    least_percent: int = 50
    most_percent: int = 95
    every: int = 50


class Products:
    """Exact inner products of integer vectors with candidates in packed fields."""

    def __init__(self, candidates: np.ndarray):
        self.n, self.dims = candidates.shape
        self.bias = int(np.abs(candidates).max(initial=0))
        self.fields = (candidates + self.bias).astype(np.int64)
        self.packed: dict[int, np.ndarray] = {}

    def width(self, anchors: np.ndarray) -> int:
        """Bits of a field: sums are below half its range in absolute value."""
        return (self.dims * int(np.abs(anchors).max(initial=0)) * 2 * self.bias).bit_length() + 1

    def _pairs(self, bits: int) -> np.ndarray:
        if bits not in self.packed:
            half = -(-self.n // 2)
            wide = self.fields[:half].copy()
            wide[: self.n - half] += self.fields[half:] << bits
            self.packed = {bits: wide.T.astype(np.float64)}
        return self.packed[bits]

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Anchors x candidates, as longs."""
        bits, half = self.width(anchors), -(-self.n // 2)
        less = self.bias * anchors.sum(1, dtype=np.int64)
        lift = 1 << (bits - 1)
        if 2 * bits > 53:
            return self._long(anchors, -(-bits // 8)) - less[:, None]
        sums = (anchors.astype(np.float64) @ self._pairs(bits)).astype(np.int64)
        sums += lift + (lift << bits)
        out = np.empty((len(anchors), self.n), np.int64)
        np.bitwise_and(sums, (1 << bits) - 1, out=out[:, :half])
        np.right_shift(sums[:, : self.n - half], bits, out=out[:, half:])
        out -= (less + lift)[:, None]
        return out

    def _long(self, anchors: np.ndarray, size: int) -> np.ndarray:
        """Sums by fields of that many bytes in long integers, before the bias is taken off."""
        lift = 1 << (8 * size - 1)
        lifts = int.from_bytes(lift.to_bytes(size, "little") * WIDE, "little")
        out = np.empty((len(anchors), self.n), np.int64)
        for k in range(0, self.n, WIDE):
            part = self.fields[k : k + WIDE]
            raw = np.zeros((self.dims, WIDE, size), np.uint8)
            raw[:, : len(part)] = np.ascontiguousarray(part.T, "<i8")[..., None].view(np.uint8)[..., :size]
            wide = [int.from_bytes(r.tobytes(), "little") for r in raw]
            for i, a in enumerate(anchors.tolist()):
                total = sum(x * w for x, w in zip(a, wide, strict=True)) + lifts
                got = np.frombuffer(total.to_bytes(WIDE * size, "little"), np.uint8).reshape(WIDE, size)
                full = np.zeros((WIDE, 8), np.uint8)
                full[:, :size] = got
                out[i, k : k + WIDE] = (full.view("<u8")[:, 0] - np.uint64(lift)).astype(np.int64)[: len(part)]
        return out


class _Block:
    """Packed vectors as arrays."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        raw = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)
        self.dims = batch.column("dims")[i].as_py()
        self.rows, self.ids, self.labels = raw("rows", np.int64), raw("ids", np.int64), raw("labels", np.int64)
        self.vectors = raw("vectors", np.int32).reshape(-1, self.dims)


def _emit(dims: int, parts: list[tuple]) -> pa.RecordBatch:
    rows, ids, labels, vectors = (np.concatenate(x) for x in zip(*parts, strict=True))
    made = [[dims], [len(ids)], *([np.ascontiguousarray(x).tobytes()] for x in (rows, ids, labels, vectors))]
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.record_batch([pa.array(x, k) for x, k in zip(made, kinds, strict=True)], names=["dims", "n", "rows", "ids", "labels", "vectors"])


def _repacked(found: Iterator[tuple[int, tuple]]) -> Iterator[pa.RecordBatch]:
    """(dims, arrays) to blocks of up to PACK vectors of one length."""
    waiting: dict[int, list] = {}
    for dims, arrays in found:
        held = waiting.setdefault(dims, [])
        held.append(arrays)
        while sum(len(x[1]) for x in held) >= PACK:
            whole = tuple(np.concatenate(x) for x in zip(*held, strict=True))
            yield _emit(dims, [tuple(x[:PACK] for x in whole)])
            held[:] = [tuple(x[PACK:] for x in whole)] if len(whole[1]) > PACK else []
    for dims, held in waiting.items():
        if held:
            yield _emit(dims, held)


def pack_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """Rows (id long, label long, vector) to packed blocks; rows that take no part are left out."""

    def quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        for batch in batches:
            ids, labels, vectors = batch.columns
            known = pc.and_(ids.is_valid(), labels.is_valid()).to_numpy(zero_copy_only=False)
            lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
            for d in np.unique(lengths[known & (lengths > 0)]):
                at = np.flatnonzero(known & (lengths == d))
                v = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                with np.errstate(invalid="ignore", over="ignore"):
                    v = np.floor(v * scale)
                    good = (np.abs(v) < LIMIT).all(1)  # false for NaN as well
                take = lambda c, at=at[good]: c.take(pa.array(at)).to_numpy()
                if good.any():
                    yield int(d), (np.zeros(int(good.sum()), np.int64), take(ids), take(labels), v[good].astype(np.int32))

    return rows.mapInArrow(lambda batches: _repacked(quantised(batches)), _PACKED)


def numbered(packed: DataFrame) -> DataFrame:
    """Gives each vector a number of its own, from the number of its block."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column("block").to_numpy() * PACK
            made = [(f + np.arange(n)).tobytes() for f, n in zip(first, batch.column("n").to_pylist(), strict=True)]
            names = ["dims", "n", "rows", "ids", "labels", "vectors"]
            yield pa.record_batch([pa.array(made, pa.binary()) if x == "rows" else batch.column(x) for x in names], names=names)

    return packed.withColumn("block", F.monotonically_increasing_id()).mapInArrow(fill, _PACKED)


class Group:
    """A task's candidates: of each length, sorted by label."""

    def __init__(self, blocks: list[_Block]):
        self.of, self.made = {}, {}
        for d in {b.dims for b in blocks}:
            own = [b for b in blocks if b.dims == d]
            labels = np.concatenate([b.labels for b in own])
            order = np.argsort(labels, kind="stable")
            rows, ids, vectors = (np.concatenate([getattr(b, x) for b in own])[order] for x in ("rows", "ids", "vectors"))
            self.of[d] = (rows, ids, labels[order], vectors)

    def positives(self, anchors: _Block, k: int) -> Iterator[tuple]:
        """(anchor's place, score, id) of the first k rows of each anchor's label, itself not among them."""
        if anchors.dims not in self.of:
            return
        rows, ids, labels, vectors = self.of[anchors.dims]
        for label in np.unique(anchors.labels):
            at = np.flatnonzero(anchors.labels == label)
            low, best = np.full(len(at), np.iinfo(np.int64).min), [np.empty(0, np.int64)] * 3
            for part in _slices(np.searchsorted(labels, label), np.searchsorted(labels, label, "right")):
                s = Products(vectors[part]).scores(anchors.vectors[at])
                i, j = np.nonzero(s >= low[:, None])
                own = rows[part][j] != anchors.rows[at][i]
                i, j = i[own], j[own]
                best, low = _first([best, (i, s[i, j], ids[part][j])], k, low)
            yield at[best[0]], best[1], best[2]

    def _blocks(self, dims: int) -> list[tuple]:
        """(products, ids, labels) of parts of the candidates in mixed order, made once."""
        if dims not in self.made:
            _, ids, labels, vectors = self.of[dims]
            mixed = np.random.default_rng(len(ids)).permutation(len(ids))
            self.made[dims] = [(Products(vectors[at]), ids[at], labels[at]) for at in (mixed[s] for s in _slices(0, len(ids)))]
        return self.made[dims]

    def negatives(self, anchors: _Block, owner: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> list[np.ndarray]:
        """(band, score, id) of the first k rows of other labels with scores from low to high; owner: a band's anchor."""
        best = [np.empty(0, np.int64)] * 3
        if anchors.dims not in self.of or not len(owner):
            return best
        used, first = np.unique(owner, return_index=True)  # bands of an anchor follow each other
        count, low = np.diff(np.r_[first, len(owner)]), low.copy()
        for products, ids, labels in self._blocks(anchors.dims):
            s = products.scores(anchors.vectors[used])
            near = (s >= np.minimum.reduceat(low, first)[:, None]) & (s <= np.maximum.reduceat(high, first)[:, None])
            i, j = np.nonzero(near)
            other = labels[j] != anchors.labels[used][i]
            i, j = i[other], j[other]
            # each candidate for each band of its anchor
            each = count[i]
            band = np.repeat(first[i] - np.cumsum(each) + each, each) + np.arange(each.sum())
            score, name = np.repeat(s[i, j], each), np.repeat(ids[j], each)
            fits = (score >= low[band]) & (score <= high[band])
            best, low = _first([best, (band[fits], score[fits], name[fits])], k, low)
        return best


def _slices(lo: int, hi: int) -> Iterator[slice]:
    """Small parts first, so that scores which cannot enter are known early."""
    size = 64
    while lo < hi:
        yield slice(lo, min(lo + size, hi))
        lo, size = lo + size, min(2 * size, BLOCK)


def _first(parts: list, k: int, low: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Of (key, score, id): the first k of each key by falling score and rising id, and the least scores that can still enter."""
    key, score, name = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((name, -score, key))
    key, score, name = key[order], score[order], name[order]
    rank = np.arange(len(key)) - np.searchsorted(key, key)
    low = low.copy()
    low[key[rank == k - 1]] = np.maximum(low[key[rank == k - 1]], score[rank == k - 1])
    return [x[rank < k] for x in (key, score, name)], low


def anchor_rows(packed: DataFrame, every: int) -> DataFrame:
    """The anchors of packed blocks, as rows (row, id, label, dims, vector)."""

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = _Block(batch, i)
                at = np.flatnonzero(b.ids % every == 0)
                vectors = pa.array([v.tobytes() for v in b.vectors[at]], pa.binary())
                made = [pa.array(b.rows[at]), pa.array(b.ids[at]), pa.array(b.labels[at]), pa.array(np.full(len(at), b.dims, np.int32)), vectors]
                yield pa.record_batch(made, names=["row", "id", "label", "dims", "vector"])

    return packed.mapInArrow(chosen, "row long, id long, label long, dims int, vector binary")


def _packed_anchors(anchors: DataFrame) -> DataFrame:
    """Anchors (with ``best``, their positives, if they have such a column) as packed blocks."""
    bands = "best" in anchors.columns

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d in np.unique(batch.column("dims").to_numpy()):
                for k in range(0, batch.num_rows, PACK):
                    own = batch.slice(k, PACK)
                    own = own.filter(pc.equal(own.column("dims"), pa.scalar(d, pa.int32())))
                    if not own.num_rows:
                        continue
                    vectors = np.frombuffer(b"".join(own.column("vector").to_pylist()), np.int32)
                    block = _emit(int(d), [tuple(own.column(x).to_numpy() for x in ("row", "id", "label")) + (vectors,)])
                    if bands:
                        best = own.column("best")
                        owner = np.repeat(np.arange(own.num_rows), pc.list_value_length(best).to_numpy())
                        flat = best.flatten()
                        for name, x in (("owner", owner), ("scores", -flat.field("less").to_numpy()), ("names", flat.field("id").to_numpy())):
                            block = block.append_column(name, pa.array([x.astype(np.int64).tobytes()], pa.binary()))
                    yield block

    return anchors.mapInArrow(found, _PACKED + (", owner binary, scores binary, names binary" if bands else ""))


def _meet(candidates: DataFrame, anchors: DataFrame, groups: int, search: Callable, schema: str) -> DataFrame:
    """Each group of candidates meets all blocks of anchors: search(group, anchors' batch, place) gives record batches."""
    extra = [c for c in anchors.columns if c not in candidates.columns]
    left = candidates.withColumn("g", F.pmod(F.xxhash64("rows"), F.lit(groups)).cast("int")).withColumn("kind", F.lit(0))
    left = left.select("*", *[F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in extra])
    right = anchors.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("kind", F.lit(1))
    both = left.unionByName(right).repartition(groups, "g").sortWithinPartitions("g", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blocks, group = None, [], None
        for batch in batches:
            for i, (g, kind) in enumerate(zip(batch.column("g").to_pylist(), batch.column("kind").to_pylist(), strict=True)):
                if g != at:
                    at, blocks, group = g, [], None
                if kind == 0:
                    blocks.append(_Block(batch, i))
                elif blocks:
                    group = group or Group(blocks)
                    yield from search(group, batch, i)

    return both.mapInArrow(run, schema)


def mine_negatives(spark: SparkSession, rows: DataFrame, params: MiningParams | None = None) -> DataFrame:
    """Hard negatives for each anchor (a row whose id ``params.every`` divides) and positive.

    rows: id long, label long, vector. Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    tune(spark)
    p = params or MiningParams()
    packed = materialize(spark, pack_vectors(rows.select("id", "label", "vector"), p.scale), "negatives-packed")
    packed = materialize(spark, numbered(packed), "negatives-rows")
    n = packed.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-n // GROUP), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // PACK)))
    anchors = materialize(spark, anchor_rows(packed, p.every), "negatives-anchors")

    def near(group: Group, batch: pa.RecordBatch, i: int) -> Iterator[pa.RecordBatch]:
        own = _Block(batch, i)
        for at, score, name in group.positives(own, p.positives):
            yield pa.record_batch([pa.array(own.rows[at]), pa.array(score), pa.array(name)], names=["row", "score", "id"])

    found = _meet(packed, _packed_anchors(anchors), groups, near, "row long, score long, id long")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))), 1, p.positives)
    positives = materialize(spark, found.groupBy("row").agg(best.alias("best")), "negatives-positives")

    def banded(group: Group, batch: pa.RecordBatch, i: int) -> Iterator[pa.RecordBatch]:
        own = _Block(batch, i)
        owner, scores, names = (np.frombuffer(batch.column(x)[i].as_buffer(), np.int64) for x in ("owner", "scores", "names"))
        low, high = -((-p.least_percent * scores) // 100), (p.most_percent * scores) // 100
        band, score, name = group.negatives(own, owner, low, high, p.negatives)
        place = band - np.searchsorted(owner, owner)[band]
        at = owner[band]
        made = [own.rows[at], own.ids[at], place, names[band], scores[band], score, name]
        columns = ["row", "anchor_id", "place", "positive_id", "positive_score", "negative_score", "negative_id"]
        yield pa.record_batch([pa.array(x) for x in made], names=columns)

    schema = "row long, anchor_id long, place long, positive_id long, positive_score long, negative_score long, negative_id long"
    hard = _meet(packed, _packed_anchors(anchors.join(positives, "row")), groups, banded, schema)
    ordered = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("negative_score")).alias("less"), "negative_id"))), 1, p.negatives)
    hard = hard.groupBy("row", "place", "anchor_id", "positive_id", "positive_score").agg(ordered.alias("hard"))
    hard = hard.select("anchor_id", "positive_id", "positive_score", F.posexplode("hard").alias("at", "own"))
    return hard.select(
        "anchor_id",
        "positive_id",
        (F.col("at") + 1).alias("rank"),
        F.col("own.negative_id").alias("negative_id"),
        "positive_score",
        (-F.col("own.less")).alias("negative_score"),
    )


def hard_negatives(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    """The rows of ``embeddings`` with the label of every seventh id moved on by one of ten."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), F.col("embedding").alias("vector"))
    return mine_negatives(spark, rows)
