"""Exact threshold pairs of embeddings by dual traversal of cover trees.

Vectors are normalised in double precision, so cosine is a matter of Euclidean distance. A cover tree has
nested levels of halving radii: a node's own centre is its first child, further children are more than
half the radius apart and cover the rest. Two trees are gone down together, all pairs of a level at
once, and a pair of nodes is dropped where its centres are farther apart than the reach and both
covering radii; what is left at the bottom are pairs of vectors, compared in double precision.

1. The upper levels come from a cover tree over a bounded sample (``SAMPLE`` vectors): its deepest level
   of at most the wanted number of nodes, which grows with the table. Every vector goes to the nearest
   of them, and covering radii are measured over all vectors.
2. Nodes are packed into blocks of at most ``BLOCK`` vectors (a larger node is cut by hash). A block is one
   row: its vectors as bytes, and the cover tree below, built once.
3. Block centres are sent out in chunks of bounded size, and each block tells which others come near
   enough by both radii. Each task gets one block and at most ``PARTNERS`` of those, and goes down the
   trees in pairs.

No pair is emitted: a task returns for each vector its number of links, and a spanning forest of the
links, from which components follow. Equal vectors are compared once and counted with multiplicity;
they are nodes with numbers of their own, so ids may repeat.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing and are a component of their own; vectors of different lengths do not link; rows that share an
id are rows of their own, and a null id is below none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, local_components, materialize, tune

COSINE = 0.9
#: Vectors sampled for the upper levels, nodes of them at most, vectors of a block, and blocks that a task
#: holds against one.
SAMPLE, NODES, BLOCK, PARTNERS = 4096, 1024, 4096, 8
#: Bytes of block centres that are sent out at once, pairs of nodes looked at together, and the slack that
#: keeps bounds safe against rounding.
CENTRE_BYTES, FRONTIER, SLACK = 32 << 20, 1 << 20, 1e-6


def reach(cosine: float) -> float:
    """Distance of unit vectors at that cosine."""
    return float(np.sqrt(max(0.0, 2 - 2 * cosine)))


def unit(v: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so no square overflows or vanishes."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    d = a @ b.T
    d *= -2
    d += 2
    return np.sqrt(np.maximum(d, 0, out=d), out=d)


class CoverTree:
    """Nodes of nested levels: centre (a row of x), covering radius, and the children, which follow each other.

    Node 0 is the root. A leaf has no children and stands for its centre alone.
    """

    def __init__(self, centre: np.ndarray, radius: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.centre, self.radius, self.first, self.last = centre, radius, first, last

    @classmethod
    def build(cls, x: np.ndarray) -> CoverTree:
        """Tree over the rows of x, level by level from radius 2 down."""
        apart = distances(x.astype(np.float32), x.astype(np.float32))
        centre, radius, first, last = [0], [0.0], [0], [0]
        open_ = [(0, np.arange(len(x)), 2.0)]
        while open_:
            below = []
            for node, members, scale in open_:
                gap = np.linalg.norm(x[members] - x[centre[node]], axis=1)
                radius[node] = float(gap.max())
                if len(members) == 1:
                    continue
                while scale > max(radius[node], 1e-9):  # levels with the node's own centre alone
                    scale /= 2
                kids, owner = cover(apart, members, int(np.searchsorted(members, centre[node])), scale)
                first[node], last[node] = len(centre), len(centre) + len(kids)
                for k, kid in enumerate(kids):
                    below.append((len(centre), members[owner == k], scale / 2))
                    centre.append(int(members[kid])), radius.append(0.0), first.append(0), last.append(0)
            open_ = below
        return cls(np.array(centre, np.int32), np.array(radius), np.array(first, np.int32), np.array(last, np.int32))

    def level(self, most: int) -> np.ndarray:
        """Nodes of the deepest level (leaves above it included) of at most that many nodes."""
        nodes = np.array([0])
        while True:
            inner = self.last[nodes] > self.first[nodes]
            deeper = np.concatenate([nodes[~inner], *[np.arange(self.first[i], self.last[i]) for i in nodes[inner]]])
            if not inner.any() or len(deeper) > most:
                return nodes
            nodes = deeper


def cover(apart: np.ndarray, members: np.ndarray, own: int, scale: float) -> tuple[list[int], np.ndarray]:
    """Places of members more than half the scale apart that cover the rest, the node's own first; who covers each.

    Where that leaves one alone although the others differ, half the scale is halved again."""
    while True:
        kids, owner = [own], np.zeros(len(members), np.int64)
        gap = apart[members[own], members].copy()
        gap[own] = 0
        while True:
            i = int(gap.argmax())
            if gap[i] <= scale / 2:
                break
            d = apart[members[i], members]
            closer = d < gap
            closer[i] = True
            owner[closer], gap[closer] = len(kids), d[closer]
            gap[i] = 0
            kids.append(i)
        if len(kids) > 1:
            return kids, owner
        if scale < 1e-6:  # as good as equal: each is a child
            return [own, *[i for i in range(len(members)) if i != own]], _each(len(members), own)
        scale /= 2


def _each(n: int, own: int) -> np.ndarray:
    owner = np.zeros(n, np.int64)
    owner[np.delete(np.arange(n), own)] = np.arange(1, n)
    return owner


def _children(tree: CoverTree, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of nodes (a leaf is its own), and which of the nodes each belongs to."""
    n = np.maximum(tree.last[nodes] - tree.first[nodes], 1)
    at = np.repeat(np.arange(len(nodes)), n)
    step = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    leaf = tree.last[nodes] == tree.first[nodes]
    return np.where(leaf[at], nodes[at], tree.first[nodes[at]] + step), at


def near_leaves(a: CoverTree, x: np.ndarray, b: CoverTree, y: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of x and y that the bounds cannot drop, by going down both trees; of a tree against
    itself each pair once and none of a row with itself."""
    same = a is b
    stack = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        p, q = stack.pop()
        p_kids, p_of = _children(a, p)
        q_kids, q_of = _children(b, q)
        n = np.bincount(p_of, minlength=len(p)) * np.bincount(q_of, minlength=len(q))
        if n.sum() > FRONTIER and len(p) > 1:
            half = len(p) // 2
            stack += [(p[:half], q[:half]), (p[half:], q[half:])]
            continue
        p_cut, q_cut = np.searchsorted(p_of, np.arange(len(p) + 1)), np.searchsorted(q_of, np.arange(len(q) + 1))
        kept = []
        big = n > 4096
        for k in np.flatnonzero(big):
            i, j = p_kids[p_cut[k] : p_cut[k + 1]], q_kids[q_cut[k] : q_cut[k + 1]]
            for at in range(0, len(i), 512):
                part = i[at : at + 512]
                near = distances(x[a.centre[part]], y[b.centre[j]]) <= limit + SLACK + a.radius[part][:, None] + b.radius[j]
                if same and p[k] == q[k]:
                    near &= part[:, None] <= j
                u, v = np.nonzero(near)
                kept.append((part[u], j[v]))
        small = np.flatnonzero(~big)
        if len(small):
            which = np.repeat(small, n[small])
            step = np.arange(len(which)) - np.repeat(np.cumsum(n[small]) - n[small], n[small])
            width = (q_cut[which + 1] - q_cut[which]).astype(np.int64)
            i, j = p_kids[p_cut[which] + step // width], q_kids[q_cut[which] + step % width]
            far = np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("ij,ij->i", x[a.centre[i]], y[b.centre[j]])))
            near = far <= limit + SLACK + a.radius[i] + b.radius[j]
            if same:
                near &= (p[which] != q[which]) | (i <= j)
            kept.append((i[near], j[near]))
        i, j = (np.concatenate(z) for z in zip(*kept, strict=True))
        done = (a.last[i] == a.first[i]) & (b.last[j] == b.first[j])
        u, v = a.centre[i[done]], b.centre[j[done]]
        if same:
            u, v = u[u != v], v[u != v]
        if len(u):
            yield u, v
        if not done.all():
            stack.append((i[~done], j[~done]))


def links_of(a: CoverTree, x: np.ndarray, wx: np.ndarray, b: CoverTree, y: np.ndarray, wy: np.ndarray, cosine: float):
    """Numbers of linked vectors (by weight) of the rows of x and of y, and a spanning forest of the links as
    pairs of rows, those of y counted on from those of x (of a tree against itself: of x alone)."""
    same, edges, held = a is b, [], 0
    nx, ny = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    total = len(x) if same else len(x) + len(y)
    for u, v in near_leaves(a, x, b, y, reach(cosine)):
        yes = np.einsum("ij,ij->i", x[u], y[v]) >= cosine
        u, v = u[yes], v[yes]
        np.add.at(nx, u, wy[v])
        np.add.at(nx if same else ny, v, wx[u])
        edges.append(np.stack((u, v if same else v + len(x)), 1))
        held += len(u)
        if held > FRONTIER:
            edges, held = [forest(total, np.concatenate(edges))], 0
    return nx, ny, forest(total, np.concatenate(edges)) if edges else np.zeros((0, 2), int)


def forest(n: int, edges: np.ndarray) -> np.ndarray:
    """Edges from each linked node to the least node of its component."""
    label = local_components(n, edges[:, 0], edges[:, 1])
    inner = np.flatnonzero(label != np.arange(n))
    return np.stack((inner, label[inner]), 1)


def usable() -> F.Column:
    """Whether a vector can link at all."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda c: c != 0), F.lit(False))


def threshold_join(spark: SparkSession, vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (least id reachable), kept."""
    tune(spark)
    fine = vectors.where(usable()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    classes = fine.groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"))
    classes = classes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("v")).withColumn("key", F.xxhash64("v"))
    classes = materialize(spark, classes, "join-classes")
    found = None
    for dim in [r["dim"] for r in classes.select("dim").distinct().orderBy("dim").collect()]:
        one = _join_dimension(spark, classes.where(F.col("dim") == dim), cosine)
        found = one if found is None else found.unionByName(one)
    per = classes.select("node", "v", "least", "weight")
    if found is None:
        per = per.withColumn("n", F.lit(0).cast("long")).withColumn("class", F.col("node"))
    else:
        found = materialize(spark, found, "join-found")
        edges = found.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b"))
        linked = components(spark, edges, "join-components").withColumnRenamed("component", "class")
        counts = found.groupBy("node").agg(F.sum("n").alias("n"))
        per = per.join(counts, "node", "left").join(linked, "node", "left")
        per = per.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("class", F.coalesce("class", "node"))
    per = materialize(spark, per, "join-nodes")
    least = per.groupBy("class").agg(F.min("least").alias("component_id"))
    per = per.join(least, "class").select("v", (F.col("n") + F.col("weight") - 1).alias("n_links"), "component_id")
    linked = fine.join(per, "v").select("vec_id", "n_links", "component_id")
    alone = vectors.where(~usable()).select(F.col("vec_id").cast("long").alias("vec_id"))
    alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


_BLOCK = "block long, nodes binary, weights binary, vectors binary, centre binary, radius binary, first binary, last binary"
_FOUND = "node long, n long, to long"


def _pack_block(table: pa.Table, centres: np.ndarray) -> pa.Table:
    """A block's row: its vectors, their tree, and (as the first radius) how far the block reaches from its centre."""
    dim = centres.shape[1]
    v = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
    tree = CoverTree.build(unit(v))
    raw = lambda x, kind: pa.array([np.ascontiguousarray(x, kind).tobytes()], pa.binary())
    lossless = v.astype(np.float32)
    return pa.table(
        {
            "block": table.column("block").slice(0, 1),
            "nodes": raw(table.column("node").to_numpy(), np.int64),
            "weights": raw(table.column("weight").to_numpy(), np.int64),
            "vectors": raw(lossless, np.float32) if (lossless == v).all() else raw(v, np.float64),
            "centre": raw(tree.centre, np.int32),
            "radius": raw(tree.radius, np.float64),
            "first": raw(tree.first, np.int32),
            "last": raw(tree.last, np.int32),
        }
    )


def _open_block(row: dict, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, CoverTree]:
    nodes, weights = np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["weights"], np.int64)
    kind = np.float32 if len(row["vectors"]) == 4 * dim * len(nodes) else np.float64
    x = unit(np.frombuffer(row["vectors"], kind).reshape(-1, dim).astype(float))
    parts = [np.frombuffer(row[c], t) for c, t in (("centre", np.int32), ("radius", np.float64), ("first", np.int32), ("last", np.int32))]
    return nodes, weights, x, CoverTree(*parts)


def _join_dimension(spark: SparkSession, own: DataFrame, cosine: float) -> DataFrame:
    """Link counts and forest edges (node, n, to) of distinct vectors of one length."""
    sample = unit(np.array([r["v"] for r in own.orderBy("key", "node").limit(SAMPLE).select("v").collect()]))
    upper, dim = CoverTree.build(sample), sample.shape[1]
    wanted = min(NODES, max(1, own.count() // (BLOCK // 4)))
    centres = sample[upper.centre[upper.level(wanted)]]
    shared = spark.sparkContext.broadcast(centres)

    @F.pandas_udf("int")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vs in batches:
            u = unit(np.stack([np.asarray(v, float) for v in vs])) if len(vs) else np.zeros((0, dim))
            yield pd.Series((u @ shared.value.T).argmax(1), dtype="int32")

    placed = materialize(spark, own.select("node", "weight", "v", "key", nearest("v").alias("at")), "join-placed")
    # nodes packed into blocks; a node of more than a block's vectors gets blocks of its own
    blocks_of, block, room = [], -1, 0
    for r in placed.groupBy("at").agg(F.count(F.lit(1)).alias("n")).orderBy("at").collect():
        if r["n"] > BLOCK:
            k = -(-r["n"] // (BLOCK * 3 // 4))
            blocks_of.append((r["at"], block + 1, k))
            block, room = block + k, 0
        else:
            if room < r["n"]:
                block, room = block + 1, BLOCK
            blocks_of.append((r["at"], block, 1))
            room -= r["n"]
    table = F.broadcast(spark.createDataFrame(blocks_of, "at int, first_block long, k long"))  # NODES rows at most
    placed = placed.join(table, "at").withColumn("block", F.col("first_block") + F.pmod(F.col("key"), F.col("k")))
    blocks = placed.select("block", "node", "weight", "v").groupBy("block").applyInArrow(lambda t: _pack_block(t, shared.value), _BLOCK)
    blocks = materialize(spark, blocks, "join-blocks")

    # which blocks come near: every block against the centres of all, a chunk of centres at a time
    chunks = -(-(block + 1) * dim * 8 // CENTRE_BYTES)
    balls = materialize(spark, blocks.mapInArrow(lambda it: _balls(it, dim), "block long, centre binary, radius double"), "join-balls")
    plan = None
    for c in range(chunks):
        rows = balls.where(F.pmod("block", F.lit(chunks)) == c).collect()
        some = spark.sparkContext.broadcast(
            (np.array([r["block"] for r in rows]), np.stack([np.frombuffer(r["centre"]) for r in rows]), np.array([r["radius"] for r in rows]))
        )
        one = balls.mapInArrow(lambda it, some=some: _near_blocks(it, some.value, reach(cosine)), "i long, j long")
        plan = one if plan is None else plan.unionByName(one)
    plan = plan.withColumn("task", F.floor(F.row_number().over(Window.partitionBy("i").orderBy("j")) / PARTNERS).cast("long"))
    plan = materialize(spark, plan, "join-plan")
    left = plan.select("i", "task").distinct().join(blocks.withColumnRenamed("block", "i"), "i").withColumn("j", F.col("i"))
    right = plan.where("i <> j").join(blocks.withColumnRenamed("block", "j"), "j")
    sides = left.withColumn("first_of", F.lit(True)).unionByName(right.withColumn("first_of", F.lit(False)))
    own_pair = plan.where("i = j").select("i", "task", F.lit(True).alias("inner"))
    sides = sides.join(own_pair, ["i", "task"], "left").withColumn("inner", F.coalesce("inner", F.lit(False)))
    return sides.groupBy("i", "task").applyInArrow(lambda t: _compare(t, dim, cosine), _FOUND)


def _balls(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Centre and covering radius of each block."""
    for batch in batches:
        for row in batch.to_pylist():
            _, _, x, tree = _open_block(row, dim)
            columns = [pa.array([row["block"]]), pa.array([x[tree.centre[0]].tobytes()], pa.binary()), pa.array([float(tree.radius[0])])]
            yield pa.record_batch(columns, names=["block", "centre", "radius"])


def _near_blocks(batches: Iterator[pa.RecordBatch], some: tuple, limit: float) -> Iterator[pa.RecordBatch]:
    """Pairs (i, j), i <= j, of blocks whose balls come near enough."""
    ids, centres, radius = some
    for batch in batches:
        for row in batch.to_pylist():
            d = distances(np.frombuffer(row["centre"])[None], centres)[0]
            j = ids[(d <= limit + SLACK + row["radius"] + radius) & (ids >= row["block"])]
            yield pa.record_batch([pa.array(np.full(len(j), row["block"])), pa.array(j)], names=["i", "j"])


def _compare(table: pa.Table, dim: int, cosine: float) -> pa.Table:
    """Links of one block with itself (where the task has that pair) and with its partners."""
    rows = table.to_pylist()
    mine = next(r for r in rows if r["first_of"])
    nodes, weights, x, tree = _open_block(mine, dim)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    if mine["inner"]:
        n, _, edges = links_of(tree, x, weights, tree, x, weights, cosine)
        out.append((nodes, n, nodes[edges[:, 0]], nodes[edges[:, 1]]))
    for r in rows:
        if not r["first_of"]:
            other, w, y, below = _open_block(r, dim)
            nx, ny, edges = links_of(tree, x, weights, below, y, w, cosine)
            both = np.concatenate((nodes, other))
            out.append((both, np.concatenate((nx, ny)), both[edges[:, 0]], both[edges[:, 1]]))
    ids = np.concatenate([o[0][o[1] > 0] for o in out] + [o[2] for o in out]) if out else np.zeros(0, np.int64)
    n = np.concatenate([o[1][o[1] > 0] for o in out] + [np.zeros(len(o[2]), np.int64) for o in out]) if out else ids
    to = [None] * sum(int((o[1] > 0).sum()) for o in out) + [int(t) for o in out for t in o[3]]
    return pa.table({"node": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64()), "to": pa.array(to, pa.int64())})
