"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns several points of a 64-bit ring; a document belongs to the first point clockwise of
its own hash (of doc_id and the text's checksum), a point included. Every shard has a bound on its
rows, and documents that find a shard full continue clockwise to the next point whose shard has room.
The bounds are the floor and the ceiling of rows over shards, so counts are at most one apart (law
``rows``). With one shard more, rows move to it and, where bounds shift, along the ring; with
``POINTS`` points a shard the shares of the arcs differ little, so few rows overflow.

The ring is cut at every point and at ``CELLS`` even places. Spark counts the rows of each cut; the walk
along the ring runs on those counts (cuts are a fixed number, so they do not grow with the data) and
yields, for each cut, which ranks go to which shard from which slot. The rank of a row within its cut
is then all a row needs. [JVM functions only: no Python code touches a row.]

Defined results: a null text has size 8 and the checksum of the empty text; rows that agree in doc_id
and text are interchangeable; null ids hash as nulls; an empty table gives no rows.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHARDS, POINTS = 24, 256
#: Even parts of the ring, besides the cuts at its points; ranks are found in each and shifted by the counts before it.
CELL_BITS = 14


def ring_points(spark: SparkSession, shards: int, points: int) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, in ring order; positions come from Spark's own hash."""
    nodes = spark.range(shards * points).select(
        F.xxhash64(F.lit("point"), (F.col("id") / points).cast("int"), F.col("id") % points).alias("at"),
        (F.col("id") / points).cast("int").alias("shard"),
    )
    return sorted((r["at"], r["shard"]) for r in nodes.collect())


def walk(counts: list[int], owner: list[int], room: list[int]) -> list[tuple[int, int, int, int]]:
    """Places counts[a] rows of each arc a under the bounds: (arc, first rank, rows, shard).

    Rows first fill the shard that owns their arc, in ring order; what finds it full moves one point
    on, and so on round by round. The bounds sum to the rows, so all rows are placed.
    """
    room, n = list(room), len(owner)
    placed, moving = [], deque((a, a, 0, c) for a, c in enumerate(counts) if c)
    while moving:
        arc, at, rank, c = moving.popleft()
        take = min(c, room[owner[at]])
        if take:
            room[owner[at]] -= take
            placed.append((arc, rank, take, owner[at]))
        if c > take:
            moving.append((arc, (at + 1) % n, rank + take, c - take))
    return placed


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, points: int = POINTS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null for this law)."""
    nodes = ring_points(spark, shards, points)
    arcs = len(nodes)
    keyed = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("doc_id", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("at"),
    )
    # a row's cut: its even part of the ring, and how many points of that part are before it
    shift, by_cell = 64 - CELL_BITS, {}
    for at, _ in nodes:
        by_cell.setdefault((at + (1 << 63)) >> shift, []).append(at)
    before, parts = 0, []
    for c in range(1 << CELL_BITS):
        parts.append((c, before, by_cell.get(c, [])))
        before += len(by_cell.get(c, []))
    first_arc = {c: n for c, n, _ in parts}
    inside = F.broadcast(spark.createDataFrame([(c, p) for c, _, p in parts], "cell int, points array<long>"))
    keyed = keyed.withColumn("cell", F.shiftrightunsigned(F.col("at").bitwiseXOR(F.lit(-(1 << 63))), shift).cast("int")).join(inside, "cell")
    keyed = keyed.withColumn("sub", F.size(F.filter("points", lambda p: p < F.col("at")))).drop("points")
    n_cut = {(r["cell"], r["sub"]): r["n"] for r in keyed.groupBy("cell", "sub").agg(F.count(F.lit(1)).alias("n")).collect()}
    arc_of = {(c, k): (first_arc[c] + k) % arcs for c, k in n_cut}
    counts, base = [0] * arcs, {}
    for cut in sorted(n_cut):
        base[cut] = counts[arc_of[cut]]
        counts[arc_of[cut]] += n_cut[cut]
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    filled, plan = [0] * shards, []
    for arc, first, n, shard in walk(counts, [s for _, s in nodes], room):
        plan.append((arc, first, first + n, shard, filled[shard]))
        filled[shard] += n
    by_arc: dict[int, list[tuple]] = {}
    for p in plan:
        by_arc.setdefault(p[0], []).append(p)
    segments = []
    for cut, before in base.items():
        for _, lo, hi, shard, slot in by_arc[arc_of[cut]]:
            a, b = max(lo, before), min(hi, before + n_cut[cut])
            if a < b:
                segments.append((*cut, a - before, b - before, shard, slot + a - lo))
    table = spark.createDataFrame(segments, "cell int, sub int, lo long, hi long, shard int, first_slot long")
    table = table.groupBy("cell", "sub").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "shard", "first_slot"))).alias("parts"))
    order = Window.partitionBy("cell", "sub").orderBy("at", "doc_id", "text_crc32", "size")
    ranked = keyed.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    part = F.filter("parts", lambda p: (p["lo"] <= F.col("rank")) & (F.col("rank") < p["hi"]))[0]
    return (
        ranked.join(F.broadcast(table), ["cell", "sub"])
        .withColumn("part", part)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            F.col("part.shard").alias("shard"),
            (F.col("part.first_slot") + F.col("rank") - F.col("part.lo")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
