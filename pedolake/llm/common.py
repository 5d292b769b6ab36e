"""Helpers that the training-data operators share: scratch tables, text normalisers, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a batch sent to a Python worker may hold; long texts then come in small batches.
BATCH_BYTES = 4 << 20

_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
#: A-Z to a-z, all other bytes as they are.
LOWER_TABLE = bytes.maketrans(_UPPER, _LOWER)
#: Also every ASCII byte but 0-9 and a-z to a space; bytes of 128 and more belong to words.
WORD_TABLE = bytes(
    32 if b < 128 and not (48 <= b <= 57 or 97 <= b <= 122) else b for b in LOWER_TABLE
)
#: A-Z to a-z, and \x09-\x0D to a space: what bytes.split() then splits at.
SPACE_TABLE = bytes(32 if 9 <= b <= 13 else b for b in LOWER_TABLE)


def tune(spark: SparkSession) -> SparkSession:
    """Bounds the batches that go to Python workers by bytes, not by rows alone, and lets workers import this package."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, below a folder made here, but only on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@lru_cache(1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="pedolake-")


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared scratch folder and reads it again: lineage ends in files all executors see."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_HELD: dict = {}


def worker_holds(key: tuple, make: Callable):
    """What make() gives; this worker keeps it from task to task, until something else is asked for."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Drops what this worker holds, and gives freed memory back to the system: idle workers stay for the next task."""
    _HELD.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def pack(values: np.ndarray) -> bytes:
    """Integers to compressed bytes; planes of equal significance stand together, so small values cost little."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    """The integers that pack() was given."""
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned integers, stored as differences."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes, dtype) -> np.ndarray:
    return np.cumsum(unpack(data, dtype), dtype=dtype)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes, over the edges a[i]-b[i]."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
    return label


#: Edges that one task of a component round handles; rounds on few edges then use few tasks.
EDGES_PER_TASK = 100_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of each batch as stars: every node to the least node it reaches within the batch."""
    for batch in batches:
        ids, at = np.unique(np.concatenate([batch.column(k).to_numpy() for k in range(2)]), return_inverse=True)
        label = local_components(len(ids), *np.split(at, 2))
        inner = np.flatnonzero(label != np.arange(len(ids)))
        yield pa.record_batch([pa.array(ids[inner]), pa.array(ids[label[inner]])], names=["u", "v"])


def components(spark: SparkSession, edges: DataFrame, name: str) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, component), component the least id.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until every node points at
    a root. Each step groups by node with partial minima and joins the minimum back, so a hub costs
    one row for each of its edges and no list is built. Only nodes with an edge to another node are
    returned. Every round is written to the shared scratch folder.
    """
    edges = edges.where("a <> b and a is not null and b is not null").select("a", "b")
    edges = materialize(spark, edges.mapInArrow(_contracted, "u long, v long").distinct(), f"{name}-edges")
    while True:
        tasks = max(8, -(-edges.count() // EDGES_PER_TASK))
        kept = lambda df, step: materialize(spark, df.coalesce(tasks), f"{name}-{step}")  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written first: both sides of the join are then exchanged, and a hub can be split
        low = kept(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = kept(large.where("u <> v"), "large")
        low = kept(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = kept(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "round")
        # done when each node has one edge, and to a node that has none
        n, nodes = edges.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
        if n == nodes and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
