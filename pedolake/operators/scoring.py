"""Scoring: forest quantiles, class probabilities, partial dependence and Shapley attributions."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ..functions.scratch import opened, scratch_path, written


#: Values of a predictor that are tried together on each row.
VALUES = 512
#: Draws of a task, and background rows that it holds for them.
DRAWS, HELD = 1 << 20, 1 << 20
#: Columns of a written background.
BLOCK, ROWS = "__block", "__rows"
#: Bytes of a pickled model that are sent to every executor at most.
MODEL_BYTES = 256 << 20


#: Blocks that a worker holds, the last used one last.
_held: dict[tuple[str, int], tuple[pa.Table, np.ndarray]] = {}


@lru_cache(1)
def _loaded(held):
    return pickle.loads(held.value)


def python_scorer(spark: SparkSession, predict: Callable[[pd.DataFrame], Sequence[float]], columns: Sequence[str], most_bytes: int = MODEL_BYTES) -> Callable[[Mapping[str, Column]], Column]:
    """A scorer for the functions below from any Python model: predict gets the predictors of a batch as a frame of
    doubles (a null is NaN) and gives a number for each row; what is not a number is null.

    The model is pickled, refused beyond most_bytes, sent once to each executor and loaded once by each worker.
    """
    raw = cloudpickle.dumps(predict)
    if len(raw) > most_bytes:
        raise ValueError(f"the model has {len(raw)} bytes, more than {most_bytes}")
    held, names = spark.sparkContext.broadcast(raw), list(columns)

    @F.pandas_udf("double")
    def score(*parts: pd.Series) -> pd.Series:
        rows = pd.DataFrame(dict(zip(names, (p.astype(float) for p in parts), strict=True)))
        out = np.asarray(_loaded(held)(rows), float) if len(rows) else np.zeros(0)
        if out.shape != (len(rows),):
            raise ValueError(f"the model gave {out.shape} numbers for {len(rows)} rows")
        return pd.Series(out)

    return lambda given: score(*[given[c].cast("double") for c in names])


def leaf_values(model, train: DataFrame, target: str, key: str) -> DataFrame:
    """One training value for each (tree, leaf): that of the row with the least hash of its key."""
    leaves = model.transform(train).select(key, target, F.posexplode(vector_to_array(model.getLeafCol())).alias("tree", "leaf"))
    return leaves.groupBy("tree", "leaf").agg(F.min_by(target, F.struct(F.md5(F.concat_ws("-", F.col(key).cast("string"), "tree").cast("binary")), F.col(target))).alias("stored"))


def forest_quantiles(model, rows: DataFrame, stored: DataFrame, key: str, quantiles: Sequence[float]) -> DataFrame:
    """Quantiles, mean and deviation of the stored values of the leaves that each row falls into."""
    if any(not 0 <= q <= 1 for q in quantiles):
        raise ValueError("quantiles must lie in [0, 1]")
    leaves = model.transform(rows).select(key, F.posexplode(vector_to_array(model.getLeafCol())).alias("tree", "leaf"))
    return tree_value_summary(leaves.join(stored, ["tree", "leaf"]), key, "stored", quantiles)


def tree_value_summaries(values: DataFrame, key: str, value: str, what: Sequence[float | tuple[str, Callable[[Column], Column]]]) -> DataFrame:
    """Summaries of the tree values of each row: quantiles in [0, 1], or names with aggregates of one's own."""
    out = []
    for w in what:
        if isinstance(w, tuple):
            out.append(w[1](F.col(value)).alias(w[0]))
        elif 0 <= w <= 1:
            out.append(F.percentile(value, w).alias(f"q{round(100 * w)}"))
        else:
            raise ValueError("quantiles must lie in [0, 1]")
    return values.groupBy(key).agg(*out)


def tree_value_summary(values: DataFrame, key: str, value: str, quantiles: Sequence[float]) -> DataFrame:
    """Summaries of the tree values of each row."""
    q = F.percentile(value, list(quantiles)).alias("q")
    out = values.groupBy(key).agg(q, F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return out.select(key, *[F.col("q")[i].alias(f"q{round(100 * p)}") for i, p in enumerate(quantiles)], "mean", "sd")


def class_probabilities(model, rows: DataFrame, key: str, levels: Sequence[str]) -> DataFrame:
    """One column per class with its probability, and the code (from 1) of the likeliest."""
    p = vector_to_array("probability")
    scored = model.transform(rows)
    return scored.select(key, *[p[i].alias(f"prob_{c}") for i, c in enumerate(levels)], (F.col("prediction") + 1).cast("int").alias("code"))


def partial_dependence(train: DataFrame, name: str, scorer: Callable[[Mapping[str, Column]], Column], columns: Sequence[str], low: float, high: float, delta: bool = False) -> DataFrame:
    """For each training value of a predictor: mean and quantiles of the score over all rows with that value set.

    With delta, the score of each row as it is is taken off first. Every distinct value is a query against
    all rows: values go in blocks of ``VALUES``, each one array, and rows that agree (in the other
    predictors and, with delta, in their own score) are scored once, with their multiplicity.
    """
    values = train.groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))
    n_blocks = -(-max(1, values.count()) // VALUES)
    block = F.pmod(F.xxhash64("value"), F.lit(n_blocks))
    blocks = values.groupBy(block.alias("block")).agg(F.collect_list(F.struct("value", "n_rows")).alias("values"))
    base = scorer({c: F.col(c) for c in columns}) if delta else F.lit(0.0)
    others = train.select(*[c for c in columns if c != name], base.alias("base"))
    others = others.groupBy(*others.columns).agg(F.count(F.lit(1)).alias("weight"))
    others = others.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<bigint>")))
    grid = others.join(blocks, "block").withColumn("v", F.explode("values")).select(*others.columns, "v.value", "v.n_rows")
    score = scorer({c: F.col("value") if c == name else F.col(c) for c in columns})
    scored = grid.withColumn("score", score - F.col("base"))
    out = scored.groupBy("value", "n_rows").agg(
        (F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("mean"), F.percentile("score", [low, high], F.col("weight")).alias("q")
    )
    return out.select("value", "n_rows", "mean", F.col("q")[0].alias("lci"), F.col("q")[1].alias("uci"))


def shapley_linear(rows: DataFrame, background: DataFrame, weights: Mapping[str, float], key: str) -> DataFrame:
    """Exact Shapley values of a linear score: weight times the distance from the background mean."""
    means = background.agg(*[F.avg(c).alias(f"m_{c}") for c in weights])
    phi = F.array(*[F.struct(F.lit(c).alias("feature"), (w * (F.col(c) - F.col(f"m_{c}"))).alias("phi")) for c, w in weights.items()])
    return rows.join(F.broadcast(means)).select(key, F.explode(phi).alias("p")).select(key, "p.*")


def numbered(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, int]:
    """The columns with a dense number from 0 in the order of their hash, and how many rows there are.

    Rows are dealt by ranges of the hash and written once, so that counts and places are of the same
    ranges; equal rows are spread over ranges by a salt, which cannot change what has which number.
    """
    spark = df.sparkSession
    hashed = df.select(*columns).withColumn("_hash", F.xxhash64(*columns)).withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
    ranged = hashed.repartitionByRange("_hash", *columns, "_salt").sortWithinPartitions("_hash", *columns, "_salt")
    at = F.monotonically_increasing_id()
    path = scratch_path(spark, "numbered")
    placed = ranged.select(*columns, F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    offsets, n = [], 0
    for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect():
        offsets.append((r["_part"], n))
        n += r["n"]
    first = spark.createDataFrame(offsets, "_part long, _first long")
    return placed.join(F.broadcast(first), "_part").select(*columns, (F.col("_place") + F.col("_first")).alias("number")), n


def background_blocks(background: DataFrame, features: Sequence[str], n: int, size: int) -> tuple[str, list[int], pa.Table]:
    """The background in blocks of some size rows by the hash of the features, a folder for each, and the rows of each block.

    Equal rows are one row with their number in ROWS: those of a batch at once, so that no task gets all copies of one. Those
    that would be an eighth of a block or more count for none and are given by themselves (at most eight for each block)."""
    count = -(-max(1, n) // size)
    names = list(features)

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one = pa.Table.from_batches([batch]).group_by([BLOCK, *names], use_threads=False).aggregate([([], "count_all")])
                yield from one.rename_columns([BLOCK, *names, ROWS]).combine_chunks().to_batches()

    dealt = background.select(F.pmod(F.xxhash64(*features), F.lit(count)).cast("int").alias(BLOCK), *features)
    few = dealt.mapInArrow(combined, StructType([*dealt.schema, StructField(ROWS, LongType())])).repartition(count, BLOCK)
    path = scratch_path(background.sparkSession, "background")
    few.groupBy(BLOCK, *features).agg(F.sum(ROWS).alias(ROWS)).write.partitionBy(BLOCK).parquet(path)
    schema = StructType([*few.schema[1:], StructField(BLOCK, IntegerType())])
    done, often = background.sparkSession.read.schema(schema).parquet(path), F.col(ROWS) * 8 >= size
    sizes = dict(done.where(~often).groupBy(BLOCK).agg(F.sum(ROWS)).collect())
    return path, [int(sizes.get(k, 0)) for k in range(count)], done.where(often).select(*features, ROWS).orderBy(*features).toArrow()


def _block(path: str, block: int, names: Sequence[str], size: int) -> tuple[pa.Table, np.ndarray]:
    """A block in the order of its features, and how many rows of the background end with each of its rows; the last ones
    that a worker read stay, up to a bound of rows."""
    got = _held.pop((path, block), None)
    if got is None:
        fs, base = opened(path)
        files = [f.path for f in fs.get_file_info(pa.fs.FileSelector(f"{base}/{BLOCK}={block}")) if f.path.endswith(".parquet")]
        rows = pa.concat_tables([pq.read_table(f, filesystem=fs, partitioning=None) for f in sorted(files)])
        rows = rows.filter(pc.less(pc.multiply(rows.column(ROWS), 8), size)).sort_by([(c, "ascending") for c in names])
        got = rows.select(names).combine_chunks(), np.cumsum(rows.column(ROWS).to_numpy())
    _held[path, block] = got
    while len(_held) > 1 and sum(len(ends) for _, ends in _held.values()) > 2 * HELD:
        del _held[next(iter(_held))]
    return got


def _means_in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of their first column: it, and mean and variance of each other column without its nulls."""

    def told(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        counts, out = np.diff(np.append(starts, rows.num_rows)), [rows.column(0).take(pa.array(starts))]
        for c in rows.columns[1:]:
            there, x = c.is_valid().to_numpy(zero_copy_only=False), c.fill_null(0.0).to_numpy(zero_copy_only=False)
            n = np.add.reduceat(there.astype(np.int64), starts)
            mean = np.add.reduceat(x, starts) / np.maximum(n, 1)
            var = np.add.reduceat(np.where(there, (x - np.repeat(mean, counts)) ** 2, 0.0), starts) / np.maximum(n, 1)
            out += [pa.array(mean, mask=n == 0), pa.array(var, mask=n == 0)]
        return pa.record_batch(out, names=[str(i) for i in range(len(out))])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        at = rows.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        starts = np.append(0, np.flatnonzero(at[1:] != at[:-1]) + 1)
        last = int(starts[-1])  # the last key may go on in the next batch
        if last:
            yield told(rows.slice(0, last), starts[:-1])
        held = rows.slice(last)
    if held is not None:
        yield told(held, np.zeros(1, np.int64))


def shapley_monte_carlo(rows: DataFrame, background: DataFrame, scorer: Callable[[Mapping[str, Column]], Column], features: Sequence[str], key: str, draws: int, seed: int) -> DataFrame:
    """Monte-Carlo Shapley values: per draw a background row (each of them with equal chance) and a feature order, both from hashes.

    Rows go to tasks by their keys. For each of its draws a task takes a block of the background, with a chance of its rows,
    and each row of the task any row of that block, or, with their chance, one of the background rows that occur very often:
    all background rows have the same chance in every draw of a row, and its draws do not depend on each other. Tasks read the blocks from where they were written, so no draw is exchanged, and
    a row is summed up where it is."""
    own = written(rows.select(key, *features), "explained")
    back = own if background is rows else written(background.select(*features), "background-rows")
    n, names = back.count(), list(features)
    size = max(1024, HELD // draws)
    path, sizes, often = background_blocks(back, features, n, size)
    parts, ends, often_ends = max(8, -(-own.count() * draws // DRAWS)), np.cumsum(sizes), np.cumsum(often.column(ROWS).to_numpy())
    often, rest = often.select(names), int(ends[-1])

    @F.arrow_udf(StructType([StructField(c, back.schema[c].dataType) for c in names]))
    def drawn(at: pa.Array, place: pa.Array, coin: pa.Array) -> pa.Array:
        at, place, coin = (x.to_numpy(zero_copy_only=False) for x in (at, place, coin))
        blocks = np.where(coin < rest, np.searchsorted(ends, at, side="right"), -1)
        order, tables = np.argsort(blocks, kind="stable"), []
        for block in np.unique(blocks):
            if block < 0:
                tables.append(often.take(np.searchsorted(often_ends, coin[blocks < 0] - rest, side="right")))
            else:
                held, upto = _block(path, int(block), names, size)
                tables.append(held.take(np.searchsorted(upto, place[blocks == block] % upto[-1], side="right")))
        back_at = np.empty(len(order), np.int64)
        back_at[order] = np.arange(len(order))
        got = pa.concat_tables([t.cast(tables[0].schema) for t in tables]).take(back_at).combine_chunks()
        return pa.StructArray.from_arrays([c.chunk(0) for c in got.columns], names=names)

    dealt = own.repartition(parts, key).sortWithinPartitions(key).where(F.lit(n > 0))
    task = F.pmod(F.hash(key), F.lit(parts))  # as rows are dealt
    asked = dealt.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    below = lambda hashed, most: F.pmod(hashed, F.lit(max(most, 1)).cast("long"))
    at = below(F.xxhash64(task, "draw", F.lit(seed), F.lit("block")), rest)
    coin = below(F.xxhash64(key, "draw", F.lit(seed), F.lit("often")), n)
    wide = asked.withColumn("__b", drawn(at, F.xxhash64(key, "draw", F.lit(seed)), coin)).select("*", *[F.col("__b")[c].alias(f"b_{c}") for c in features])
    order = {c: F.xxhash64(F.col(key), F.col("draw"), F.lit(seed), F.lit(c)) for c in features}
    phi = []
    for i, f in enumerate(features):
        mixed = {c: F.when(order[c] < order[f], F.col(c)).otherwise(F.col(f"b_{c}")) for c in features if c != f}
        phi.append((scorer({**mixed, f: F.col(f)}) - scorer({**mixed, f: F.col(f"b_{f}")})).alias(f"__phi{i}"))
    sums = StructType([rows.schema[key], *[StructField(f"{name}{i}", DoubleType()) for i in range(len(features)) for name in ("phi", "var")]])
    whole = wide.select(key, *phi).mapInArrow(_means_in_turn, sums)
    of = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"phi{i}").alias("phi"), F.col(f"var{i}").alias("var")) for i, f in enumerate(features)])
    return whole.select(key, F.explode(of).alias("p")).select(key, "p.*")


def shapley_adjust(phi: DataFrame, scores: DataFrame, key: str, baseline: float) -> DataFrame:
    """Spreads what the values miss of score less baseline over the features by their variances (feature, phi, var)."""
    total = phi.groupBy(key).agg(F.sum("phi").alias("s"), F.max("var").alias("vmax"))
    v = F.coalesce(F.try_divide(F.col("var"), F.col("vmax")), F.lit(0.0)) * 1e6
    long = phi.join(total, key).join(scores, key).withColumn("v", v).withColumn("err", F.col("score") - F.col("s") - baseline)
    sums = long.groupBy(key).agg(F.sum("v").alias("vs"))
    out = long.join(sums, key)
    adjusted = F.col("phi") + F.col("err") * (F.col("v") - F.col("v") * F.col("vs") / (1 + F.col("vs")))
    return out.select(key, "feature", "phi", adjusted.alias("phi_adjusted"))
