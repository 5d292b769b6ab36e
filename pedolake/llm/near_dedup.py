"""Near-duplicate documents: MinHash bands, odd sketches, and a check on full shingle sets.

A document is its set of distinct shingles of ``NearParams.shingle`` words. Documents are linked if
their sets' Jaccard similarity is ``NearParams.threshold_percent`` or more; classes are the components
of the links. Figures below are those of the default parameters.

1. Equal sets are one class at once, through one aggregation by a 128-bit key of the set.
2. 180 MinHash samples make 30 bands of 6. A pair at the threshold shares no band with probability
   below 1e-6. Bands with two sets or more give candidate groups (components of a star per band).
3. The samples are also folded into an odd sketch, a bitmap of parities. The population count of two
   sketches' XOR estimates the similarity of a candidate pair; what is far below the threshold goes.
4. The remaining pairs are confirmed on the full sets, those of the highest estimate first; a pair
   whose ends are already connected needs no check. Only links that join components are emitted.

Groups are compared in tasks of at most two chunks of ``CHUNK`` sets. In a larger group every chunk is
first compared with itself and with chunk 0; what is then still apart from the largest component is
compared, in blocks, with the rest of the group. No pair of all rows is ever emitted, no group is
gathered in one task, and no candidate is dropped for its group's size.

Equal sets are a node with a number of its own; ids only name the rows and the classes, so they may repeat.

Defined results: null, empty and wordless texts have the empty set and link with nothing; a text of
fewer words than a shingle is one shingle; repeated rows are copies, and rows that share an id are
rows of their own. A null id is below none: a class is named by its least id that is not null. Columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_TABLE, components, local_components, materialize, mix64, release, tune

SKETCH_BITS = 1024
#: Pairs whose estimate is this far below the threshold are not checked: eight standard deviations of 180
#: samples and their sketch, so that a link is passed over with probability below 1e-14.
MARGIN = 0.22


@dataclass(frozen=True)
class NearParams:
    """Words of a shingle, least similarity of a link, bands and samples of each, and margin of the estimates."""

    shingle: int = 3
    threshold_percent: int = 85
    bands: int = 30
    rows: int = 6
    margin: float = MARGIN

    @property
    def samples(self) -> int:
        return self.bands * self.rows


DEFAULT = NearParams()
#: Sets of a chunk; ids up to which a list of candidates is broadcast rather than shuffled.
CHUNK, BROADCAST_ROWS = 512, 1_000_000
#: Words whose hashes a task remembers.
WORDS = 100_000

_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@lru_cache(8)
def _draws(params: NearParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multipliers and summands of the samples, and multipliers of the rows of a band."""
    rng = np.random.default_rng(20_240_501)
    multiply = rng.integers(0, 1 << 32, params.samples, dtype=np.uint32) | np.uint32(1)
    add = rng.integers(0, 1 << 32, params.samples, dtype=np.uint32)
    return multiply, add, rng.integers(0, 1 << 63, params.rows, dtype=np.uint64) | np.uint64(1)


@lru_cache(8)
def _mixers(shingle: int) -> tuple[np.uint64, ...]:
    """An odd number for each place in a shingle."""
    return (*_MIX, *(mix64(np.arange(3, max(3, shingle), dtype=np.uint64)) | np.uint64(1)))[:shingle]


class WordHashes(dict):
    """Hash of each word, remembered; starts anew when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_sets(texts: list[bytes], words: WordHashes, shingle: int = DEFAULT.shingle) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    each = [np.fromiter(map(words.__getitem__, t.translate(LOWER_TABLE).split()), np.uint64) for t in texts]
    out = []
    for h in each:
        if len(h) >= shingle:
            n = len(h) - shingle + 1
            mixed = sum(mix64(h[i : i + n] ^ m) * m for i, m in enumerate(_mixers(shingle)))
            out.append(np.unique(mix64(mixed)))
        elif len(h):
            out.append(mix64(np.array([sum(int(x) * (i + 7) for i, x in enumerate(h)) % (1 << 64)], np.uint64)))
        else:
            out.append(h)
    return out


def samples(shingles: np.ndarray, params: NearParams = DEFAULT) -> np.ndarray:
    """MinHash samples of a set."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    multiply, add, _ = _draws(params)
    least = np.full(params.samples, np.uint32(0xFFFFFFFF))
    for at in range(0, len(low), 1024):
        part = low[at : at + 1024]
        np.minimum(least, (multiply[:, None] * part + add[:, None]).min(1), out=least)
    return least


def band_keys(least: np.ndarray, params: NearParams = DEFAULT) -> np.ndarray:
    """One key for each band of samples."""
    rows = least.astype(np.uint64).reshape(params.bands, params.rows)
    return mix64((rows * _draws(params)[2]).sum(1, dtype=np.uint64) + np.arange(1, params.bands + 1, dtype=np.uint64) * _MIX[0]).view(np.int64)


def odd_sketch(least: np.ndarray) -> bytes:
    """Parities of the samples, folded into a bitmap."""
    bits = mix64(least.astype(np.uint64) + (np.arange(len(least), dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    return np.packbits(np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1).tobytes()


def estimate(a: np.ndarray, b: np.ndarray, params: NearParams = DEFAULT) -> np.ndarray:
    """Similarity from pairs of sketches, given as rows of 64-bit words."""
    odd = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
    left = np.maximum(1 - 2 * odd / SKETCH_BITS, 1e-9)
    return 1 + SKETCH_BITS / (4 * params.samples) * np.log(left)


_BASE = "doc_id long, t long, n_shingles long, k1 long, k2 long, bands array<long>, sketch binary"


def rows_of(docs: DataFrame) -> DataFrame:
    """Id, text as bytes, and a hash of the text; id and hash tell rows of different texts apart."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw.alias("raw")).withColumn("t", F.xxhash64("raw"))


def sketch_documents(docs: DataFrame, params: NearParams = DEFAULT) -> DataFrame:
    """For each row: hash of the text, set size, key of the set, band keys and odd sketch (null for the empty set)."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("t", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())]
    )

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            ids, texts, hashes = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
            n, k1, k2, bands, sketches = [], [], [], [], []
            for s in shingle_sets(texts, words, params.shingle):
                n.append(len(s))
                if len(s):
                    least = samples(s, params)
                    key = xxhash.xxh3_128_digest(s.tobytes())
                    a, b = np.frombuffer(key, np.int64).tolist()
                    k1.append(a), k2.append(b), bands.append(band_keys(least, params)), sketches.append(odd_sketch(least))
                else:
                    k1.append(None), k2.append(None), bands.append(None), sketches.append(None)
            made = [pa.array(v, f.type) for v, f in zip((n, k1, k2, bands, sketches), list(schema)[2:], strict=True)]
            yield pa.record_batch([ids, hashes, *made], schema=schema)
        release()

    return rows_of(docs).mapInArrow(sketch, _BASE)


def sets_of(docs: DataFrame, wanted: DataFrame, n_wanted: int, shingle: int = DEFAULT.shingle) -> DataFrame:
    """Shingle sets of the wanted nodes (node, doc_id, t), made anew from the whole text of one row of each."""
    small = n_wanted <= BROADCAST_ROWS
    texts, wanted = rows_of(docs).alias("d"), wanted.alias("w")
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.t") == F.col("w.t"))
    picked = texts.join(F.broadcast(wanted) if small else wanted, same).select("node", "raw").dropDuplicates(["node"])

    @F.pandas_udf("binary")
    def shingles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = WordHashes()
        for t in batches:
            yield pd.Series([s.tobytes() for s in shingle_sets(list(t), words, shingle)], dtype=object)
        release()

    return picked.select("node", shingles("raw").alias("shingles"))


def confirmed_links(
    sets: list[np.ndarray], bands: np.ndarray, sketches: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray,
    params: NearParams = DEFAULT,
) -> np.ndarray:
    """Links (i, j) that join what label holds apart, each confirmed on full sets, between left and right.

    Pairs that share a band and whose odd sketches do not rule them out are checked in order of their
    estimates, until all that are left are within one component.
    """
    n = np.array([len(s) for s in sets])
    found: list[np.ndarray] = []
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        apart = label[rows][:, None] != label[right][None]
        size_ok = 100 * np.minimum(n[rows][:, None], n[right]) >= params.threshold_percent * np.maximum(n[rows][:, None], n[right])
        near = np.zeros_like(apart)
        for b in range(bands.shape[1]):
            near |= bands[rows, b][:, None] == bands[right, b]
        i, j = np.nonzero(near & apart & size_ok)
        found.append(np.stack((rows[i], right[j])))
    i, j = np.concatenate(found, 1) if found else np.zeros((2, 0), int)
    i, j = np.minimum(i, j), np.maximum(i, j)
    i, j = np.unique(np.stack((i, j)), axis=1) if len(i) else (i, j)
    guess = np.concatenate([estimate(sketches[i[a : a + 65536]], sketches[j[a : a + 65536]], params) for a in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
    keep = guess >= params.threshold_percent / 100 - params.margin
    order = np.argsort(-guess[keep], kind="stable")
    i, j = i[keep][order], j[keep][order]
    _, own = np.unique(label, return_inverse=True)
    links, batch = [], 64
    while len(i):
        apart = own[i] != own[j]
        i, j = i[apart], j[apart]
        head_i, head_j, i, j = i[:batch], j[:batch], i[batch:], j[batch:]
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(head_i, head_j, strict=True)], int)
        yes = 100 * both >= params.threshold_percent * (n[head_i] + n[head_j] - both) if len(head_i) else np.zeros(0, bool)
        if yes.any():
            links.append(np.stack((head_i[yes], head_j[yes]), 1))
            own = local_components(own.max() + 1, own[head_i[yes]], own[head_j[yes]])[own]
        batch = min(4096, batch * 2)
    return np.concatenate(links) if links else np.zeros((0, 2), int)


def _unpacked(pdf: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    sets = [np.frombuffer(b, np.uint64) for b in pdf["shingles"]]
    bands = np.stack([np.asarray(b, np.int64) for b in pdf["bands"]])
    sketches = np.stack([np.frombuffer(b, np.uint64) for b in pdf["sketch"]])
    return sets, bands, sketches, pdf["node"].to_numpy()


def _edges(ids: np.ndarray, links: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": ids[links[:, 0]], "b": ids[links[:, 1]]}, dtype="int64")


def compare_groups(pdf: pd.DataFrame, params: NearParams = DEFAULT) -> pd.DataFrame:
    """Links within each group of a task, or (in a large group) of a chunk with itself and chunk 0."""
    out = [pd.DataFrame({"a": [], "b": []}, dtype="int64")]
    for _, group in pdf.groupby("part", sort=False):
        sets, bands, sketches, ids = _unpacked(group)
        all_ = np.arange(len(ids))
        out.append(_edges(ids, confirmed_links(sets, bands, sketches, all_, all_, all_, params)))
    return pd.concat(out, ignore_index=True)


def compare_blocks(pdf: pd.DataFrame, params: NearParams = DEFAULT) -> pd.DataFrame:
    """Links between the left rows (what is apart from the largest component) and the right rows of a block."""
    sets, bands, sketches, ids = _unpacked(pdf)
    side = pdf["left"].to_numpy()
    label = pdf["label"].to_numpy()
    links = confirmed_links(sets, bands, sketches, label, np.flatnonzero(side), np.arange(len(ids)), params)
    return _edges(ids, links)


def near_classes(spark: SparkSession, docs: DataFrame, params: NearParams = DEFAULT) -> DataFrame:
    """One row per document: doc_id, t (hash of the text), n_shingles, class (null for the empty set), least (its least id)."""
    tune(spark)
    base = materialize(spark, sketch_documents(docs, params), "near-base")
    filled = base.where("n_shingles > 0")
    reps = filled.groupBy("k1", "k2").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "t")).alias("row"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    reps = materialize(spark, reps.withColumn("node", F.monotonically_increasing_id()), "near-sets")
    in_band = reps.select("node", F.explode("bands").alias("band"))
    shared = in_band.groupBy("band").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = materialize(spark, shared, "near-bands")
    stars = in_band.join(shared, "band").select(F.col("node").alias("a"), F.col("first").alias("b"))
    groups = materialize(spark, components(spark, stars, "near-groups"), "near-groups")
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    n_groups = groups.count()
    few = max(8, n_groups // 50_000)  # tasks for what has one row per candidate
    sized = materialize(spark, sizes.coalesce(few), "near-sizes")
    members = groups.join(sized, "component").join(reps.select("node", "row.doc_id", "row.t", "bands", "sketch"), "node")
    members = materialize(spark, members.coalesce(few), "near-members")
    sets = sets_of(docs, members.select("node", "doc_id", "t"), n_groups, params.shingle)
    sets = sets.join(members.select("node", "component", "m", "bands", "sketch"), "node")
    chunks = F.ceil(F.col("m") / CHUNK).cast("int")
    sets = sets.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    sets = materialize(spark, sets, "near-shingles")

    # small groups share tasks; of a large one, chunk 0 goes to every task and each other chunk to one
    tasks = max(64, n_groups // 256)
    small = sets.where("chunks = 1").withColumn("part", F.col("component")).withColumn(
        "task", F.pmod(F.xxhash64("component"), F.lit(tasks)).cast("long")
    )
    parts = F.when(F.col("chunk") == 0, F.sequence(F.lit(1), F.col("chunks") - 1)).otherwise(F.array(F.col("chunk")))
    large = sets.where("chunks > 1").withColumn("part", F.explode(parts.cast("array<bigint>"))).withColumn(
        "task", F.xxhash64("component", "part")
    )
    rows = small.unionByName(large).select("task", "part", "node", "shingles", "bands", "sketch")
    links = materialize(spark, rows.groupBy("task").applyInPandas(lambda pdf: compare_groups(pdf, params), "a long, b long"), "near-links")

    big = sets.where("chunks > 1")
    if not big.isEmpty():
        found = components(spark, links, "near-first").withColumnRenamed("component", "label")
        big = big.join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
        big = materialize(spark, big, "near-big")
        count = big.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n"))
        main = count.groupBy("component").agg(
            F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("others")
        )
        main = materialize(spark, main.where("others > 0"), "near-main")
        rest = big.join(main, "component").withColumn("left_chunks", F.ceil(F.col("others") / CHUNK).cast("int"))
        apart = rest.where("label <> main").withColumn("i", F.pmod(F.xxhash64("node", F.lit(1)), F.col("left_chunks")).cast("int"))
        apart = apart.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("left", F.lit(True))
        against = rest.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("left_chunks") - 1)))
        against = against.withColumn("j", F.col("chunk")).withColumn("left", F.lit(False))
        columns = ["component", "i", "j", "left", "node", "label", "shingles", "bands", "sketch"]
        blocks = apart.select(columns).unionByName(against.select(columns))
        more = blocks.groupBy("component", "i", "j").applyInPandas(lambda pdf: compare_blocks(pdf, params), "a long, b long")
        links = materialize(spark, links.unionByName(more), "near-more")

    classes = components(spark, links, "near-classes")
    of_set = reps.select("k1", "k2", "node", "least").join(classes, "node", "left")
    of_set = materialize(spark, of_set.select("k1", "k2", "least", F.coalesce("component", "node").alias("class")), "near-sets-classes")
    of_class = of_set.groupBy("class").agg(F.min("least").alias("least"))
    of_set = of_set.select("k1", "k2", "class").join(of_class, "class")
    return base.select("doc_id", "t", "n_shingles", "k1", "k2").join(of_set, ["k1", "k2"], "left").drop("k1", "k2")


def near_duplicates(spark: SparkSession, docs: DataFrame, params: NearParams = DEFAULT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least id reachable), kept."""
    out = near_classes(spark, docs, params)
    out = out.select("doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(spark: SparkSession, docs: DataFrame, params: NearParams = DEFAULT) -> DataFrame:
    """All columns of docs, one row of each class: that of the least id (nulls first), of texts under one id
    that of the least hash; rows of the empty set all stay."""
    classes = materialize(spark, near_classes(spark, docs, params).where("class is not null").select("class", "doc_id", "t"), "near-rows")
    pairs = classes.groupBy("class", "doc_id", "t").agg(F.count(F.lit(1)).alias("n"))
    pairs = materialize(spark, pairs, "near-pairs")
    best = pairs.groupBy("class").agg(F.min(F.struct("doc_id", "t", "n")).alias("best"))
    pairs = pairs.join(best, "class").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("t") == F.col("best.t")))
    settled = pairs.select(F.col("doc_id").alias("gone_id"), F.col("t").alias("gone_t"), "stays", "n").where("not stays or n > 1")
    settled = materialize(spark, settled, "near-settled")
    gone, copies = settled.where("not stays"), settled.where("stays")
    keyed = docs.withColumn("gone_key", F.xxhash64(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("gone_id")) & (F.col("gone_key") == F.col("gone_t"))
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    left = keyed.join(small(gone), same, "left_anti")
    if not copies.isEmpty():  # equal rows: one of them stays
        copies = small(copies)
        left = left.join(copies, same, "left_anti").unionByName(left.join(copies, same, "left_semi").dropDuplicates(["doc_id", "gone_key"]))
    return left.drop("gone_key")
