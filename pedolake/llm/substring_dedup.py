"""Exact removal of repeated substrings, by suffix arrays of shards.

A byte goes if it is covered by a string of ``length`` bytes that also starts elsewhere in the corpus,
the same document included; strings are judged on the input. Matches never cross documents.

1. Every window of length bytes picks its least-hashed run of ``GRAM`` bytes (the leftmost of equals), so
   equal windows pick equal bytes. Neighbouring windows with one pick are a run; its span is all they
   cover. Documents are packed into blocks, and Spark counts each block's distinct (pick, span) pairs.
2. A pick that stands once repeats nowhere. Where all spans of a pick are equal, all its windows repeat.
   What is left are picks with several spans: edges of passages and places near an edit.
3. One copy of each such span goes to a shard with the other spans of its pick. The shard's suffix array
   (induced sorting) and permuted common prefixes give its classes of equal windows; windows in a class
   of two or more repeat. A pick of more than ``HOT`` spans is dealt over several shards, and a row for
   each class of those tells which classes other shards hold too.
4. Each block gets what holds for its pairs, and cuts its documents.

A text is read once and kept compressed with its block; no row is made for each byte or window but in
shards of hot picks. Blocks and shards are bounded by bytes; within a block a pair is one row, however
many copies it has. A single text larger than a block is a block, and one larger than ``CHUNK`` is
hashed in pieces. Picks and spans are told apart by 64 bits each of two hashes of different bytes.

Defined results: null and empty texts, and those shorter than length, lose nothing (a null text counts
as empty); repeated rows are copies of each other; columns other than doc_id and text are ignored
unless named in ``carry``, and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, mix64, pack, release, tune, unpack
from .suffix_array import common_prefixes, suffix_array

LENGTH, GRAM = 200, 64
#: Bytes of text of a block and of a shard; bytes hashed at once (a power of two).
BLOCK_BYTES, SHARD_BYTES, CHUNK = 4 << 20, 1 << 20, 1 << 18
#: Spans of one pick that a shard takes; more are dealt over several.
HOT = 2048
#: Odd multipliers of the rolling hashes.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


@lru_cache(2)
def _powers(base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    letters = mix64(np.arange(256, dtype=np.uint64) + np.uint64(base))
    inverse = pow(base, -1, 1 << 64)
    up, down = (np.cumprod(np.full(CHUNK, b, np.uint64)) for b in (base, inverse))
    return letters, up, down


def rolling(text: np.ndarray, k: int, base: int = _BASES[0]) -> np.ndarray:
    """Hash of each run of k bytes; equal runs have equal hashes wherever they stand."""
    letters, up, down = _powers(base)
    out = np.empty(max(0, len(text) - k + 1), np.uint64)
    step = CHUNK - k
    for at in range(0, len(out), step):
        part = text[at : at + step + k - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(letters[part] * up[: len(part)], out=sums[1:])
        m = len(part) - k + 1
        out[at : at + m] = mix64((sums[k:] - sums[:-k]) * down[:m])
    return out


def pieces(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of length bytes and more, joined to at most CHUNK bytes: bytes, piece of each byte, and for
    each piece its text and offset. Longer texts come in overlapping pieces that share no window."""
    held, size = [], 0

    def joined():
        lengths = [len(b) for _, _, b in held]
        return (
            np.frombuffer(b"".join(b for _, _, b in held), np.uint8),
            np.repeat(np.arange(len(held)), lengths),
            np.array([d for d, _, _ in held]),
            np.array([o for _, o, _ in held]),
        )

    for d, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, CHUNK - length):
            part = text[at : at + CHUNK - 1]
            if size + len(part) >= CHUNK:
                yield joined()
                held, size = [], 0
            held.append((d, at, part))
            size += len(part)
    if held:
        yield joined()


def picks(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> pd.DataFrame:
    """Runs of windows that pick the same bytes: text, first window, windows, key of what is picked."""
    out = []
    for data, piece, text_of, offset in pieces(texts, length):
        hashes = rolling(data, gram)
        least = (hashes >> np.uint64(20) << np.uint64(20)) | np.arange(len(hashes), dtype=np.uint64)
        width, reach = length - gram + 1, 1
        while reach * 2 <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if width > reach:
            least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
        picked = (least & np.uint64(CHUNK - 1)).astype(np.int64)
        inside = piece[: len(picked)] == piece[length - 1 : length - 1 + len(picked)]
        new = (picked[1:] != picked[:-1]) | (inside[1:] != inside[:-1])
        starts = np.concatenate(([0], np.flatnonzero(new) + 1))
        n = np.diff(np.append(starts, len(picked)))
        starts, n = starts[inside[starts]], n[inside[starts]]
        first_byte = np.searchsorted(piece, np.arange(len(text_of)))
        p = piece[starts]
        out.append(
            pd.DataFrame({"text": text_of[p], "first": starts - first_byte[p] + offset[p], "n": n, "key": hashes[picked[starts]]})
        )
    if not out:
        return pd.DataFrame({"text": [], "first": [], "n": [], "key": np.zeros(0, np.uint64)}).astype({"text": int, "first": int, "n": int})
    return pd.concat(out, ignore_index=True)


class Block:
    """Texts of a block, one after another with a byte between, and its runs of windows with one pick."""

    def __init__(self, texts: list[bytes], length: int):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.joined, self.starts = b"\0".join(texts), np.cumsum(sizes + 1) - sizes - 1
        runs = picks(texts, length, min(GRAM, length))
        self.first = (runs["first"].to_numpy() + self.starts[runs["text"].to_numpy()]).astype(np.int32)
        self.n = runs["n"].to_numpy().astype(np.int32)
        view = memoryview(self.joined)
        digest = xxhash.xxh3_64_intdigest
        ends = (self.first + self.n + (length - 1)).tolist()
        spans = np.fromiter((digest(view[a:b]) for a, b in zip(self.first.tolist(), ends, strict=True)), np.uint64, len(ends))
        key = runs["key"].to_numpy()
        order = np.lexsort((spans, key))
        key, spans = key[order], spans[order]
        new = np.ones(len(order), bool)
        new[1:] = (key[1:] != key[:-1]) | (spans[1:] != spans[:-1])
        #: the block's distinct pairs, how often each stands, and the pair of each run
        self.picks, self.spans = key[new].view(np.int64), spans[new].view(np.int64)
        self.many = np.diff(np.append(np.flatnonzero(new), len(order))).astype(np.int32)
        self.pair = np.empty(len(order), np.int32)
        self.pair[order] = np.cumsum(new) - 1


def _blocks_schema(docs: DataFrame) -> tuple[str, list[str]]:
    own = [f for f in docs.schema if f.name == "doc_id" or f.name.startswith("carry_")]
    lists = ", ".join(f"{f.name} array<{f.dataType.simpleString()}>" for f in own)
    fixed = "block long, lengths array<long>, texts binary, first binary, n binary, pair binary, picks array<long>, spans array<long>, many array<int>"
    return f"{lists}, {fixed}", [f.name for f in own]


def coded_blocks(docs: DataFrame, length: int) -> DataFrame:
    """One row per block: its documents' columns as arrays, its texts compressed, its runs and pairs."""
    (schema, own), most = _blocks_schema(docs), BLOCK_BYTES

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def emit() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            texts = table.column("raw").to_pylist()
            block = Block(texts, length)
            one = lambda name: pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), table.column(name).combine_chunks())
            many = lambda values, kind: pa.array([values], pa.list_(kind))
            columns = {name: one(name) for name in own} | {
                "block": pa.array([part << 32 | made], pa.int64()),
                "lengths": many(np.array([len(t) for t in texts], np.int64), pa.int64()),
                "texts": pa.array([zstandard.ZstdCompressor(level=3).compress(block.joined)], pa.binary()),
                "first": pa.array([pack(block.first)], pa.binary()),
                "n": pa.array([pack(block.n)], pa.binary()),
                "pair": pa.array([pack(block.pair)], pa.binary()),
                "picks": many(block.picks, pa.int64()),
                "spans": many(block.spans, pa.int64()),
                "many": many(block.many, pa.int32()),
            }
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            held.append(batch)
            size += batch.column(batch.schema.get_field_index("raw")).nbytes
            if size >= most:
                yield emit()
                made, held, size = made + 1, [], 0
        if held:
            yield emit()
        held.clear()
        release()

    return docs.mapInArrow(code, schema)


def freed(make: Callable[..., pa.Table], *given) -> pa.Table:
    """What make gives, after the memory that it took has been given back."""
    out = make(*given)
    release()
    return out


def _texts_of(row: pa.Table) -> bytes:
    return zstandard.ZstdDecompressor().decompress(row.column("texts")[0].as_py())


def _runs_of(row: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(unpack(row.column(c)[0].as_py(), np.int32) for c in ("first", "n", "pair"))


def span_bytes(block: pa.Table, wanted: pa.Table, length: int) -> pa.Table:
    """The bytes of a block's wanted pairs, from one run of each."""
    columns = ["shard", "pick", "span", "hot"]
    if not block.num_rows or not wanted.num_rows:
        return wanted.select(columns).slice(0, 0).append_column("raw", pa.array([], pa.binary()))
    joined, (first, n, pair) = _texts_of(block), _runs_of(block)
    run = np.zeros(int(pair.max()) + 1, np.int32)
    run[pair] = np.arange(len(pair), dtype=np.int32)
    run = run[wanted.column("pair").to_numpy()]
    ends = first[run] + n[run] + length - 1
    raw = pa.array([joined[a:b] for a, b in zip(first[run].tolist(), ends.tolist(), strict=True)], pa.binary())
    return wanted.select(columns).append_column("raw", raw)


class Shard:
    """Spans of a shard, one after another with a separator behind each."""

    def __init__(self, spans: list[bytes]):
        sizes = np.array([len(x) for x in spans], np.int32)
        ends = np.cumsum(sizes + 1, dtype=np.int32) - 1
        self.starts = ends - sizes
        self.text = np.frombuffer(b"".join(x + b"\0" for x in spans), np.uint8)
        self.room = np.repeat(ends, sizes + 1) - np.arange(len(self.text), dtype=np.int32)
        self.letters = self.text.astype(np.int16) + 1
        self.letters[ends] = 0

    def classes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows in the order of the suffix array, and where a class of equal ones begins."""
        order = suffix_array(self.letters, 257)
        shared = common_prefixes(self.text, order, self.room, length)
        order = order[self.room[order] >= length]
        new = shared[order] < length
        new[:1] = True
        return order, new


_VERDICT = "pick long, span long, gone array<int>, keys array<long>, at array<int>"


def judge(table: pa.Table, length: int) -> pa.Table:
    """For each span of a shard the windows (from, to) that repeat in it; for hot picks also a key per class.

    ``at`` is the window of a class of one, which another shard may still hold, and -1 for others.
    """
    shard = Shard(table.column("raw").to_pylist())
    order, new = shard.classes(length)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(order)))
    repeats = np.zeros(len(shard.text) + 1, np.int8)
    repeats[order[np.repeat(n > 1, n)]] = 1
    edges = np.diff(repeats, prepend=np.int8(0))
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    owner = np.searchsorted(shard.starts, begin, "right") - 1
    begin, end = begin - shard.starts[owner], end - shard.starts[owner]
    cut = np.searchsorted(owner, np.arange(table.num_rows + 1))
    both = np.stack((begin, end), 1).astype(np.int32)
    gone = [both[a:b].ravel() for a, b in zip(cut, cut[1:])]
    keys, places = [None] * table.num_rows, [None] * table.num_rows
    hot = table.column("hot").to_numpy(zero_copy_only=False)
    if hot.any():
        window = order[first]
        owner = np.searchsorted(shard.starts, window, "right") - 1
        key = rolling(shard.text, length)[window].view(np.int64)
        place = np.where(n > 1, -1, window - shard.starts[owner]).astype(np.int32)
        turn = np.argsort(owner, kind="stable")
        cut = np.searchsorted(owner[turn], np.arange(table.num_rows + 1))
        for i in np.flatnonzero(hot).tolist():
            own = turn[cut[i] : cut[i + 1]]
            keys[i], places[i] = key[own], place[own]
    return pa.table(
        {
            "pick": table.column("pick"),
            "span": table.column("span"),
            "gone": pa.array(gone, pa.list_(pa.int32())),
            "keys": pa.array(keys, pa.list_(pa.int64())),
            "at": pa.array(places, pa.list_(pa.int32())),
        }
    )


def spans_of(covered: np.ndarray) -> np.ndarray:
    """Rows (from, to) of the runs of True."""
    edges = np.diff(np.concatenate(([0], covered.astype(np.int8), [0])))
    return np.stack((np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)), 1)


def cut_block(block: pa.Table, told: pa.Table, length: int, own: list[str], keep_text: bool, whole_characters: bool) -> pa.Table:
    """Results of a block's documents, from what is told of its pairs (gone: null means every window)."""
    if not block.num_rows:
        raise ValueError("told of a block that is not there")
    joined, (first, n, pair) = _texts_of(block), _runs_of(block)
    edge = np.zeros(len(joined) + 1, np.int32)
    if told.num_rows:
        gone, pairs = told.column("gone").combine_chunks(), told.column("pair").to_numpy()
        whole = np.zeros(int(pair.max()) + 1, bool)
        whole[pairs[gone.is_null().to_numpy(zero_copy_only=False)]] = True
        runs = np.flatnonzero(whole[pair])
        np.add.at(edge, first[runs], 1)
        np.add.at(edge, first[runs] + n[runs] + (length - 1), -1)
        turn = np.argsort(pair, kind="stable")
        sorted_pair = pair[turn]
        for p, windows in zip(pairs.tolist(), gone, strict=True):
            for run in turn[np.searchsorted(sorted_pair, p) : np.searchsorted(sorted_pair, p, "right")] if windows.is_valid and len(windows) else ():
                ends = np.asarray(windows.values, np.int32).reshape(-1, 2) + first[run]
                np.add.at(edge, ends[:, 0], 1)
                np.add.at(edge, ends[:, 1] + (length - 1), -1)
    covered = np.cumsum(edge[:-1], dtype=np.int32) > 0
    del edge
    begins = spans_of(covered)[:, 0]
    lengths = block.column("lengths").combine_chunks().flatten().to_numpy()
    starts = np.cumsum(lengths + 1) - lengths - 1
    n_spans = np.searchsorted(begins, starts + lengths) - np.searchsorted(begins, starts)
    data, removed, digests, left = np.frombuffer(joined, np.uint8), [], [], []
    for at, size, spans in zip(starts.tolist(), lengths.tolist(), n_spans.tolist(), strict=True):
        kept = joined[at : at + size]
        if spans:
            kept = data[at : at + size][~covered[at : at + size]].tobytes()
        removed.append(size - len(kept))
        digests.append(hashlib.sha256(kept).hexdigest())
        if keep_text and whole_characters and spans:
            kept = kept.decode("utf-8", "ignore").encode()
        left.append(kept if keep_text else None)
    columns = {name: block.column(name).combine_chunks().flatten() for name in own} | {
        "n_bytes": pa.array(lengths, pa.int64()),
        "n_removed": pa.array(removed, pa.int64()),
        "n_spans": pa.array(n_spans, pa.int64()),
        "kept_sha256": pa.array(digests, pa.string()),
        "raw": pa.array(left, pa.binary()),
    }
    return pa.table(columns)


def told_windows(spark: SparkSession, blocks: DataFrame, length: int) -> DataFrame:
    """Rows (block, pair, gone) of the pairs that repeat: gone are their windows (from, to), null for all."""
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("picks", "spans", "many")).alias("pair", "x")).select(
        "block", "pair", F.col("x.picks").alias("pick"), F.col("x.spans").alias("span"), F.col("x.many").alias("many")
    )
    # a pick that stands once is gone from here on
    again = pairs.groupBy("pick").agg(F.sum("many").alias("n"), (F.min("span") != F.max("span")).alias("mixed"))
    again = materialize(spark, again.where("n > 1").select("pick", "mixed"), "repeats-picks")
    repeats = materialize(spark, pairs.join(again, "pick"), "repeats-pairs")
    mixed = repeats.where("mixed").select("block", "pair", "pick", "span", "many")
    spans = mixed.groupBy("pick", "span").agg(F.sum("many").alias("n"), F.min(F.struct("block", "pair")).alias("one"))
    spans = materialize(spark, spans, "repeats-spans")
    of_pick = spans.groupBy("pick").agg(F.count(F.lit(1)).alias("m"))
    n_spans = spans.count()
    shards = max(24, -(-n_spans * int(1.4 * length) // SHARD_BYTES))
    hot = F.col("m") > HOT
    salt = F.pmod(F.xxhash64("span"), F.ceil(F.col("m") / HOT))
    # shards of hot picks have negative numbers of their own
    shard = F.when(hot, -1 - F.abs(F.shiftright(F.xxhash64("pick", salt), 1))).otherwise(F.pmod(F.xxhash64("pick"), F.lit(shards)))
    wanted = spans.join(of_pick, "pick").select("one.block", "one.pair", "pick", "span", shard.cast("long").alias("shard"), hot.alias("hot"))
    raw = wanted.groupBy("block").cogroup(blocks.select("block", "texts", "first", "n", "pair").groupBy("block"))
    raw = raw.applyInArrow(lambda w, b: freed(span_bytes, b, w, length), "shard long, pick long, span long, hot boolean, raw binary")
    verdicts = materialize(spark, raw.groupBy("shard").applyInArrow(lambda t: freed(judge, t, length), _VERDICT), "repeats-verdicts")
    classes = verdicts.where("keys is not null").select("pick", "span", F.explode(F.arrays_zip("keys", "at")).alias("x"))
    classes = classes.select("pick", "span", F.col("x.keys").alias("key"), F.col("x.at").alias("at"))
    shared = classes.groupBy("pick", "key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    more = classes.where("at >= 0").join(shared, ["pick", "key"]).groupBy("pick", "span").agg(F.collect_list("at").alias("more"))
    windows = F.concat("gone", F.flatten(F.transform(F.coalesce("more", F.array().cast("array<int>")), lambda w: F.array(w, w + 1))))
    told = spans.select("pick", "span", "n").join(verdicts.join(more, ["pick", "span"], "left"), ["pick", "span"], "left")
    told = told.select("pick", "span", F.when(F.col("n") == 1, windows).alias("gone")).where("gone is null or size(gone) > 0")
    whole = repeats.where("not mixed").select("block", "pair", F.lit(None).cast("array<int>").alias("gone"))
    return whole.unionByName(mixed.join(told, ["pick", "span"]).select("block", "pair", "gone"))


def remove_repeats(
    spark: SparkSession, docs: DataFrame, length: int = LENGTH, keep_text: bool = False, carry: tuple[str, ...] = (), whole_characters: bool = False
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, the columns of carry, and
    raw, what is left of the bytes (null unless keep_text; with whole_characters, bytes left of a cut
    character go from it too, but count for nothing else). length may be 8 to a quarter of CHUNK."""
    if not 8 <= length <= CHUNK // 4:
        raise ValueError(f"length must be 8 to {CHUNK // 4}")
    tune(spark)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = docs.select("doc_id", *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)], raw.alias("raw"))
    blocks = materialize(spark, coded_blocks(base, length), "repeats-blocks")
    told = told_windows(spark, blocks, length)
    own = [f for f in base.schema if f.name != "raw"]
    names, schema = [f.name for f in own], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own)
    done = (
        blocks.select("block", "lengths", "texts", "first", "n", "pair", *names)
        .groupBy("block")
        .cogroup(told.groupBy("block"))
        .applyInArrow(
            lambda b, t: freed(cut_block, b, t, length, names, keep_text, whole_characters),
            f"{schema}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, raw binary",
        )
    )
    return done.withColumnsRenamed({f"carry_{i}": c for i, c in enumerate(carry)})
