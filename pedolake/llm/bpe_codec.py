"""Byte-level BPE encoding and decoding with a minimal acyclic transducer for frequent words.

Frequent words are counted over the whole corpus, their ids are found by exact merging, and they are
compiled into a minimal acyclic automaton whose states share suffixes; each arc knows how many words
come before those below it, so a walk also gives the word's number, which points to its ids. The
automaton is broadcast as one block of bytes; each worker writes it to a temporary file, maps that, and
keeps it for later tasks. Texts are cut into units at spaces that begin a
piece; the distinct units of some texts walk through the automaton side by side, a byte at a time.
Units that it does not hold are merged exactly, and remembered in a table whose bytes are bounded.
Decoding goes from ids to bytes of the vocabulary.

Defined results: null and empty texts encode to no ids and decode to the empty text; special strings
inside a text become their own id, as the tokenizers library does by default. Repeated rows get equal
results. The lexicon only saves time: the ids are the same for any lexicon, an empty one included.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import tempfile
from collections import Counter
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, release, tune, worker_holds
from .token_counts import SPACE, byte_letters

#: Words of the lexicon, bytes of a worker's memo, and longest text piece that either holds.
LEXICON, MEMO_BYTES, LONGEST = 32_768, 192 << 20, 64
#: Characters of texts that are encoded together; what an entry of the memo takes beside its letters and ids.
GROUP_CHARS, ENTRY_BYTES = 1 << 20, 160
_PIECE = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


#: A space that does not begin a piece.
_ODD = re.compile(r" (?:\s|$)")
#: Stands for a pair that no rule merges; above every rank.
_NEVER = 1 << 60


class Merger:
    """Exact merging of a piece of text to ids, and ids to bytes, from the vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        back = {c: b for b, c in enumerate(letters)}
        self.symbols = [vocab[c] for c in letters]
        #: left id * 2**20 + right id: rank * 2**20 + merged id
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocab[a] << 20 | vocab[b], rank << 20 | vocab[a + b])
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.special_at = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one piece: the pair of lowest rank, leftmost first, until no pair is known."""
        ids = [self.symbols[b] for b in raw]
        if len(ids) > LONGEST:
            return self.merge_long(ids)
        known = self.merges.get
        pairs = [known(a << 20 | b, _NEVER) for a, b in zip(ids, ids[1:])]
        while pairs and (best := min(pairs)) < _NEVER:
            i = pairs.index(best)
            ids[i] = new = best & 0xFFFFF
            del ids[i + 1], pairs[i]
            if i:
                pairs[i - 1] = known(ids[i - 1] << 20 | new, _NEVER)
            if i < len(pairs):
                pairs[i] = known(new << 20 | ids[i + 1], _NEVER)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list, for pieces of any length."""
        n, known = len(ids), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i) for i in range(n - 1) if (m := known(ids[i] << 20 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if ids[i] < 0 or (j := after[i]) >= n or known(ids[i] << 20 | ids[j]) != rank:
                continue
            new = rank & 0xFFFFF
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := known(new << 20 | ids[k]):
                    heapq.heappush(heap, (m, i))
            if (p := before[i]) >= 0 and (m := known(ids[p] << 20 | new)):
                heapq.heappush(heap, (m, p))
        return [i for i in ids if i >= 0]


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """Minimal acyclic transducer of the words, as bytes that Lexicon reads.

    Words are added in ascending order; the states of the last word's tail are replaced by equal
    states that exist already (Daciuk et al. 2000). A state is a tuple (final, arcs), so equal
    futures are one state. Each arc stores how many words precede those below it.
    """
    register: dict[tuple, int] = {}
    states: list[tuple] = []
    reach: list[int] = []

    def frozen(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, tuple(arcs))
        if key not in register:
            register[key] = len(states)
            states.append(key)
            reach.append(final + sum(reach[t] for _, t in arcs))
        return register[key]

    ordered = sorted(words)
    path: list[list] = [[False, []]]
    previous = b""

    def fold(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            path[-1][1].append((previous[len(path) - 1], frozen(final, arcs)))

    for word in ordered:
        common = len(os.path.commonprefix([previous, word]))
        fold(common)
        path.extend([False, []] for _ in range(len(word) - common))
        path[-1][0] = True
        previous = word
    fold(0)
    root = frozen(path[0][0], path[0][1])

    first, labels, targets, skips = [0], [], [], []
    for final, arcs in states:
        passed = int(final)
        for label, target in arcs:
            labels.append(label)
            targets.append(target)
            skips.append(passed)
            passed += reach[target]
        first.append(len(labels))
    ends = np.cumsum([0] + [len(words[w]) for w in ordered])
    ids = [i for w in ordered for i in words[w]]
    parts = [np.array(x, np.int32) for x in (first, [f for f, _ in states], labels, targets, skips, ends, ids)]
    head = np.array([root, *map(len, parts)], np.int32)
    return b"".join(x.tobytes() for x in (head, *parts))


class Lexicon:
    """Reads a compiled lexicon from a memory-mapped file; an arc is found by its state and byte."""

    def __init__(self, compiled: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(compiled)
            f.flush()
            whole = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), np.int32)
        self.root, at, parts = int(whole[0]), 8, []
        for n in whole[1:8].tolist():
            parts.append(whole[at : at + n])
            at += n
        first, self.final, labels, self.targets, self.skips, ends, ids = parts
        #: state and byte of each arc, ascending as states are numbered in order and words were added in order
        self.arcs = np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first)) << 8 | labels
        cuts, ids = ends.tolist(), ids.tolist()
        #: ids of each word, by its number
        self.outputs = [tuple(ids[a:b]) for a, b in zip(cuts, cuts[1:])]

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 for those that are not held; all walk side by side."""
        size = np.array([len(w) for w in words], np.int64)
        data, at = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
        state, number, out = np.full(len(words), self.root), np.zeros(len(words), np.int32), np.full(len(words), -1, np.int32)
        alive, k = np.flatnonzero(size <= LONGEST), 0
        while len(alive):
            done = alive[size[alive] == k]
            done = done[self.final[state[done]] > 0]
            out[done] = number[done]
            alive = alive[size[alive] > k]
            wanted = state[alive] << 8 | data[at[alive] + k]
            arc = np.searchsorted(self.arcs, wanted)
            there = arc < len(self.arcs)
            there[there] = self.arcs[arc[there]] == wanted[there]
            alive, arc = alive[there], arc[there]
            number[alive] += self.skips[arc]
            state[alive] = self.targets[arc]
            k += 1
        return out

    def find(self, word: bytes) -> list[int] | None:
        """Ids of a word, or None if the lexicon does not hold it."""
        number = int(self.numbers([word])[0])
        return None if number < 0 else list(self.outputs[number])


class Codec:
    """Encodes and decodes whole texts; what it has merged is remembered, to a bound of bytes."""

    def __init__(self, path: str, lexicon: Lexicon, memo_bytes: int = MEMO_BYTES):
        self.merger, self.lexicon, self.limit, self.held = Merger(path), lexicon, memo_bytes, 0
        #: ids of units and pieces that were merged
        self.known: dict[str, tuple[int, ...]] = {}
        n = max(self.merger.bytes_of) + 1
        #: bytes that each id stands for, and its decimal digits
        self.bytes_of = [self.merger.bytes_of.get(i, b"") for i in range(n)]
        self.digits = [str(i).encode() for i in range(n)]

    def remember(self, unit: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        if len(unit) <= LONGEST:
            self.held += ENTRY_BYTES + len(unit) + 8 * len(ids)
            self.known[unit] = ids
        return ids

    def merged(self, unit: str) -> tuple[int, ...]:
        """Ids of a unit that is not in the lexicon: its pieces are merged, or were before."""
        pieces = _PIECE.findall(unit)
        if len(pieces) == 1:
            return self.remember(unit, tuple(self.merger.merge(unit.encode())))
        known, ids = self.known, ()
        for piece in pieces:
            ids += known.get(piece) or self.remember(piece, tuple(self.merger.merge(piece.encode())))
        return self.remember(unit, ids)

    @contextmanager
    def knowing(self, units: set[str | int]) -> Iterator[dict[str | int, tuple[int, ...]]]:
        """A table that holds the ids of all the units: what is not remembered walks through the lexicon, and
        what that does not hold is merged. Only merged units stay remembered."""
        if self.held > self.limit:
            self.known, self.held = {}, 0
        missing = list(units.difference(self.known))
        words = [u for u in missing if isinstance(u, str)]
        found = {u: (u,) for u in missing if isinstance(u, int)}
        for unit, number in zip(words, self.lexicon.numbers([u.encode() for u in words]).tolist(), strict=True):
            found[unit] = self.lexicon.outputs[number] if number >= 0 else self.merged(unit)
        mine = [u for u in found if u not in self.known]
        self.known.update(found)
        yield self.known
        for u in mine:
            del self.known[u]

    @staticmethod
    def plain(text: str) -> list[str]:
        """Units of a text without special strings. A space before what is none always belongs to the piece
        that it begins, so a text may be cut there; one with other spaces is cut into its pieces."""
        if _ODD.search(text):
            return _PIECE.findall(text)
        words = text.split(" ")
        return [words[0], *map(" ".__add__, words[1:])] if words[0] else list(map(" ".__add__, words[1:]))

    def parts(self, text: str) -> list[str | int]:
        """Units of a text; ids in place of special strings."""
        special = self.merger.special_at
        if special is None or "<|" not in text:
            return self.plain(text)
        out, at = [], 0
        for m in special.finditer(text):
            out += self.plain(text[at : m.start()])
            out.append(self.merger.special[m[0]])
            at = m.end()
        return out + self.plain(text[at:])

    def encode(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """Ids of each text; the units of a bounded group of texts are looked up together."""
        parts, size = [], 0
        for text in chain(texts, [None]):
            if size >= GROUP_CHARS or text is None:
                with self.knowing(set().union(*parts)) as ids:
                    for p in parts:
                        yield list(chain.from_iterable(map(ids.__getitem__, p)))
                parts, size = [], 0
            if text is not None:
                parts.append(self.parts(text))
                size += len(text)

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the text that the ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace").encode()

    def decimal(self, ids: list[int]) -> bytes:
        """Ids in decimal, joined by commas."""
        return b",".join(map(self.digits.__getitem__, ids))


def open_codec(path: str, lexicon: bytes) -> Codec:
    """This worker's codec for a vocabulary and a compiled lexicon."""
    key = ("codec", path, xxhash.xxh3_64_intdigest(lexicon))
    return worker_holds(key, lambda: Codec(path, Lexicon(lexicon)))


def frequent_words(spark: SparkSession, docs: DataFrame, size: int = LEXICON) -> list[str]:
    """The most frequent words (between white space) of all texts: whole count classes, as many as fit in size.

    Each partition sends a word once with its count; the counts are summed in Spark and written once. A
    histogram of counts (eighths of powers of two, so some hundred rows) tells the least count that
    leaves at most size words, and only those reach the driver.
    """
    tune(spark)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out():
            words = list(held)
            return pa.record_batch(
                [pa.array(words, pa.binary()), pa.array([held[w] for w in words], pa.int64())], names=["word", "n"]
            )

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(text.split())
            if len(held) > 400_000:
                yield out()
                held.clear()
        if held:
            yield out()

    texts = docs.where("text is not null").select(F.col("text").cast("binary").alias("raw"))
    summed = (
        texts.mapInArrow(counts, "word binary, n long")
        .where(F.octet_length("word") <= LONGEST - 1)
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .withColumn("class", F.floor(F.log2("n") * 8).cast("int"))
    )
    summed = materialize(spark, summed, "codec-words")
    left, least = size, None
    for row in summed.groupBy("class").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("class")).collect():
        if row["n"] > left:
            break
        left, least = left - row["n"], row["class"]
    if least is None:
        return []
    top = summed.where(F.col("class") >= least).select("word").collect()
    return sorted(bytes(r["word"]).decode("utf-8", "replace") for r in top)


def build_lexicon(spark: SparkSession, docs: DataFrame, vocabulary: str, size: int = LEXICON) -> bytes:
    """Compiled lexicon of the most frequent words of docs, each with the space before it."""
    merger = Merger(vocabulary)
    ids = lambda unit: [i for p in _PIECE.findall(unit) for i in merger.merge(p.encode())]
    units = [f" {w}" for w in frequent_words(spark, docs, size)]
    return compile_lexicon({u.encode(): ids(u) for u in units if len(u.encode()) <= LONGEST})


def round_trip(spark: SparkSession, text: Column, vocabulary: str, lexicon: bytes, keep: bool = True) -> Column:
    """Struct n_tokens, ids_sha256, decoded_sha256 of each whole text; a worker keeps its codec from task to task, or not."""
    tune(spark)
    shared = spark.sparkContext.broadcast(lexicon)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = open_codec(vocabulary, shared.value)
        for texts in batches:
            sha = lambda raw: hashlib.sha256(raw).hexdigest()
            rows = [(len(ids), sha(own.decimal(ids)), sha(own.decode(ids))) for ids in own.encode(texts)]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        if not keep:
            del own
            release()

    return code(F.coalesce(text, F.lit("")))


def encode_ids(spark: SparkSession, text: Column, vocabulary: str, lexicon: bytes) -> Column:
    """The ids of each whole text, as an array."""
    shared = spark.sparkContext.broadcast(lexicon)

    @F.pandas_udf("array<int>")
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = open_codec(vocabulary, shared.value)
        for texts in batches:
            yield pd.Series(list(own.encode(texts)), dtype=object)

    return code(F.coalesce(text, F.lit("")))


def decode_ids(spark: SparkSession, ids: Column, vocabulary: str, lexicon: bytes) -> Column:
    """The text of an array of ids."""
    shared = spark.sparkContext.broadcast(lexicon)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = open_codec(vocabulary, shared.value)
        for rows in batches:
            yield rows.map(lambda r: own.decode(r).decode())

    return text(ids)


def encode_documents(spark: SparkSession, docs: DataFrame, vocabulary: str, size: int = LEXICON, keep: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256. Without keep, workers free their
    codecs after each task, for jobs whose other stages need the memory."""
    lexicon = build_lexicon(spark, docs, vocabulary, size)
    coded = docs.select("doc_id", round_trip(spark, F.col("text"), vocabulary, lexicon, keep).alias("code"))
    return coded.select("doc_id", "code.n_tokens", "code.ids_sha256", "code.decoded_sha256")
