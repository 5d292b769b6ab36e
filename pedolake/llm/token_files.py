"""Token ids in Arrow stream files: fixed-size lists of ids and masks, read in place.

Documents are ordered by id (repeated ids by a hash of the text, so a hot id is split); each task encodes its
range of them and writes one stream file. The ids of its documents, each with an end id, follow each other
without gaps in sequences of ``length`` ids; the last sequence of a file is padded. A file's batches hold three
columns of fixed-size lists: ``ids`` (16 bits where the vocabulary fits, else 32), ``mask`` (an id, not padding)
and ``ends`` (last id of a document), of one bit each. All batches but the last have ``BATCH`` sequences, none is compressed and no
value is null, so sequence k of a file lies at a known place: ``SequenceFile`` maps the file and gives arrays
that share its memory. A second stream file beside it lists its documents (doc_id, first id, number of ids).

Files get names of their own and are listed in a table that Spark commits once all tasks are done; what a lost
or repeated task leaves behind is in no list. A task holds one batch of sequences and one of texts. The folder
is any that ``pyarrow.fs`` opens, below the shared scratch folder unless named.

What stands between white space is remembered by each worker with its ids (up to ``MEMO`` bytes), and so are the
pieces that words consist of, which the tokenizers library encodes once, many as one text; texts with special strings or control characters that only one of the two libraries takes for white
space go through it whole.

Defined results: null and empty texts hold the end id alone; null doc_ids come first; repeated rows are
documents of their own, in an order of their texts' hashes; an empty table writes no file and gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext
from tokenizers import Tokenizer

from .common import materialize, scratch_path, tune, worker_holds
from .token_counts import _PIECE

END = 2
LENGTH, BATCH = 2048, 128
#: Bytes of remembered words (characters, ids and the entries of the tables).
MEMO = 160 << 20


class _Pool:
    """Arrays of ids end to end; each has a number."""

    def __init__(self, kind: np.dtype):
        self.ids, self.starts, self.sizes = np.empty(1 << 16, kind), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32)
        self.filled = self.n = 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        for name, used, more in (("ids", self.filled, len(ids)), ("starts", self.n, len(sizes)), ("sizes", self.n, len(sizes))):
            held = getattr(self, name)
            if used + more > len(held):
                grown = np.empty(max(2 * len(held), used + more), held.dtype)
                grown[:used] = held[:used]
                setattr(self, name, grown)
        self.ids[self.filled : self.filled + len(ids)] = ids
        self.sizes[self.n : self.n + len(sizes)] = sizes
        self.starts[self.n : self.n + len(sizes)] = self.filled + np.cumsum(sizes) - sizes
        self.filled, self.n = self.filled + len(ids), self.n + len(sizes)

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of those numbers, one after the other, and how many each has."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes, dtype=np.int64)
        return self.ids[np.repeat(self.starts[numbers] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes

    def nbytes(self) -> int:
        return self.ids.nbytes + self.starts.nbytes + self.sizes.nbytes


class WordIds:
    """Encodes texts word by word; what words and their pieces give is kept in pools of ids."""

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation(), self.library.no_padding()
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # ids that end a piece
        self.last = np.array([str(self.library.id_to_token(i)).endswith("</w>") for i in range(size)])
        self.memo = memo
        self._clear()

    def _clear(self) -> None:
        self.words: dict[str, int] = {}
        self.pieces: dict[str, int] = {}
        self.of_words, self.of_pieces, self.used = _Pool(self.kind), _Pool(self.kind), 0

    def _new_pieces(self, pieces: list[str]) -> None:
        """Many pieces go through the library as one text; ids that end a piece tell them apart."""
        ids = np.array(self.library.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, self.kind)
        ends = np.flatnonzero(self.last[ids])
        if len(ends) != len(pieces) or (len(ids) and ends[-1] != len(ids) - 1):
            each = [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
            ids, ends = np.array([i for x in each for i in x], self.kind), np.cumsum([len(x) for x in each]) - 1
        self.pieces.update(zip(pieces, range(self.of_pieces.n, self.of_pieces.n + len(pieces)), strict=True))
        self.of_pieces.add(ids, np.diff(ends, prepend=-1))
        self.used += 100 * len(pieces) + 2 * sum(map(len, pieces))

    def _new_words(self, words: list[str]) -> None:
        parts = [_PIECE.findall(w if w.isascii() else unicodedata.normalize("NFC", w).replace("Σ", "σ").lower()) for w in words]
        flat = [p for x in parts for p in x]
        new = list(set(flat).difference(self.pieces))
        for k in range(0, len(new), 2048):
            self._new_pieces(new[k : k + 2048])
        ids, sizes = self.of_pieces.joined(np.fromiter(map(self.pieces.__getitem__, flat), np.int64, len(flat)))
        ends = np.cumsum([0, *map(len, parts)])
        before = np.r_[0, np.cumsum(sizes)]
        self.words.update(zip(words, range(self.of_words.n, self.of_words.n + len(words)), strict=True))
        self.of_words.add(ids, np.diff(before[ends]))
        self.used += 100 * len(words) + 2 * sum(map(len, words))

    def whole(self, text: str) -> bool:
        """Whether the text has to go through the library in one piece."""
        return any(c in text for c in "\x1c\x1d\x1e\x1f") or ("<" in text and any(s in text for s in self.special))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text; the new words of all of them are looked up together."""
        alone = [self.whole(t) for t in texts]
        split = [() if own else (t.lower() if t.isascii() else t).split() for t, own in zip(texts, alone, strict=True)]
        flat = list(itertools.chain.from_iterable(split))
        missing = set(flat).difference(self.words)
        if missing:
            if self.used + self.of_words.nbytes() + self.of_pieces.nbytes() > self.memo:
                self._clear()
                missing = set(flat)
            self._new_words(list(missing))
        ids, sizes = self.of_words.joined(np.fromiter(map(self.words.__getitem__, flat), np.int64, len(flat)))
        ends = np.r_[0, np.cumsum(sizes)][np.cumsum([0, *map(len, split)])]
        for text, own, first, last in zip(texts, alone, ends, ends[1:]):
            yield np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind) if own else ids[first:last]


def _schema(kind: pa.DataType, length: int) -> pa.Schema:
    kinds = {"ids": kind, "mask": pa.bool_(), "ends": pa.bool_()}
    return pa.schema([pa.field(name, pa.list_(pa.field("item", k, False), length), False) for name, k in kinds.items()])


class SequenceWriter:
    """Writes one file of sequences; holds at most one batch."""

    def __init__(self, sink, kind: np.dtype, length: int = LENGTH, batch: int = BATCH):
        self.schema = _schema(pa.from_numpy_dtype(kind), length)
        self.stream = pa.ipc.new_stream(sink, self.schema)
        self.length, self.held, self.ids = length, 0, np.zeros(length * batch, kind)
        self.mask, self.ends = np.zeros(length * batch, bool), np.zeros(length * batch, bool)

    def add(self, ids: np.ndarray) -> None:
        """One document's ids; the last is marked."""
        done = 0
        while done < len(ids):
            n = min(len(ids) - done, len(self.ids) - self.held)
            self.ids[self.held : self.held + n] = ids[done : done + n]
            self.mask[self.held : self.held + n], self.ends[self.held : self.held + n] = True, False
            done, self.held = done + n, self.held + n
            self.ends[self.held - 1] = done == len(ids)
            if self.held == len(self.ids):
                self._write(self.held)

    def _write(self, n: int) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x[:n]), type=f.type) for x, f in zip((self.ids, self.mask, self.ends), self.schema, strict=True)]
        self.stream.write_batch(pa.record_batch(lists, schema=self.schema))
        self.held = 0

    def close(self) -> None:
        if self.held:
            n = -(-self.held // self.length) * self.length
            for x in (self.ids, self.mask, self.ends):
                x[self.held : n] = 0
            self._write(n)
        self.stream.close()


class SequenceFile:
    """Random access to the sequences of a file; arrays share the memory of the map (or of the buffer given)."""

    def __init__(self, source):
        self.batches = list(pa.ipc.open_stream(source))
        self.per = self.batches[0].num_rows if self.batches else 0
        self.length = self.batches[0].schema.field("ids").type.list_size if self.batches else 0

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray, pa.BooleanArray]:
        """Ids, mask and ends of sequence k, not copied."""
        batch, at = self.batches[k // self.per], (k % self.per) * self.length
        ids, mask, ends = (batch.column(c).values.slice(at, self.length) for c in range(3))
        return ids.to_numpy(zero_copy_only=True), mask, ends

    def tokens(self, first: int, n: int) -> np.ndarray:
        """The n ids from place ``first`` of the file on; copied only where they cross batches."""
        size, parts = self.per * self.length, []
        while n:
            b, at = divmod(first, size)
            values = self.batches[b].column(0).values
            take = min(n, len(values) - at)
            parts.append(values.slice(at, take).to_numpy(zero_copy_only=True))
            first, n = first + take, n - take
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint32)


def open_folder(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder's address, and its path there."""
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def opened(folder: str, name: str):
    """A file of the folder to read from: mapped where it is local, else its bytes."""
    fs, base = open_folder(folder)
    if isinstance(fs, pa.fs.LocalFileSystem):
        return pa.memory_map(f"{base}/{name}")
    with fs.open_input_stream(f"{base}/{name}") as f:
        return pa.BufferReader(f.read_buffer())


@dataclass
class TokenFiles:
    """A folder of files and the table (part, name, documents, tokens) that lists them."""

    folder: str
    listed: DataFrame


def write_token_files(
    spark: SparkSession, docs: DataFrame, vocabulary: str, end: int = END, length: int = LENGTH, folder: str | None = None
) -> TokenFiles:
    """Writes the ids of all documents (doc_id long, text) in ascending order of doc_id."""
    tune(spark)
    folder = folder or scratch_path(spark, "token-files")
    fs, base = open_folder(folder)
    fs.create_dir(base, recursive=True)
    names = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_holds(("word-ids", vocabulary), lambda: WordIds(vocabulary))
        fs, base = open_folder(folder)
        name, out, first, n_docs = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", None, 0, 0
        for batch in batches:
            if batch.num_rows and out is None:
                sinks = [fs.open_output_stream(f"{base}/{name}.{x}.arrows") for x in ("ids", "docs")]
                out, index = SequenceWriter(sinks[0], words.kind, length), pa.ipc.new_stream(sinks[1], names)
            starts = []
            for ids in words.encode(batch.column(1).to_pylist()):
                starts.append(first)
                out.add(np.append(ids, words.kind(end)))
                first += len(ids) + 1
            if starts:
                n_docs += len(starts)
                index.write_batch(pa.record_batch([batch.column(0), pa.array(starts, pa.int64()), pa.array(np.diff(starts + [first]), pa.int64())], schema=names))
        if out is not None:
            for x in (out, index, *sinks):
                x.close()
            yield pa.record_batch([pa.array([int(name[:6])]), pa.array([name]), pa.array([n_docs]), pa.array([first])], names=["part", "name", "documents", "tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("at"))
    rows = rows.repartitionByRange("doc_id", "at").sortWithinPartitions("doc_id", "at").select("doc_id", "text")
    return TokenFiles(folder, materialize(spark, rows.mapInArrow(write, "part long, name string, documents long, tokens long"), "token-files-listed"))


def read_token_files(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    listed = sorted(files.listed.collect())  # a row for each file
    starts, total = [], 0
    for r in listed:
        starts.append((r["name"], total))
        total += r["tokens"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(x, T.LongType()) for x in ("start", "n_tokens", "ids_crc32")]])
    if not starts:
        return spark.createDataFrame([], schema)
    folder = files.folder

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = SequenceFile(opened(folder, f"{name}.ids.arrows"))
                for docs in pa.ipc.open_stream(opened(folder, f"{name}.docs.arrows")):
                    first, n = docs.column("first").to_numpy(), docs.column("n_tokens").to_numpy()
                    crc = [zlib.crc32(ids.tokens(a, k).astype("<u4").tobytes()) for a, k in zip(first.tolist(), n.tolist(), strict=True)]
                    made = [docs.column("doc_id"), pa.array(first + start), docs.column("n_tokens"), pa.array(crc, pa.int64())]
                    yield pa.record_batch(made, names=schema.fieldNames())

    table = spark.createDataFrame(starts, "name string, start long").repartition(len(starts))
    return table.mapInArrow(read, schema)


def token_file_report(spark: SparkSession, docs: DataFrame, vocabulary: str, end: int = END, length: int = LENGTH) -> DataFrame:
    """Writes the files and reads them back."""
    tune(spark)
    return read_token_files(spark, write_token_files(spark, docs, vocabulary, end, length))
