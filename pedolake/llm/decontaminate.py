"""Benchmark decontamination by an Aho-Corasick automaton over normalised test items.

Texts are normalised to lower-case words. Every run of ten consecutive words of an item (or the whole
item, if shorter) is a pattern, as a string with one letter for each word; words that no item holds are
one letter for all. Each text is scanned once, as such a string; a match's end is a word of the text,
and words are mapped to byte offsets of the original text.

There is one automaton for all items of up to ``chunk_bytes`` of text; a worker keeps it from task to
task. Larger benchmarks are cut into several: a worker gathers texts up to ``BUFFER_BYTES``, builds one
automaton at a time, scans the texts with it and merges the hits per row, so the plan does not grow
with the benchmark, and a worker holds one automaton.

Defined results: null and empty texts have no words and no hits; null or wordless items never match;
repeated item ids count once; repeated rows get equal results. Other columns of docs are carried, but
for one of the name of the result column, which is replaced (pass another ``column`` to keep it).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import ahocorasick
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_TABLE, tune, worker_holds

WINDOW = 10
#: Text of test items for one automaton; its states take about a hundred times as many bytes.
CHUNK_BYTES = 1_000_000
#: Texts that a worker gathers before it builds several automata, one after another.
BUFFER_BYTES = 32 << 20
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _letter(k: int) -> str:
    """The letter of the k-th word: any but 0 and what stands for halves of pairs."""
    return chr(k + 1 if k + 1 < 0xD800 else k + 1 + 0x800)


class Matcher:
    """One automaton over the windows of some items, a letter for each word."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        self.letters: dict[bytes, str] = {}
        owners: dict[str, set[str]] = {}
        for item, text in items:
            words = (text or b"").translate(WORD_TABLE).split()
            spelled = "".join([self.letters.setdefault(w, _letter(len(self.letters))) for w in words])
            for i in range(max(1, len(words) - window + 1) if words else 0):
                owners.setdefault(spelled[i : i + window], set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for w, names in owners.items():
            self.automaton.add_word(w, (len(w), tuple(sorted(names))))
        self.patterns = len(owners)
        if owners:
            self.automaton.make_automaton()

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, hit word ranges [from, to) merged and ascending, and items that occur."""
        words = (text or b"").translate(WORD_TABLE).split()
        items: set[str] = set()
        if not words or not self.patterns:
            return len(words), [], items
        ranges = []
        for last, (n, names) in self.automaton.iter("".join(map(self.letters.get, words, repeat("\0")))):
            items.update(names)
            ranges.append((last + 1 - n, last + 1))
        return len(words), merge(ranges), items


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of ranges, as ascending ranges that do not touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def byte_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Offsets in the original bytes of the given word ranges."""
    if not ranges:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


_STATE = "n_words long, ranges array<struct<first:long,last:long>>, items array<string>"


def benchmark_chunks(benchmark: DataFrame, chunk_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """Test items, brought to the driver one bounded chunk at a time and handed on as broadcasts."""
    items = benchmark.where("text is not null and item_id is not null").select(
        F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("raw")
    )
    total = items.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    n = max(1, -(-int(total) // chunk_bytes))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item", "raw"), F.lit(n)) == k)
        yield [(r["item"], bytes(r["raw"])) for r in part.toLocalIterator()]


def _buffers(batches: Iterator[pd.Series], most: int) -> Iterator[list[pd.Series]]:
    """Batches, gathered until they hold that many bytes."""
    held, size = [], 0
    for texts in batches:
        held.append(texts)
        size += sum(len(t or b"") for t in texts)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _scanner(spark: SparkSession, chunks: Iterable[list[tuple[str, bytes]]], window: int):
    """UDF that scans texts with the automaton of each chunk; that of a single chunk is built once per task."""
    shared = [spark.sparkContext.broadcast(chunk) for chunk in chunks]
    key = ("matcher", window, xxhash.xxh3_64_intdigest(repr([sorted(c.value) for c in shared]).encode()))

    @F.pandas_udf(_STATE)
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        only = worker_holds(key, lambda: Matcher(shared[0].value, window)) if len(shared) == 1 else None
        for held in _buffers(batches, 0 if only is not None else BUFFER_BYTES):
            n_words, ranges, items = {}, {}, {}
            for chunk in shared:
                matcher = only if only is not None else Matcher(chunk.value, window)
                for k, texts in enumerate(held):
                    for i, t in enumerate(texts):
                        n_words[k, i], found, names = matcher.scan(t)
                        if found:
                            ranges[k, i] = merge([*ranges.get((k, i), []), *found])
                            items[k, i] = names | items.get((k, i), set())
                del matcher
            for k, texts in enumerate(held):
                at = [(k, i) for i in range(len(texts))]
                yield pd.DataFrame(
                    {
                        "n_words": [n_words[x] for x in at],
                        "ranges": [[{"first": a, "last": b} for a, b in ranges.get(x, [])] for x in at],
                        "items": [sorted(items.get(x, ())) for x in at],
                    }
                )

    return hits


def find_contamination(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    chunk_bytes: int = CHUNK_BYTES,
    column: str = "hit",
) -> DataFrame:
    """All columns of docs, and ``column``: n_words, ranges of hit words, ids of items that occur."""
    tune(spark)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.withColumn(column, _scanner(spark, benchmark_chunks(benchmark, chunk_bytes), window)(raw))


def hit_words(ranges: F.Column) -> F.Column:
    """Number of words in the union of ranges."""
    ordered = F.array_sort(ranges)
    step = F.aggregate(
        ordered,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda s, r: F.struct(
            (s["n"] + F.greatest(F.lit(0).cast("long"), r["last"] - F.greatest(r["first"], s["end"]))).alias("n"),
            F.greatest(s["end"], r["last"]).alias("end"),
        ),
        lambda s: s["n"],
    )
    return step


def contamination_report(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_contamination(spark, docs.select("doc_id", "text"), benchmark).select("doc_id", "hit")
    items = F.array_sort(F.col("hit.items"))
    return found.select(
        "doc_id",
        F.col("hit.n_words").alias("n_words"),
        hit_words(F.col("hit.ranges")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.col("n_hit") > 0)


def contaminated_spans(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per hit passage: doc_id, start and stop (byte offsets in the original text), passage."""
    found = find_contamination(spark, docs.select("doc_id", "text"), benchmark).where("size(hit.ranges) > 0")

    @F.pandas_udf("array<struct<start:long,stop:long>>")
    def spans(texts: pd.Series, ranges: pd.Series) -> pd.Series:
        return pd.Series(
            [
                [{"start": a, "stop": b} for a, b in byte_spans(t, merge([(r["first"], r["last"]) for r in rs]))]
                for t, rs in zip(texts, ranges, strict=True)
            ]
        )

    raw = F.col("text").cast("binary")
    return found.select("doc_id", raw.alias("raw"), F.explode(spans(raw, F.col("hit.ranges"))).alias("span")).select(
        "doc_id",
        F.col("span.start").alias("start"),
        F.col("span.stop").alias("stop"),
        F.expr("cast(substring(raw, int(span.start + 1), int(span.stop - span.start)) as string)").alias("passage"),
    )
