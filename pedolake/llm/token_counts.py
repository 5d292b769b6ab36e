"""Token counts of a word-end BPE vocabulary, without making the tokens.

Each distinct word is merged once per worker by a heap of adjacent pairs over a doubly linked list of
symbols: the pair of lowest rank (leftmost among equals) is popped and merged until none is left. The
count is the number of first symbols less the number of merges; no id is ever emitted. Word counts are
remembered in tables of bounded size that start anew when full.

Defined results: null and empty texts count 0 tokens; special strings inside a text count one token
each, as the tokenizers library does by default. Repeated rows get equal counts, of whole texts.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tune, worker_holds

#: Entries of a worker's table of remembered words.
MEMO = 1_500_000
#: White space as Unicode has it (str.split() would also split at \x1c-\x1f).
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
_SPACES = regex.compile(rf"[{SPACE}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(free))
        free += b not in plain
    return out


class WordEndCounter:
    """Counts tokens from the vocabulary file's merges; ``count`` takes a whole text."""

    def __init__(self, path: str, memo: int = MEMO):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, end = byte_letters(), spec["model"]["end_of_word_suffix"]
        ids: dict[str, int] = {}
        number = lambda s: ids.setdefault(s, len(ids))
        self.inner = [number(x) for x in letters]
        self.last = [number(x + end) for x in letters]
        #: left symbol * 2**20 + right symbol: (rank, merged symbol)
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(number(a) << 20 | number(b), (rank, number(a + b)))
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.limit, self.words, self.pieces = memo, {}, {}

    def merged(self, piece: str) -> int:
        """Tokens of one word."""
        raw = piece.encode()
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        n = len(symbols)
        if n == 1:
            return 1
        merges, after, before = self.merges, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if m := merges.get(symbols[i] << 20 | symbols[i + 1]):
                heap.append((m[0], i, m[1]))
        heapq.heapify(heap)
        done = 0
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= n:
                continue
            m = merges.get(symbols[i] << 20 | symbols[j])
            if m is None or m[0] != rank:  # one of the two has been merged meanwhile
                continue
            symbols[i], symbols[j] = new, -1
            done += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get(new << 20 | symbols[k]):
                    heapq.heappush(heap, (m[0], i, m[1]))
            if (p := before[i]) >= 0 and (m := merges.get(symbols[p] << 20 | new)):
                heapq.heappush(heap, (m[0], p, m[1]))
        return n - done

    def chunk(self, word: str) -> int:
        """Tokens of what stands between white space."""
        total = 0
        for piece in _PIECE.findall(word):
            n = self.pieces.get(piece)
            if n is None:
                if len(self.pieces) >= self.limit:
                    self.pieces = {}
                n = self.merged(piece)
                if len(piece) <= 64:
                    self.pieces[piece] = n
            total += n
        return total

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            chunks = [c for c in _SPACES.split(text) if c]
        else:
            chunks = text.split()
        words = self.words
        missing = set(chunks).difference(words)
        if missing:
            if len(words) + len(missing) > self.limit:
                words.clear()
                missing = set(chunks)
            for w in missing:
                words[w] = self.chunk(w)
        total = sum(map(words.__getitem__, chunks))
        for w in missing:
            if len(w) > 64:
                del words[w]
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or "<|" not in text:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.plain(p) for p in parts if p)


def token_count(spark: SparkSession, text: Column, vocabulary: str) -> Column:
    """Tokens of each whole text; vocabulary is a path that every executor can open."""
    tune(spark)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = worker_holds(("counter", vocabulary), lambda: WordEndCounter(vocabulary))
        for texts in batches:
            yield pd.Series([own.count(t) for t in texts], dtype="int64")

    return count(F.coalesce(text, F.lit("")))


def count_tokens(spark: SparkSession, docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more than limit tokens)."""
    counted = docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        token_count(spark, F.col("text"), vocabulary).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
