"""Language-model scores by deleted interpolation of n-gram maximum-likelihood estimates.

A text is its lower-cased words and one end; the end also stands before the first word. The model mixes
the trigram estimate c(u,v,w)/c(u,v), the bigram estimate c(v,w)/c(v), the unigram estimate c(w)/N and
the uniform 1/(V+1); the first word of a text, which has no word before the end, has no trigram
estimate. The weights depend on the bucket (power of two) of the context's
count: that of (u,v) where the pair was seen, else that of v. They are learned by expectation-
maximisation on a tenth of the training documents, against estimates from the other nine tenths. Scores
then use the counts of all training documents.

How it is laid out: documents are encoded in blocks of some million tokens. Each block asks for the
counts of its distinct words, pairs and triples, as sorted hashes dealt to targets by hash; each target
sums the counts of all blocks and answers every block in the block's own order; each block then scores
its documents with the answers. A frequent word is one key per block, so no key gathers many rows, and
what is gathered grows with the distinct n-grams of the input. Word keys are 64 bits long; those of
pairs and triples 46 bits within a target, whose number grows with the corpus. The rounds of the
expectation-maximisation read the estimates of the tuning tokens where they lie and add up shares by
bucket; only those sums come to the driver.

Defined results: a null or empty text is one end; without training documents every count is 0 and
base_score and score are 0 for each token. Repeated rows are scored alike and each counts in training.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_TABLE, materialize, mix64, pack, pack_sorted, release, remainder, tune, unpack, unpack_sorted

#: Tokens of a block, and bytes of text for each target of the count exchange.
BLOCK_TOKENS, TARGET_BYTES = 800_000, 8_000_000
#: Remainders of crc32(doc_id) modulo 10: not trained on, and used for the weights.
HELD_OUT, TUNING = 0, 1
BUCKETS = 40
#: Rounds of expectation-maximisation at most, and the change of a weight at which they end.
ROUNDS, SETTLED = 15, 1e-3
_SALT, _SALT3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHORT = np.uint64(18)
GRAMS = ("words", "pairs", "triples")

_TOKENS = "block long, tuning boolean, doc_ids array<long>, lengths array<int>, rems array<int>, tokens binary, hashes binary"
_ASK = "block long, tuning boolean, target int, words binary, words_n binary, pairs binary, pairs_n binary, triples binary, triples_n binary"
_ANSWER = (
    "block long, target int, words binary, pairs binary, triples binary,"
    " words_rest binary, pairs_rest binary, triples_rest binary, v_all long, v_rest long"
)


def targets_for(n_bytes: int) -> int:
    """Number of targets of the count exchange for so much text."""
    return max(48, -(-n_bytes // TARGET_BYTES))


class Keys:
    """Distinct n-grams of a block in the order of target and key, and which of them each token is."""

    def __init__(self, key: np.ndarray, target: np.ndarray, at: np.ndarray):
        order = np.lexsort((key, target)).astype(np.int32)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.key, self.target, self.at = key[order], target[order], place[at]


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(codes, return_inverse=True)
    return codes, at.astype(np.int32)


class Block:
    """A block's words, pairs and triples; starts are the places of its texts' first tokens."""

    def __init__(self, hashes: np.ndarray, ids: np.ndarray, starts: np.ndarray, targets: int):
        self.first = np.zeros(len(ids), bool)
        self.first[starts] = True
        before = np.concatenate((np.zeros(1, ids.dtype), ids[:-1]))
        dealt = lambda mixed: (mix64(mixed ^ _SALT) % np.uint64(targets)).astype(np.int32)
        self.words = Keys(hashes, dealt(hashes), ids)
        codes, at = _distinct(before.astype(np.int64) << 32 | ids)
        mixed = mix64(hashes[codes >> 32] * _SALT + mix64(hashes[codes & 0xFFFFFFFF]))
        self.pairs = Keys(mixed >> _SHORT, dealt(mixed), at)
        # the pair before each token; none before a first one, which asks for no triple
        inner = np.flatnonzero(~self.first)
        triples, of = _distinct(at[inner - 1].astype(np.int64) << 32 | ids[inner])
        mixed = mix64(mixed[triples >> 32] * _SALT3 + mix64(hashes[triples & 0xFFFFFFFF]))
        self.triples, self.inner = Keys(mixed >> _SHORT, dealt(mixed), of), inner
        #: the word before each token; the end, a block's last token, also stands before its first
        self.before = np.roll(self.words.at, 1)

    def asks(self, counted: bool, targets: int) -> Iterator[tuple]:
        """(target, keys and counts of words, pairs, triples); counts are zeros for held-out blocks."""
        grams = [getattr(self, g) for g in GRAMS]
        cuts = [np.searchsorted(g.target, np.arange(targets + 1)) for g in grams]
        n = [np.bincount(g.at, minlength=len(g.key)) if counted else np.zeros(len(g.key), int) for g in grams]
        for t in range(targets):
            parts = [slice(c[t], c[t + 1]) for c in cuts]
            if any(p.stop > p.start for p in parts):
                yield (t, *[x for g, k, p in zip(grams, n, parts, strict=True) for x in (pack_sorted(g.key[p]), pack(k[p].astype(np.uint32)))])

    @staticmethod
    def placed(answers: pd.DataFrame, suffix: str = "") -> list[np.ndarray]:
        """Counts of the words, pairs and triples from the answers of all targets."""
        answers = answers.sort_values("target")
        return [np.concatenate([unpack(b, np.uint32) for b in answers[g + suffix]]) for g in GRAMS]


def encode_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of tokens: the training documents, the tuning ones and those held out in blocks of their own."""
    most = BLOCK_TOKENS

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("block", pa.int64()), ("tuning", pa.bool_()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())),
                ("rems", pa.list_(pa.int32())), ("tokens", pa.binary()), ("hashes", pa.binary()),
            ]
        )
        release()
        part, made = TaskContext.get().partitionId(), 0
        open_blocks: dict[int, dict] = {}

        def emit(kind: int, held: dict) -> pa.RecordBatch:
            nonlocal made
            block, made = part << 20 | made, made + 1
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in held["words"]), np.uint64, len(held["words"]))
            row = [block, kind == TUNING, held["doc_ids"], held["lengths"], held["rems"], pack(np.concatenate(held["ids"])), pack(hashes)]
            return pa.record_batch([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        def new() -> dict:
            words: defaultdict = defaultdict()
            words.default_factory = words.__len__
            words[b""]  # noqa: B018  the end is word 0
            return {"words": words, "ids": [], "doc_ids": [], "lengths": [], "rems": [], "n": 0}

        for batch in batches:
            for doc_id, raw, rem in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kind = rem if rem in (HELD_OUT, TUNING) else 2
                if kind not in open_blocks:
                    open_blocks[kind] = new()
                held = open_blocks[kind]
                ids = np.fromiter(map(held["words"].__getitem__, raw.translate(LOWER_TABLE).split()), np.int32)
                held["ids"] += [ids, np.zeros(1, np.int32)]
                held["doc_ids"].append(doc_id)
                held["lengths"].append(len(ids) + 1)
                held["rems"].append(rem)
                held["n"] += len(ids) + 1
                if held["n"] >= most:
                    yield emit(kind, open_blocks.pop(kind))
        for kind in sorted(open_blocks):
            yield emit(kind, open_blocks[kind])

    return docs.select(
        F.col("doc_id").cast("long"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"),
        remainder(F.col("doc_id"), 10).cast("int").alias("rem"),
    ).mapInArrow(encode, _TOKENS)


def opened(row: dict, targets: int) -> Block:
    """A block from its row."""
    lengths = np.asarray(row["lengths"], np.int64)
    return Block(unpack(row["hashes"], np.uint64), unpack(row["tokens"], np.int32), np.cumsum(lengths) - lengths, targets)


def ask_counts(tokens: DataFrame, targets: int) -> DataFrame:
    """What each block asks of each target."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "tuning", "target", *[x for g in GRAMS for x in (g, f"{g}_n")]]
        kinds = [pa.int64(), pa.bool_(), pa.int32(), *[pa.binary()] * 6]
        for batch in batches:
            for row in batch.to_pylist():
                counted = row["rems"][0] != HELD_OUT
                for a in opened(row, targets).asks(counted, targets):
                    values = (row["block"], row["tuning"], *a)
                    yield pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    return tokens.select("block", "tuning", "lengths", "rems", "tokens", "hashes").mapInArrow(ask, _ASK)


def summed(keys: list[np.ndarray], counts: list[np.ndarray], rest: list[bool]) -> tuple[list, list, int, int]:
    """For each block its counts over all blocks, and over those not for tuning; distinct keys of either."""
    flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    _, at = np.unique(flat, return_inverse=True)
    n = np.concatenate(counts).astype(float) if counts else np.zeros(0)
    plain = np.concatenate([np.full(len(k), r) for k, r in zip(keys, rest, strict=True)]) if keys else np.zeros(0, bool)
    every, others = np.bincount(at, n), np.bincount(at, n * plain)
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    return np.split(every[at], cuts), np.split(others[at], cuts), int((every > 0).sum()), int((others > 0).sum())


def answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """One target: sums what all blocks have sent, and answers each in its own order."""
    rest, out = (~pdf.tuning).tolist(), {"block": pdf.block, "target": pdf.target}
    for g in GRAMS:
        every, others, v_all, v_rest = summed([unpack_sorted(b, np.uint64) for b in pdf[g]], [unpack(b, np.uint32) for b in pdf[f"{g}_n"]], rest)
        out[g] = [pack(x.astype(np.uint32)) for x in every]
        out[f"{g}_rest"] = [pack(x.astype(np.uint32)) if t else None for x, t in zip(others, pdf.tuning, strict=True)]
        if g == "words":
            out["v_all"], out["v_rest"] = v_all, v_rest
    out = pd.DataFrame(out)
    out.loc[out.index[1:], ["v_all", "v_rest"]] = 0
    return out[["block", "target", *GRAMS, *[f"{g}_rest" for g in GRAMS], "v_all", "v_rest"]]


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the logarithm of its count to base 2."""
    return np.where(context > 0, np.minimum(BUCKETS - 1, 1 + np.floor(np.log2(np.maximum(context, 1)))), 0).astype(int)


def gathered(counts: list[np.ndarray], block: Block) -> np.ndarray:
    """For each token the counts of its triple, of the pair before it, of its pair, of the word before it and its own."""
    words, pairs, triples = counts
    out = np.zeros((5, len(block.pairs.at)), np.uint32)
    out[2], out[3], out[4] = pairs[block.pairs.at], words[block.before], words[block.words.at]
    out[0, block.inner], out[1, block.inner] = triples[block.triples.at], out[2, block.inner - 1]
    return out


def estimates(c: np.ndarray, n: float, v: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each token, and its estimates (trigram, bigram, unigram, uniform) as columns, from its counts.

    Buckets of a pair's count come after those of a word's."""
    ratio = lambda a, b: np.divide(a, b, out=np.zeros(len(b)), where=b > 0)
    p = np.stack((ratio(c[0], c[1]), ratio(c[2], c[3]), c[4] / max(n, 1.0), np.full(c.shape[1], 1 / (v + 1))), 1)
    return np.where(c[1] > 0, BUCKETS + bucket_of(c[1]), bucket_of(c[3])), p


def first_weights() -> np.ndarray:
    """Weights before the first round, by bucket; those of an unseen context give nothing to its estimates."""
    w = np.tile([0.3, 0.3, 0.3, 0.1], (2 * BUCKETS, 1))
    w[:BUCKETS, 0] = 0  # the pair was not seen
    w[0, 1] = 0
    return w / w.sum(1, keepdims=True)


def shares(bucket: np.ndarray, p: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums, by bucket, of what part of each token's probability each estimate has."""
    part = weights[bucket] * p
    part /= part.sum(1, keepdims=True)
    return np.stack([np.bincount(bucket, part[:, k], 2 * BUCKETS) for k in range(4)], 1)


def renewed(weights: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Weights of the next round; a bucket without tokens keeps its own. The uniform keeps a millionth."""
    seen = sums.sum(1) > 0
    out = weights.copy()
    out[seen] = sums[seen] / sums[seen].sum(1, keepdims=True)
    out[:, 3] = np.maximum(out[:, 3], 1e-6)
    return out / out.sum(1, keepdims=True)


def learn_weights(rows: DataFrame, n: float, v: int) -> np.ndarray:
    """Weights by expectation-maximisation over rows (counts: the packed counts of some tokens)."""
    weights = first_weights()
    for _ in range(ROUNDS):

        def one(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2 * BUCKETS, 4))
            for batch in batches:
                for row in batch.to_pylist():
                    total += shares(*estimates(unpack(row["counts"], np.uint32).reshape(5, -1), n, v), weights)
            yield pa.record_batch([pa.array(np.arange(8 * BUCKETS)), pa.array(total.ravel())], names=["i", "s"])

        got = rows.mapInArrow(one, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
        sums = np.zeros(8 * BUCKETS)
        for r in got:
            sums[r["i"]] = r["s"]
        new = renewed(weights, sums.reshape(-1, 4))
        done = np.abs(new - weights).max() < SETTLED
        weights = new
        if done:
            break
    return weights


def score_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    tune(spark)
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    targets = targets_for(int(n_bytes))
    tokens = materialize(spark, encode_blocks(docs), "lm-blocks")
    answers = materialize(spark, ask_counts(tokens, targets).groupBy("target").applyInPandas(answer, _ANSWER), "lm-answers")
    sizes = tokens.select(F.explode(F.arrays_zip("lengths", "rems")).alias("d")).select(F.col("d.lengths").alias("n"), F.col("d.rems").alias("rem"))
    n_all, n_rest = sizes.agg(
        F.sum(F.when(F.col("rem") != HELD_OUT, F.col("n"))), F.sum(F.when(~F.col("rem").isin(HELD_OUT, TUNING), F.col("n")))
    ).first()
    v_all, v_rest = answers.agg(F.sum("v_all"), F.sum("v_rest")).first()
    n_all, n_rest, v_all, v_rest = (int(x or 0) for x in (n_all, n_rest, v_all, v_rest))

    def estimate(tokens: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        block = opened(tokens.iloc[0], targets)
        return pd.DataFrame({"counts": [pack(gathered(block.placed(replies, "_rest"), block).ravel())]})

    rest = answers.where("words_rest is not null").select("block", "target", *[f"{g}_rest" for g in GRAMS])
    tuning = tokens.where("tuning").groupBy("block").cogroup(rest.groupBy("block")).applyInPandas(estimate, "counts binary")
    weights = learn_weights(materialize(spark, tuning, "lm-tuning").coalesce(max(8, targets // 16)), n_rest, v_rest)
    if not n_all:
        weights = np.tile([0.0, 0.0, 0.0, 1.0], (2 * BUCKETS, 1))

    def score(tokens: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        row = tokens.iloc[0]
        block = opened(row, targets)
        counts = gathered(block.placed(replies), block)
        bucket, p = estimates(counts, n_all, v_all)
        own = counts[4].astype(float)
        base = np.log10((own + 0.1) / (n_all + 0.1 * (v_all + 1)))
        lengths = np.asarray(row.lengths, np.int64)
        add = lambda x: np.add.reduceat(x, np.cumsum(lengths) - lengths)
        return pd.DataFrame(
            {
                "doc_id": pd.array(list(row.doc_ids), "Int64"),
                "held_out": np.asarray(row.rems) == HELD_OUT,
                "n_tokens": lengths,
                "n_known": add((own > 0).astype(np.int64)),
                "train_tokens": n_all,
                "base_score": add(base),
                "score": add(np.log10((weights[bucket] * p).sum(1))),
            }
        )

    return (
        tokens.groupBy("block")
        .cogroup(answers.select("block", "target", *GRAMS).groupBy("block"))
        .applyInPandas(
            score,
            "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )
