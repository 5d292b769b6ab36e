"""Toxicity scores by a factorization machine over hashed terms.

A document is its set of hashed terms: lower-cased words of letters and digits, and the beginnings of
longer words, so that an inflected form is known by its stem. The machine scores
``w0 + sum_i w_i + sum_{i<j} <v_i, v_j>`` over that set, so pairs of terms add to what terms weigh
alone. The fitted terms are those that tell the labels apart by themselves, and those that do so in a
pair beyond what both say alone (an exclusive-or, say), looked for among the most varied terms. The
machine is fitted on a bounded sample of labelled rows (``ToxicityParams.fit_rows``, by least hash);
the score is then computed for every whole text, in one scan.

Defined results: a null or empty text, or one without fitted terms, gets the score of ``w0`` alone;
with no labelled rows at all the score is 0 and nothing is predicted toxic. Repeated rows get equal
scores. Columns beside ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_TABLE, remainder, tune


@dataclass(frozen=True)
class ToxicityParams:
    """fit_rows bounds the labelled sample, terms and paired the fitted hashed terms (by themselves, for pairs),
    varied the terms whose pairs are looked at, buckets the hash range."""

    fit_rows: int = 20_000
    terms: int = 1024
    varied: int = 1024
    paired: int = 256
    pair_deviate: float = 5.5
    buckets: int = 1 << 22
    rank: int = 8
    min_rows: int = 5
    min_deviate: float = 3.0
    steps: int = 1500
    batch: int = 256
    rate: float = 0.05
    decay: float = 1e-4
    seed: int = 17
    threshold: float = 0.5


@dataclass(frozen=True)
class FactorizationMachine:
    """Weights by position; index maps a hash bucket to its position."""

    index: dict[int, int] = field(default_factory=dict)
    bias: float = -1e9
    linear: np.ndarray = field(default_factory=lambda: np.zeros(0))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))

    def score(self, text: bytes | None, buckets: int) -> float:
        """Probability that the text is toxic."""
        at = [self.index[t] for t in hashed_terms(text, buckets) if t in self.index]
        z = self.bias
        if at:
            v = self.factors[at]
            s = v.sum(0)
            z += float(self.linear[at].sum() + 0.5 * (s @ s - (v * v).sum()))
        return 0.0 if z < -700 else 1.0 / (1.0 + math.exp(-z))


def hashed_terms(text: bytes | None, buckets: int) -> set[int]:
    """Hash buckets of a text's distinct words, and of the first five bytes of longer ones."""
    if not text:
        return set()
    words = set(text.translate(WORD_TABLE).split())
    words.update([b"^" + w[:5] for w in words if len(w) > 5])
    return {zlib.crc32(w) % buckets for w in words}


def _matrix(sets: list[np.ndarray], terms: np.ndarray, buckets: int) -> np.ndarray:
    """1 where a set (row) holds a term (column)."""
    place = np.full(buckets, -1, np.int32)
    place[terms] = np.arange(len(terms))
    x = np.zeros((len(sets), len(terms)), np.uint8)
    for row, own in zip(x, sets, strict=True):
        at = place[own]
        row[at[at >= 0]] = 1
    return x


def pair_deviates(x: np.ndarray, y: np.ndarray, prior: float) -> np.ndarray:
    """For each pair of terms: how far its positive rows are from what both terms' own rates add up to."""
    both, hits = (np.zeros((x.shape[1], x.shape[1]), np.float32) for _ in range(2))
    for at in range(0, len(x), 1024):
        part = x[at : at + 1024].astype(np.float32)
        both += part.T @ part
        hits += part.T @ (part * y[at : at + 1024, None])
    rate = np.diag(hits) / np.maximum(np.diag(both), 1)
    expected = both * np.clip(rate[:, None] + rate[None] - prior, 0, 1)
    z = np.abs(hits - expected) / np.sqrt(both * prior * (1 - prior) + 1.0)
    np.fill_diagonal(z, 0)
    return z


def fit_machine(sets: list[np.ndarray], labels: np.ndarray, params: ToxicityParams) -> FactorizationMachine:
    """Fits the machine on term sets and 0/1 labels by minibatch AdaGrad on the logistic loss."""
    y = np.asarray(labels, np.float32)
    if not len(y):
        return FactorizationMachine()
    prior = (y.sum() + 0.5) / (len(y) + 1.0)
    bias = float(np.log(prior / (1 - prior)))
    n, hits = np.zeros(params.buckets, np.int32), np.zeros(params.buckets, np.int32)
    for terms, label in zip(sets, y.astype(np.int32), strict=True):
        n[terms] += 1
        hits[terms] += label
    seen = np.flatnonzero(n >= params.min_rows)
    n, hits = n[seen].astype(float), hits[seen].astype(float)
    # the sets of long texts hold most words, so a term is held against a smoothed binomial deviate
    z = np.abs(hits - n * prior) / np.sqrt(n * prior * (1 - prior) + 1.0)
    order = np.lexsort((seen, -z))[: params.terms]
    order = order[z[order] >= params.min_deviate]
    varied = np.lexsort((seen, -n * (len(y) - n)))[: params.varied]
    beyond = pair_deviates(_matrix(sets, seen[varied], params.buckets), y, prior).max(1, initial=0)
    telling = np.lexsort((seen[varied], -beyond))[: params.paired]
    order = np.concatenate((order, np.setdiff1d(varied[telling[beyond[telling] >= params.pair_deviate]], order)))
    x = _matrix(sets, seen[order], params.buckets)
    rng = np.random.default_rng(params.seed)
    w = np.zeros(len(order), np.float32)
    v = rng.normal(0, 0.01, (len(order), params.rank)).astype(np.float32)
    # the rarer class weighs more, so that a rare label still reaches the threshold
    rare = np.sqrt((1 - prior) / prior)
    weight = np.where(y == 1, rare, 1.0).astype(np.float32)
    gw, gv, gb = np.full_like(w, 1e-6), np.full_like(v, 1e-6), 1e-6
    for _ in range(-(-params.steps * params.batch // len(y)) if len(order) else 0):
        shuffled = rng.permutation(len(y))
        for start in range(0, len(y), params.batch):
            rows = shuffled[start : start + params.batch]
            xb = x[rows].astype(np.float32)
            s = xb @ v
            score = bias + xb @ w + 0.5 * ((s * s).sum(1) - xb @ (v * v).sum(1))
            err = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[rows]) * weight[rows] / len(rows)
            dw = xb.T @ err + params.decay * w
            dv = xb.T @ (err[:, None] * s) - v * (xb.T @ err)[:, None] + params.decay * v
            db = float(err.sum())
            gw += dw * dw
            gv += dv * dv
            gb += db * db
            w -= params.rate * dw / np.sqrt(gw)
            v -= params.rate * dv / np.sqrt(gv)
            bias -= params.rate * db / gb**0.5
    index = {int(t): i for i, t in enumerate(seen[order])}
    return FactorizationMachine(index, bias, w.astype(float), v.astype(float))


def fit_toxicity(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()
) -> FactorizationMachine:
    """Learns from labelled rows (doc_id, toxic) whose id's crc32 modulo 5 is not 0.

    At most ``fit_rows`` labelled rows are taken, those with the least hash of their id; their ids are
    joined to the texts as a broadcast of that proven size. Where ids repeat, so many of the joined rows
    are taken, those with the least hash of id and text.
    """
    tune(spark)
    taken = (
        labels.where("toxic is not null and doc_id is not null")
        .where(remainder(F.col("doc_id"), 5) != 0)
        .select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(params.fit_rows)
    )
    buckets = params.buckets

    @F.pandas_udf("binary")
    def terms_of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: np.array(sorted(hashed_terms(t, buckets)), np.int32).tobytes())

    sample = (
        docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
        .join(F.broadcast(taken), "doc_id")
        .select(F.xxhash64("doc_id", "raw").alias("turn"), "toxic", terms_of("raw").alias("terms"))
        .orderBy("turn", "toxic")
        .limit(params.fit_rows)
        .select("terms", "toxic")
    )
    rows = sample.collect()
    sets = [np.frombuffer(r["terms"], np.int32) for r in rows]
    return fit_machine(sets, np.array([r["toxic"] for r in rows]), params)


def toxicity_score(spark: SparkSession, model: FactorizationMachine, text: Column, params: ToxicityParams) -> Column:
    """Column with the score of each whole text."""
    tune(spark)
    shared = spark.sparkContext.broadcast((model, params.buckets))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine, buckets = shared.value
        for texts in batches:
            yield texts.map(lambda t: machine.score(t, buckets)).astype("float64")

    return score(F.coalesce(text, F.lit("")).cast("binary"))


def score_toxicity(
    spark: SparkSession, docs: DataFrame, model: FactorizationMachine, params: ToxicityParams = ToxicityParams()
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 at a score of the threshold or more)."""
    scored = docs.select(
        "doc_id",
        (remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        toxicity_score(spark, model, F.col("text"), params).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= params.threshold).cast("int"))
