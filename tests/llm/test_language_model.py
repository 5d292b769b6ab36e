"""The score against a plain version: counts in dictionaries, one loop over tokens, the same rounds of EM."""

import collections
import math
import re

import numpy as np
import pytest

from pedolake.llm import language_model as lm

from .test_operators import LOW, TEXTS, by_id, held


def bucket(c):
    return min(lm.BUCKETS - 1, 1 + int(math.log2(c))) if c else 0


def counts_of(texts):
    n = [collections.Counter() for _ in range(3)]
    for t in texts:
        for i, w in enumerate(t):
            v = t[i - 1] if i else ""
            n[0][w] += 1
            n[1][v, w] += 1
            if i:
                n[2][t[i - 2] if i > 1 else "", v, w] += 1
    return n


def estimates(t, n):
    c1, c2, c3 = n
    total, kinds = sum(c1.values()), len(c1)
    for i, w in enumerate(t):
        v = t[i - 1] if i else ""
        bi = c2[v, w] / c1[v] if c1[v] else 0.0
        u = t[i - 2] if i > 1 else ""
        pair = c2[u, v] if i else 0
        tri = c3[u, v, w] / pair if pair else 0.0
        yield (lm.BUCKETS + bucket(pair) if pair else bucket(c1[v])), (tri, bi, c1[w] / max(total, 1), 1 / (kinds + 1))


def plain_scores(texts, ids):
    toks = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) + [""] for t in texts]
    rem = [__import__("zlib").crc32(str(i).encode()) % 10 for i in ids]
    rest = counts_of([t for t, r in zip(toks, rem) if r not in (0, 1)])
    weights = lm.first_weights()
    tuning = [x for t, r in zip(toks, rem) if r == 1 for x in estimates(t, rest)]
    for _ in range(lm.ROUNDS):
        sums = np.zeros_like(weights)
        for b, p in tuning:
            part = weights[b] * np.array(p)
            sums[b] += part / part.sum()
        new = lm.renewed(weights, sums)
        done = abs(new - weights).max() < lm.SETTLED
        weights = new
        if done:
            break
    every = counts_of([t for t, r in zip(toks, rem) if r != 0])
    return [sum(math.log10(weights[b] @ np.array(p)) for b, p in estimates(t, every)) for t in toks], weights


@pytest.mark.parametrize("tokens", [1_500_000, 300])
def test_scores(spark, monkeypatch, tokens):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", tokens)
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = list(TEXTS[:14]) + [" ".join(rng.choice(vocabulary, int(rng.integers(1, 60)), p=np.arange(60, 0, -1) / 1830)) for _ in range(90)]
    texts += texts[20:30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want, weights = plain_scores(texts, range(len(texts)))
    assert np.allclose(weights.sum(1), 1) and (weights >= 0).all() and (weights[:, 3] > 0).all()
    for i, r in by_id(lm.score_documents(spark, docs)).items():
        assert r["score"] == pytest.approx(want[i], abs=1e-6) and r["held_out"] == held(i, 10), i


def test_no_training_rows(spark):
    only = next(i for i in range(100) if held(i, 10))
    r = lm.score_documents(spark, spark.createDataFrame([(only, "a b")], "doc_id long, text string")).first()
    assert (r["score"], r["base_score"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (0.0, 0.0, 3, 0, 0)
