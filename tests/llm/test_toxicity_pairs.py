"""A label that lies in pairs alone, and the score of whole texts against the formula."""

import math
import zlib

import numpy as np

from pedolake.llm import toxicity

from .test_operators import by_id, held


def exclusive_or(n=3000):
    rng = np.random.default_rng(5)
    filler = [f"f{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        a, b = bool(rng.random() < 0.5), bool(rng.random() < 0.5)
        words = list(rng.choice(filler, 25)) + ["grubs"] * a + ["folk"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(a != b)))
    return rows, labels


def test_exclusive_or_of_two_terms(spark):
    rows, labels = exclusive_or()
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = by_id(toxicity.score_toxicity(spark, d, toxicity.fit_toxicity(spark, d, y)))
    unseen = [i for i in out if held(i, 5)]
    assert np.mean([out[i]["predicted"] == labels[i][1] for i in unseen]) > 0.95
    # weights that only add up cannot tell: the best of all cuts on a + b is at chance or one case of four off
    linear = [max(np.mean([(("grubs" in t.split()) + w * ("folk" in t.split()) > c) == bool(z) for (_, t), (_, z) in zip(rows, labels)]) for c in (-0.5, 0.5, 1.5)) for w in (-1, 1)]
    assert max(linear) < 0.8


def test_score_is_the_formula(spark):
    rows, labels = exclusive_or(800)
    d, y = spark.createDataFrame([*rows, (9001, None), (9002, "grubs GRUBS, folk!")], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    params = toxicity.ToxicityParams()
    model = toxicity.fit_toxicity(spark, d, y, params)
    out = by_id(toxicity.score_toxicity(spark, d, model, params))
    for i, t in [*rows[:50], (9001, ""), (9002, "grubs folk")]:
        words = set(t.encode().split())
        terms = {zlib.crc32(w) % params.buckets for w in words | {b"^" + w[:5] for w in words if len(w) > 5}}
        at = [model.index[x] for x in terms if x in model.index]
        z = model.bias + sum(model.linear[k] for k in at) + sum(float(model.factors[j] @ model.factors[k]) for n, j in enumerate(at) for k in at[:n])
        assert math.isclose(out[i]["score"], 1 / (1 + math.exp(-z)), rel_tol=1e-6), i


def test_sample_is_bounded_when_ids_repeat(spark):
    rows = [(i % 40, f"text {i} " + ("bad" if i % 2 else "good")) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(spark, spark.createDataFrame(rows, "doc_id long, text string"), labels, toxicity.ToxicityParams(fit_rows=100))
    terms = {zlib.crc32(w) % toxicity.ToxicityParams().buckets for w in (b"bad", b"good")}
    assert terms <= set(model.index)
