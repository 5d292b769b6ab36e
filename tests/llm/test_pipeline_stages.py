"""Each stage of the pipeline against a plain version of it."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pedolake.llm import near_dedup, toxicity

from .test_operators import LOW, plain_repeats

WORDS = [f"a{i}" for i in range(1000)]
BLOCK = WORDS[:400] + [f"n{i}" for i in range(100)] + WORDS[500:]
OTHER = [f"o{i}" for i in range(500)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def plain_kept(texts, words, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())
    comp = list(range(len(texts)))
    links = [(i, j) for i in comp for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    for _ in comp:
        for i, j in links:
            comp[i] = comp[j] = min(comp[i], comp[j])
    return [i for i in range(len(texts)) if comp[i] == i]


def test_near_duplicates_take_five_words_and_four_fifths(spark, sf):
    rng = np.random.default_rng(6)
    texts = [" ".join(WORDS), " ".join(BLOCK), " ".join(OTHER), " ".join(OTHER + [f"p{i}" for i in range(120)]), None, "one two three four", "ONE two three four", "one two three"]
    base = [f"b{i}" for i in range(300)]
    for _ in range(25):
        w = list(base)
        for k in rng.choice(300, int(rng.integers(1, 16)), replace=False):
            w[k] = f"e{rng.integers(1 << 30)}"
        texts.append(" ".join(w))
    docs = frame(spark, texts)
    left = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect())
    assert 0 in left and not {1, 3} & set(left)
    assert left == plain_kept(texts, 5, 80)
    # op7 keeps its own contract
    op7 = near_dedup.near_duplicates(spark, docs).where("kept").collect()
    assert sorted(r["doc_id"] for r in op7) == plain_kept(texts, 3, 85) and {0, 1} <= {r["doc_id"] for r in op7}


def test_bands_and_margin_of_the_stage():
    p = corpus_pipeline.NEAR
    assert (1 - 0.8**p.rows) ** p.bands < 1e-6
    rng, gaps = np.random.default_rng(4), []
    for _ in range(200):
        both = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
        a, b = (np.concatenate((both, rng.integers(0, 1 << 63, 100, dtype=np.uint64))) for _ in range(2))
        s = [np.frombuffer(near_dedup.odd_sketch(near_dedup.samples(x, p)), np.uint64)[None] for x in (a, b)]
        gaps.append(near_dedup.estimate(*s, p)[0] - 0.8)
    assert abs(np.mean(gaps)) < 0.01 and 5 * np.std(gaps) < p.margin * 1.1


def test_other_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(corpus_pipeline.DOCUMENT)
    params = toxicity.ToxicityParams()
    scored = toxicity.score_toxicity(spark, docs, toxicity.fit_toxicity(spark, docs, spark.read.parquet(f"{sf}/labels.parquet"), params))
    want = sorted(r["doc_id"] for r in scored.where("predicted = 0").collect())
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, sf).collect()) == want

    rows = docs.orderBy("doc_id").limit(20).collect()
    texts = [r["text"] for r in rows] + [rows[0]["text"][:400] + "é" + rows[1]["text"][:400], rows[0]["text"][:400] + "é" + "end"]
    cut = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_repeats(spark, frame(spark, texts), sf).collect()}
    assert [cut[i] for i in range(len(texts))] == [p[4].decode("utf-8", "ignore") for p in plain_repeats(texts, 200)]

    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    planted = texts[:20] + ["Before. " + items[0] + " After.", items[1].upper()]
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = {" ".join(["", *w[k : k + 10], ""]) for w in map(norm, items) if w for k in range(max(1, len(w) - 9))}
    clean = [i for i, t in enumerate(planted) if not any(x in " ".join(["", *norm(t), ""]) for x in windows)]
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, frame(spark, planted), sf).collect()) == clean and not {20, 21} & set(clean)

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in corpus_pipeline.encode(spark, frame(spark, texts), sf).collect():
        ids = t.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
