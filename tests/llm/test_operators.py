"""Each operator on one awkward table against a plain version: nulls, empty and long texts, copies, clashing columns."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pedolake.llm import (
    bpe_codec,
    decontaminate,
    embedding_join,
    language_model,
    license_scan,
    near_dedup,
    sharding,
    substring_dedup,
    token_counts,
    toxicity,
)

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = [f"w{i % 97}x{i}" for i in range(900)]
PASSAGE = " ".join(WORDS[300:360])
TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "one two",
    "Die Grüße, naïve café: Ünïcode <|endoftext|> don't 12 34!",
    "a" * 700,
    "ab" * 400,
    " ".join(WORDS[:120]),
    " ".join(WORDS[:120]),
    " ".join(WORDS[:118] + ["other", "end"]),
    "Start. " + PASSAGE + " stop.",
    "Another start here; " + PASSAGE + " and more.",
    " ".join(WORDS[400:430]) + "\nReleased under the MIT License.\n" + " ".join(WORDS[430:440]),
    " ".join(f"v{i}" for i in range(30_000)),
    "x\0y\x1cz \x85 end\r\nnext line",
]
SCHEMA = "doc_id long, text string, score string, shard string, n_tokens string, hit string, block string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s", "h", "n", "i", "b") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict(True) for r in df.collect()}


def held(i, mod):
    return zlib.crc32(str(i).encode()) % mod == 0


# 1


def test_toxicity_learns_pairs(spark):
    rng = np.random.default_rng(0)
    filler = [f"f{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(1500):
        insult, group = bool(rng.random() < 0.5), bool(rng.random() < 0.5)
        words = list(rng.choice(filler, 20)) + ["grubs"] * insult + ["folk"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(insult and group)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = by_id(toxicity.score_toxicity(spark, d, toxicity.fit_toxicity(spark, d, y)))
    unseen = [i for i in out if held(i, 5)]
    assert unseen and all(out[i]["held_out"] for i in unseen)
    assert np.mean([out[i]["predicted"] == labels[i][2] for i in unseen]) > 0.97


def test_toxicity_awkward(spark, docs, nothing):
    labels = spark.createDataFrame([(8, 1, 1), (11, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = by_id(toxicity.score_toxicity(spark, docs, toxicity.fit_toxicity(spark, docs, labels)))
    assert len(out) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in out.values())
    model = toxicity.fit_toxicity(spark, nothing, labels.limit(0))
    assert all(r["score"] == 0 and r["predicted"] == 0 for r in by_id(toxicity.score_toxicity(spark, docs, model)).values())
    assert toxicity.score_toxicity(spark, nothing, model).count() == 0


# 2


def plain_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    n = collections.Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if n[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(x), len(x) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def test_substring_dedup(spark, docs, nothing):
    out = by_id(substring_dedup.remove_repeats(spark, docs, keep_text=True, carry=("block",)))
    for i, want in enumerate(plain_repeats(TEXTS, 200)):
        r = out[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["raw"])) == want, i
        assert r["block"] == "b"
    assert out[11]["n_removed"] > 200 and out[8]["n_removed"] == out[8]["n_bytes"]
    assert substring_dedup.remove_repeats(spark, nothing).count() == 0


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK", 1 << 12)
    substring_dedup._powers.cache_clear()
    rng = np.random.default_rng(1)
    text = rng.integers(97, 123, 20_000).astype(np.uint8).tobytes()
    runs = substring_dedup.picks([text], 200)
    covered = np.zeros(len(text), int)
    for first, n in zip(runs["first"], runs["n"], strict=True):
        covered[first : first + n] += 1
    assert (covered[: len(text) - 199] == 1).all()
    substring_dedup._powers.cache_clear()


# 3


def plain_join(ids, vectors, cosine):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for v in vectors]
    unit = [np.array(v, float) / np.linalg.norm(v) if k else None for v, k in zip(vectors, ok, strict=True)]
    near = [[j for j in range(len(ids)) if j != i and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(len(ids))]
    comp = list(range(len(ids)))
    for _ in ids:
        comp = [min([comp[i], *(comp[j] for j in near[i])]) for i in range(len(ids))]
    return {ids[i]: (len(near[i]), min(ids[k] for k in range(len(ids)) if comp[k] == comp[i])) for i in range(len(ids))}


@pytest.mark.parametrize("block", [2048, 20])
def test_cover_tree_join(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_join, "BLOCK", block)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 6))
    vectors = [(c + rng.normal(0, 0.25, 6)).tolist() for c in centres for _ in range(8)]
    vectors += [vectors[0], vectors[0], [x * 3 for x in vectors[5]], None, [], [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6, [1.0, 2.0]]
    ids = [int(i) for i in rng.permutation(len(vectors))]
    df = spark.createDataFrame(list(zip(ids, vectors, ["z"] * len(ids), strict=True)), "vec_id long, embedding array<double>, n_links string")
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_join.threshold_join(spark, df).collect()}
    assert out == plain_join(ids, vectors, 0.9)
    assert embedding_join.threshold_join(spark, df.limit(0)).count() == 0


# 4


def test_language_model(spark, docs, nothing):
    out = by_id(language_model.score_documents(spark, docs))
    toks = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) + [""] for t in TEXTS]
    c = collections.Counter(w for i, t in enumerate(toks) if not held(i, 10) for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(toks):
        r = out[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i, 10), len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), abs=1e-6)
        assert math.isfinite(r["score"]) and r["score"] <= 0
    assert language_model.score_documents(spark, nothing).count() == 0


# 5


def test_decontamination(spark, docs, nothing):
    items = [(1, PASSAGE), (2, "one"), (3, None), (4, " ,. "), (5, "W0X0, w1x1"), (1, PASSAGE), (12, " ".join(WORDS[305:316]).upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = {}
    for item, text in items:
        w = pattern.findall((text or "").translate(LOW))
        for k in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(str(item))
    for chunk in (200_000, 150):
        found = decontaminate.find_contamination(spark, docs.select("doc_id", "text"), bench, chunk_bytes=chunk)
        hits = by_id(found.select("doc_id", "hit.*", decontaminate.hit_words(F.col("hit.ranges")).alias("n_hit")))
        for i, t in enumerate(TEXTS):
            w = pattern.findall((t or "").translate(LOW))
            hit, ids = set(), set()
            for k in range(len(w)):
                for win, own in wins.items():
                    if tuple(w[k : k + len(win)]) == win:
                        hit.update(range(k, k + len(win)))
                        ids |= own
            assert (hits[i]["n_words"], hits[i]["n_hit"], sorted(set(hits[i]["items"]))) == (len(w), len(hit), sorted(ids)), (i, chunk)
    report = by_id(decontaminate.contamination_report(spark, docs, bench))
    assert report[11]["contaminated"] and not report[14]["contaminated"]
    spans = [r["passage"] for r in decontaminate.contaminated_spans(spark, docs, bench).where("doc_id = 11").collect()]
    assert spans == [PASSAGE]
    assert decontaminate.contamination_report(spark, nothing, bench).count() == 0
    assert not any(r["contaminated"] for r in by_id(decontaminate.contamination_report(spark, docs, bench.limit(0))).values())


# 6 and 9


def test_token_counts(spark, docs, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    out = by_id(token_counts.count_tokens(spark, docs, path))
    for i, x in enumerate(TEXTS):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (out[i]["n_bytes"], out[i]["n_tokens"], out[i]["over_limit"]) == (len((x or "").encode()), n, n > 2048), i
    assert token_counts.count_tokens(spark, nothing, path).count() == 0


def test_token_counts_forget():
    path = public_tokenizers.path("word_bpe_49k.json")
    t, small = Tokenizer.from_file(path), token_counts.WordEndCounter(path, memo=3)
    for x in ["alpha beta gamma delta", "ΑΣ Σ İ ﬁ Å", "<|startoftext|>a<|endoftext|>", "word " * 50 + "y" * 900]:
        assert small.count(x) == len(t.encode(x, add_special_tokens=False).ids)


def test_bpe_codec(spark, docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    out = by_id(bpe_codec.encode_documents(spark, docs, path, 64))
    for i, x in enumerate(TEXTS):
        ids = t.encode(x or "", add_special_tokens=False).ids
        r = out[i]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()), i
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    lexicon = bpe_codec.build_lexicon(spark, docs, path, 64)
    back = docs.select("doc_id", "text", bpe_codec.decode_ids(spark, bpe_codec.encode_ids(spark, F.col("text"), path, lexicon), path, lexicon).alias("back"))
    assert all((r["text"] or "") == r["back"] for r in back.collect())
    assert bpe_codec.encode_documents(spark, nothing, path).count() == 0


def test_lexicon_is_minimal_and_exact():
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["walking", "talking", "walked", "talked", "walk", "talk"])}
    lexicon = bpe_codec.Lexicon(bpe_codec.compile_lexicon(words))
    assert all(lexicon.find(w) == ids for w, ids in words.items())
    assert all(lexicon.find(w) is None for w in (b"", b"wal", b"walks", b"x"))
    assert len(lexicon.final) < len(set(b"".join(words))) + 6  # both stems share their endings
    assert bpe_codec.Lexicon(bpe_codec.compile_lexicon({})).find(b"a") is None


# 7


@pytest.mark.parametrize("chunk", [512, 3])
def test_near_duplicates(spark, docs, nothing, monkeypatch, chunk):
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(150)]
    texts = list(TEXTS)
    for _ in range(14):
        w = list(base)
        for k in rng.choice(150, int(rng.integers(1, 7)), replace=False):
            w[k] = f"e{rng.integers(1 << 30)}"
        texts.append(" ".join(w))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = by_id(near_dedup.near_duplicates(spark, d))
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append({tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set())
    comp = list(range(len(texts)))
    links = [(i, j) for i in comp for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    for _ in comp:
        for i, j in links:
            comp[i] = comp[j] = min(comp[i], comp[j])
    for i in range(len(texts)):
        assert (out[i]["n_shingles"], out[i]["component_id"], out[i]["kept"]) == (len(sets[i]), comp[i], comp[i] == i), i
    assert near_dedup.near_duplicates(spark, nothing).count() == 0


def test_odd_sketches_estimate():
    rng = np.random.default_rng(4)
    for j in (0.75, 0.85, 0.95):
        gaps = []
        for _ in range(40):
            n = 400
            both = rng.integers(0, 1 << 63, int(n * 2 * j / (1 + j)), dtype=np.uint64)
            a, b = (np.concatenate((both, rng.integers(0, 1 << 63, n - len(both), dtype=np.uint64))) for _ in range(2))
            s = [np.frombuffer(near_dedup.odd_sketch(near_dedup.samples(x)), np.uint64)[None] for x in (a, b)]
            gaps.append(near_dedup.estimate(*s)[0] - j)
        assert abs(np.mean(gaps)) < 0.02 and np.min(gaps) > -near_dedup.MARGIN


# 8


def plain_dice(a, b):
    a, b = ([w for w in re.split(r"[^0-9a-z\x80-\U0010ffff]+", x.translate(LOW)) if w] for x in (a, b))
    a, b = (set(zip(x, x[1:])) if len(x) > 1 else {(w,) for w in x} for x in (a, b))
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def test_license_scan(spark, docs, nothing):
    out = by_id(license_scan.scan_licenses(spark, docs))
    assert out[13]["license"] == "MIT" and out[13]["dice"] == 1.0
    assert all(r["license"] is None and r["dice"] == 0 for i, r in out.items() if i != 13)
    lines = ["Licensed under the Apache License, Version 2.0.", "licensed under apache license version 2.0", "Released under MIT", "the of and", ""]
    d = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    for i, r in by_id(license_scan.scan_licenses(spark, d)).items():
        best = max(plain_dice(lines[i], t) for _, t in license_scan.TEMPLATES)
        assert r["dice"] == pytest.approx(best if best >= 0.8 else 0.0)
    assert license_scan.scan_licenses(spark, nothing).count() == 0


# 10


def test_sharding(spark, docs, nothing):
    many = docs.select("doc_id", "text").crossJoin(spark.range(20).select(F.col("id").alias("k")))
    many = many.select((F.col("doc_id") * 20 + F.col("k")).alias("doc_id"), "text")
    many = many.unionByName(many.limit(3)).unionByName(spark.createDataFrame([(None, None), (None, None)], "doc_id long, text string"))
    rows = sharding.shard_documents(spark, many).collect()
    sizes = collections.Counter(r["shard"] for r in rows)
    assert len(rows) == many.count() and set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    for r in rows[:200]:
        if r["doc_id"] is not None:
            raw = (TEXTS[r["doc_id"] // 20] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
    assert sharding.shard_documents(spark, nothing).count() == 0


def test_ring_moves_little():
    owner = [0, 1, 2, 0, 1, 2]
    placed = sharding.walk([10, 0, 2, 4, 1, 1], owner, [6, 6, 6])
    filled = collections.Counter()
    for _, _, n, shard in placed:
        filled[shard] += n
    assert filled == {0: 6, 1: 6, 2: 6}
    assert (0, 0, 6, 0) in placed and (0, 6, 3, 1) in placed or (0, 6, 4, 1) in placed  # the overflow goes clockwise
