"""Repeated substrings at several lengths, on periodic texts, edits and hot picks, against counting every window."""

import numpy as np
import pytest

from pedolake.llm import substring_dedup

from .test_operators import plain_repeats


def texts_of(seed):
    rng = np.random.default_rng(seed)
    letters = lambda n: bytes(rng.integers(97, 101, n).astype(np.uint8)).decode()
    unit, passage = letters(7), letters(900)
    texts = [unit * 150, letters(30) + unit * 90 + letters(30), "x" * 1200, "x" * 450 + "y" + "x" * 450]
    for _ in range(12):
        a, b = sorted(rng.integers(0, 900, 2).tolist())
        texts.append(letters(int(rng.integers(0, 80))) + passage[a:b] + letters(int(rng.integers(0, 80))))
    for _ in range(8):
        edited = list(passage)
        for k in rng.integers(0, 900, 3):
            edited[k] = "z"
        texts.append("".join(edited))
    return [*texts, passage, passage, "é" * 260, None, ""]


@pytest.mark.parametrize(("length", "hot"), [(200, 2048), (200, 2), (300, 2048), (400, 2), (40, 3)])
def test_every_window(spark, monkeypatch, length, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 4000)
    texts = texts_of(length)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    out = {r["doc_id"]: r for r in substring_dedup.remove_repeats(spark, docs, length, keep_text=True).collect()}
    for i, want in enumerate(plain_repeats(texts, length)):
        r = out[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["raw"])) == want, i


def test_repeated_ids_keep_their_rows(spark):
    rows = [(1, "a" * 50), (1, "b" * 300), (1, "b" * 300), (None, "c"), (None, None)]
    out = substring_dedup.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["n_bytes"], r["n_removed"]) for r in out) == [(0, 0), (1, 0), (50, 0), (300, 300), (300, 300)]


def test_length_is_checked(spark):
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(spark, spark.range(0).selectExpr("id as doc_id", "'' as text"), length=3)
