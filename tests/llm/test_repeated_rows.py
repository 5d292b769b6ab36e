"""Repeated ids over different texts, hot ids, null ids: every operator keeps its rows and links."""

import numpy as np

from pedolake.llm import near_dedup


def words(seed, n=60):
    rng = np.random.default_rng(seed)
    return [f"w{rng.integers(1 << 30)}" for _ in range(n)]


def test_links_of_rows_that_share_an_id(spark):
    a, b, c = words(1), words(2), words(3)
    close = lambda w: " ".join([*w[:58], "x", "y"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (9, close(b)), (7, close(a)), (None, " ".join(c)), (3, close(c)), (None, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = near_dedup.near_duplicates(spark, docs).collect()
    assert len(out) == len(rows)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in out if r["n_shingles"])
    assert got == [(False, 3, 58, 3, True), (False, 5, 58, 5, True), (False, 5, 58, 5, True), (False, 7, 58, 5, False), (False, 9, 58, 5, False), (True, 0, 58, 3, False)]
    left = near_dedup.one_of_each(spark, docs.withColumn("t", docs.text)).collect()
    assert sorted((r["doc_id"] or 0, r["t"] or "") for r in left) == sorted([(5, rows[0][1]), (5, rows[1][1]), (0, rows[4][1]), (0, ""), (5, "")])


def test_one_of_equal_rows(spark):
    text = " ".join(words(4))
    docs = spark.createDataFrame([(1, text), (1, text), (1, text), (2, text), (8, "a b c d"), (8, ""), (8, "")], "doc_id long, text string")
    left = near_dedup.one_of_each(spark, docs).collect()
    assert sorted((r["doc_id"], r["text"]) for r in left) == [(1, text), (8, ""), (8, ""), (8, "a b c d")]
    assert near_dedup.one_of_each(spark, docs.limit(0)).count() == 0
