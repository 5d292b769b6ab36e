"""Benchmarks of many chunks: the plan stays small and the hits are those of one automaton."""

import pytest

from pedolake.llm import decontaminate


@pytest.mark.parametrize("buffer", [1 << 20, 500])
def test_many_chunks(spark, monkeypatch, buffer):
    items = [(i, " ".join(f"q{i}x{j}" for j in range(14))) for i in range(60)] + [(99, items_end := "alpha beta gamma")]
    texts = [None, "", "none of these", items_end] + [f"before {items[i][1]} between {items[59 - i][1].upper()} after" for i in range(60)] * 2
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i % 100, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    monkeypatch.setattr(decontaminate, "BUFFER_BYTES", buffer)
    chunk = 200
    n = len(list(decontaminate.benchmark_chunks(bench, chunk)))
    assert n >= 25
    found = decontaminate.find_contamination(spark, docs, bench, chunk_bytes=chunk)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 5000
    rows = lambda df: sorted((r["doc_id"], r["text"] or "", r["hit"]["n_words"], [tuple(x) for x in r["hit"]["ranges"]], sorted(r["hit"]["items"])) for r in df.collect())
    got = rows(found)
    assert got == rows(decontaminate.find_contamination(spark, docs, bench)) and len(got) == len(texts)
    assert sum(len(r[4]) for r in got) == 241


def test_buffers_hold_all_batches():
    import pandas as pd

    batches = [pd.Series([b"x" * 10] * n) for n in (3, 1, 0, 5)]
    for most in (0, 25, 1000):
        assert [len(b) for held in decontaminate._buffers(iter(batches), most) for b in held] == [3, 1, 0, 5]
