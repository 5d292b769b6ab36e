"""Token files against the tokenizers library, access without copies, and awkward tables."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pedolake.llm import queries, token_files
from pedolake.llm.token_files import SequenceFile, SequenceWriter, WordIds

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " \n\t ", "one", "One  two's don't", "Die Grüße, naïve café: ΣΑΣ Ünïcode <|endoftext|> it's 12 34!", "a" * 900, "x\0y\x1cz \x85 end\r\nnext line᠎q",
    "é ́a Å <|startoftext|>x", "< | not special |>", "日本語テキスト 😀👩‍👩‍👧 الع", " ".join(f"v{i}" for i in range(20_000)),
]
SCHEMA = "doc_id long, text string, at string, start string, first string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def want(library, rows):
    """doc_id, start, n_tokens, crc32 in order of (id, ids of the text) for rows whose ids differ."""
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def run(spark, rows, length=2048, tasks=3):
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], SCHEMA).repartition(tasks)
    got = [tuple(r) for r in token_files.token_file_report(spark, df, PATH, length=length).collect()]
    return sorted(got, key=lambda r: r[1])


@pytest.mark.parametrize("length", [1, 7, 2048])
def test_awkward_texts(spark, library, length):
    rows = [(3 * i - 9, t) for i, t in enumerate(TEXTS)] + [(None, "no id")]
    assert run(spark, rows, length) == want(library, rows)


def test_whole_table(spark, sf, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.queries()["op13_token_files"](spark, sf).collect()), key=lambda r: r[1])
    assert got == want(library, rows)


def test_repeated_rows(spark, library):
    rows = [(5, "same text")] * 40 + [(5, "another")] * 3 + [(6, "last")]
    got = run(spark, rows)
    alone = {t: want(library, [(0, t)])[0][2:] for t in ("same text", "another", "last")}
    assert sorted(r[2:] for r in got) == sorted(alone[t] for _, t in rows)
    assert [r[1] for r in got] == [sum(x[2] for x in got[:k]) for k in range(len(got))]
    assert [r[0] for r in got] == sorted(r[0] for r in got)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_small_memo_starts_anew(library):
    words = WordIds(PATH, memo=900_000)
    texts = [" ".join(f"word{i * 100 + j}" for j in range(100)) for i in range(60)]
    assert [x.tolist() for t in texts for x in words.encode([t])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert len(words.words) < 6000


def test_sequences_share_the_map(tmp_path):
    path = str(tmp_path / "a.arrows")
    docs = [np.arange(k, dtype=np.uint16) + k for k in (1, 5, 3, 16, 40)]
    with pa.OSFile(path, "wb") as sink:
        w = SequenceWriter(sink, np.uint16, length=4, batch=3)
        for d in docs:
            w.add(d)
        w.close()
    f = SequenceFile(pa.memory_map(path))
    flat = np.concatenate(docs)
    ends = np.cumsum([len(d) for d in docs]) - 1
    assert len(f) == -(-len(flat) // 4) and {b.num_rows for b in f.batches[:-1]} == {3}
    for k in range(len(f)):
        before = pa.total_allocated_bytes()
        ids, mask, last = f.sequence(k)
        assert not ids.flags.owndata and pa.total_allocated_bytes() == before
        part = flat[4 * k : 4 * k + 4]
        assert ids.tolist() == part.tolist() + [0] * (4 - len(part))
        assert mask.to_pylist() == [j < len(part) for j in range(4)]
        assert last.to_pylist() == [4 * k + j in ends for j in range(4)]
    assert all(f.tokens(int(e) - len(d) + 1, len(d)).tolist() == d.tolist() for e, d in zip(ends, docs, strict=True))
    assert pa.types.is_fixed_size_list(f.batches[0].schema.field("ids").type)


def test_named_folder_and_list(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    files = token_files.write_token_files(spark, df, PATH, folder=f"file://{tmp_path}/out")
    listed = files.listed.collect()
    assert sum(r["documents"] for r in listed) == 50
    assert {p.name for p in (tmp_path / "out").iterdir()} == {f"{r['name']}.{x}.arrows" for r in listed for x in ("ids", "docs")}
