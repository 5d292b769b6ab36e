"""The pipeline's stages on planted and awkward rows, and its whole run on the smallest tables."""

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"u{i}" for i in range(40_000))
AWKWARD = [
    (1, None, None, None, None),
    (1, "", "en", "s", 0),
    (1, "alpha beta gamma delta epsilon zeta", "en", "s", 35),
    (1, "alpha beta gamma delta epsilon zeta", "en", "s", 35),
    (2, "alpha beta gamma delta epsilon zeta", "en", "t", 35),
    (1, LONG, "en", "s", len(LONG)),
    (None, "a row without an id", "de", None, 19),
    (3, " \n\t", "en", "s", 3),
    (4, "é" * 500, "fr", "s", 500),
    (5, "é" * 500 + "end", "fr", "s", 503),
]


@pytest.fixture
def docs(spark):
    extra = [(*r, "clash", "clash", 7, "clash") for r in AWKWARD]
    return spark.createDataFrame(extra, f"{SCHEMA}, score string, raw string, t int, hit string").repartition(3)


def test_near_duplicates_go_and_one_stays(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    twice = docs.union(docs.withColumn("doc_id", docs.doc_id + 100_000))
    kept = corpus_pipeline.drop_near_duplicates(spark, twice, sf)
    assert kept.columns == corpus_pipeline.DOCUMENT
    assert kept.where("doc_id >= 100000 and trim(text) <> ''").isEmpty()
    assert kept.where("doc_id < 100000").count() > 50


def test_contaminated_documents_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    planted = docs.limit(20).unionByName(docs.limit(1).selectExpr("-1L as doc_id", f"concat('Before. ', {item!r}, ' After.') as text", "lang", "source", "n_chars"))
    left = corpus_pipeline.drop_contaminated(spark, planted, sf)
    assert left.where("doc_id = -1").isEmpty() and left.count() > 10


def rows(df):
    return sorted(((r["doc_id"] or 0, r["text"] or "") for r in df.collect()), key=repr)


def test_awkward_rows_pass_each_stage(spark, sf, docs):
    every = sorted(((r[0] or 0, r[1] or "") for r in AWKWARD), key=repr)
    assert rows(corpus_pipeline.drop_toxic(spark, docs, sf)) == every
    assert rows(corpus_pipeline.drop_contaminated(spark, docs, sf)) == every
    # copies go down to one row, also under one id; texts without words all stay
    want = [x for x in every if x != (2, AWKWARD[4][1]) and x[0] != 5]
    want.remove((1, AWKWARD[2][1]))
    left = rows(corpus_pipeline.drop_near_duplicates(spark, docs, sf))
    assert left == sorted([*want, (5, AWKWARD[9][1])], key=repr)
    cut = corpus_pipeline.cut_repeats(spark, docs, sf)
    assert cut.count() == len(AWKWARD) and rows(cut.where("doc_id = 4")) == [(4, "")]
    assert [r["text"] for r in cut.where("doc_id = 5").collect()] == ["end"]
    assert corpus_pipeline.encode(spark, docs, sf).count() == len(AWKWARD)


def test_empty_tables_pass_each_stage(spark, sf):
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf).collect()
    assert 0 < len(out) < 200
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "suffix_array_dedup", "decontamination", "bpe_codec"]
