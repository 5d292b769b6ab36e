"""Registered queries against their SQL, and the columns of the others, on the smallest tables."""

import harness
import pytest

from pedolake.llm import queries

COLUMNS = {
    "op1_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op2_suffix_array_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op4_language_model": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op6_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op8_license_scan": ["doc_id", "license", "dice", "n_matches", "licenses"],
    "op9_bpe_codec": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op10_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op13_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf, duck, name):
    said = harness.compare(queries.queries()[name](spark, sf), duck, queries.oracle_sql()[name])
    assert not said, said


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_one_row_per_document(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    ids = sorted(r["doc_id"] for r in df.select("doc_id").collect())
    assert df.columns == COLUMNS[name]
    assert ids == sorted(r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
