"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (
    bpe_codec,
    decontaminate,
    embedding_join,
    hard_negatives,
    language_model,
    license_scan,
    near_dedup,
    sharding,
    substring_dedup,
    token_counts,
    token_files,
    toxicity,
    whitening,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return toxicity.score_toxicity(spark, docs, toxicity.fit_toxicity(spark, docs, labels))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.remove_repeats(spark, _table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_cover_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.threshold_join(spark, _table(spark, sf_dir, "embeddings"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(spark, _table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(
        spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(
        spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(spark, _table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(spark, _table(spark, sf_dir, "documents"))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_documents(
        spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(spark, _table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(spark, _table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(spark, _table(spark, sf_dir, "embeddings"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_report(
        spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query, for each numbered operator."""
    found = [
        op1_toxicity,
        op2_suffix_array_dedup,
        op3_cover_tree_join,
        op4_language_model,
        op5_decontamination,
        op6_token_counts,
        op7_minhash_near_dedup,
        op8_license_scan,
        op9_bpe_codec,
        op10_sharding,
        op11_whitening,
        op12_hard_negatives,
        op13_token_files,
    ]
    return {f.__name__: f for f in found}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_REACH = """reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
 comp AS (SELECT a AS id, least(a, min(b)) AS component_id FROM reach GROUP BY a)"""


def _words(column: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


def _windows(source: str, columns: str, n: str) -> str:
    return f"SELECT {columns}, k, {n} AS n, ws[k : k + {n} - 1] AS g FROM {source}, LATERAL (SELECT unnest(range(1, len(ws) - {n} + 2)) AS k) WHERE len(ws) >= {n}"


_OP3 = f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9),
 {_REACH}, n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
 SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
 FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN comp ON comp.id = vec_id"""

_OP5 = f"""WITH d AS (SELECT doc_id, {_words("text", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS ws FROM documents),
 i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words("text", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")} AS ws FROM benchmark),
 sized AS (SELECT item, ws, least(len(ws), 10) AS m FROM i WHERE len(ws) > 0),
 win AS (SELECT DISTINCT item, n, g FROM ({_windows("sized", "item", "m")})),
 sizes AS (SELECT DISTINCT n AS m FROM win), spots AS ({_windows("(SELECT * FROM d, sizes)", "doc_id", "m")}),
 hits AS (SELECT DISTINCT doc_id, k, spots.n, item FROM spots JOIN win ON spots.g = win.g AND spots.n = win.n),
 hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY 1),
 own AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hits GROUP BY 1)
 SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)"""

_OP7 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_words("text", r"[^\x20\x09-\x0D]+")} AS ws FROM documents),
 m AS (SELECT doc_id, ws, least(len(ws), 3) AS m FROM d WHERE len(ws) > 0),
 s AS (SELECT DISTINCT doc_id, g FROM ({_windows("m", "doc_id", "m")})), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
 links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
 {_REACH}
 SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.id = doc_id"""

_OP12 = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(CAST(embedding AS DOUBLE[]), lambda c: floor(256 * c)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
 s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
 p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
 SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
 FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
 QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) <= 3"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for those that it can express; the others are tested against plain versions."""
    return {"op3_cover_tree_join": _OP3, "op5_decontamination": _OP5, "op7_minhash_near_dedup": _OP7, "op12_hard_negatives": _OP12}
