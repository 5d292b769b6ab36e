"""The training-data pipeline over documents, as stages that are each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pedolake.llm import bpe_codec, decontaminate, near_dedup, substring_dedup, toxicity
from pedolake.llm.common import materialize

#: Five-word shingles, similar from 0.8 on: a pair at 0.8 shares no band of 46 with probability below 1e-6.
NEAR = near_dedup.NearParams(shingle=5, threshold_percent=80, bands=46)
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the factorization machine does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    params = toxicity.ToxicityParams()
    model = toxicity.fit_toxicity(spark, docs, labels, params)
    score = toxicity.toxicity_score(spark, model, F.col("text"), params)
    return docs.select(DOCUMENT).withColumn("score", score).where(F.col("score") < params.threshold).select(DOCUMENT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates, the one of the least id; texts without words all stay."""
    return near_dedup.one_of_each(spark, docs.select(DOCUMENT), NEAR).select(DOCUMENT)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated substrings out of the texts; bytes left of a character that is cut go with it."""
    carry = ("lang", "source")
    done = substring_dedup.remove_repeats(spark, docs.select(DOCUMENT), keep_text=True, carry=carry, whole_characters=True)
    text = done.select("doc_id", F.col("raw").cast("string").alias("text"), *carry)
    return text.withColumn("n_chars", F.length("text").cast("long")).select(DOCUMENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which no benchmark window occurs."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_contamination(spark, docs.select(DOCUMENT), benchmark)
    return found.where(F.size("hit.ranges") == 0).select(DOCUMENT)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left and proves the round trip."""
    return bpe_codec.encode_documents(spark, docs, public_tokenizers.path("byte_bpe_50k.json"), keep=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("bpe_codec", encode),
]

#: No SQL expresses a fitted model or a byte-pair encoder; tests/llm/test_pipeline_stages.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, in order, writing each result before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
