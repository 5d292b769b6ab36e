"""Text tables: decimal-comma CSV, plain CSV, all-text export, and one output per layer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import decimal_comma, to_decimal_comma

_NUMBERS = (T.DoubleType, T.FloatType, T.DecimalType)


def read_csv2(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Semicolon-separated text with decimal commas, under an explicit schema; fails if the path is absent."""
    raw = spark.read.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema])).csv(path, sep=";", header=True)
    typed = {f.name: decimal_comma(F.col(f.name)) if isinstance(f.dataType, _NUMBERS) else F.col(f.name).try_cast(f.dataType) for f in schema}
    return raw.select(*[typed[f.name].alias(f.name) for f in schema])


def write_csv2(df: DataFrame, path: str) -> None:
    """Semicolon-separated text with decimal commas."""
    out = [to_decimal_comma(F.col(f.name)).alias(f.name) if isinstance(f.dataType, _NUMBERS) else F.col(f.name) for f in df.schema]
    df.select(*out).write.csv(path, sep=";", header=True)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Plain CSV with a header, under an explicit schema."""
    return spark.read.schema(schema).csv(path, header=True)


def all_text(df: DataFrame) -> DataFrame:
    """Every column as text, missing values as empty text."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def write_text_table(df: DataFrame, path: str) -> None:
    """Tab-separated text of all columns."""
    all_text(df).write.csv(path, sep="\t", header=True, emptyValue="")


def layers_long(df: DataFrame, keys: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """One row per key and band that has a value."""
    return df.unpivot([F.col(k) for k in keys], [F.col(b) for b in bands], "layer", "value").where("value is not null")


def write_layers(df: DataFrame, keys: Sequence[str], bands: Sequence[str], path: str) -> None:
    """One folder per layer, written by as many tasks as the rows come from."""
    layers_long(df, keys, bands).write.partitionBy("layer").parquet(path)
