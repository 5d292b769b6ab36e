"""Inputs derived from the given tables, as SQL text that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "labels",
]

DERIVED = {
    "soil": """
SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS row_id, l_suppkey AS coord_id, l_partkey % 37 AS profile_id,
       CAST((l_linenumber - 1) * 15 AS DOUBLE) AS upper_depth_cm,
       CAST((l_linenumber - 1) * 15 + 5 + l_orderkey % 11 AS DOUBLE) AS lower_depth_cm,
       CASE WHEN l_orderkey % 10 < 9 THEN l_quantity END AS c_gkg,
       CASE WHEN l_partkey % 5 <> 0 THEN l_extendedprice END AS sand_gkg,
       CASE WHEN l_suppkey % 3 <> 0 THEN l_discount + 0.0 END AS clay_gkg,
       CASE WHEN (l_orderkey + l_partkey) % 2 = 0 THEN l_tax + 0.0 END AS p_mgkg,
       CASE WHEN l_linenumber <= 4 THEN CAST(l_linenumber AS DOUBLE) END AS k_mmolkg
FROM lineitem""",
    "cells": """
SELECT l_partkey AS row, l_suppkey AS col, CAST(l_suppkey AS DOUBLE) * 30.0 + 15.0 AS x,
       60000.0 - CAST(l_partkey AS DOUBLE) * 30.0 - 15.0 AS y,
       MIN(l_quantity) / 50.0 AS b1, MAX(l_quantity) / 60.0 + 0.05 AS b2, MIN(l_extendedprice) / 100000.0 + 0.01 AS b3,
       CASE WHEN (l_partkey + l_suppkey) % 7 <> 0 THEN MAX(l_discount) * 5.0 + 0.1 END AS b4
FROM lineitem GROUP BY l_partkey, l_suppkey""",
    "predobs": """
SELECT CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS row_id, l_suppkey % 5 AS run, l_returnflag AS grp,
       l_extendedprice AS obs, l_quantity * 1500.0 AS pred
FROM lineitem""",
    "predcls": """
SELECT l_suppkey % 5 AS run, l_returnflag AS obs,
       CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS pred
FROM lineitem""",
    "points": "SELECT event_id AS point_id, CAST(user_id AS DOUBLE) + 0.5 AS x, value AS y, event_type FROM events",
    "polygons": """
SELECT CAST(n_nationkey AS BIGINT) AS poly_id, n_name AS class_name, CAST(n_nationkey * 5 AS DOUBLE) AS xmin,
       CAST(n_nationkey * 5 + 6 AS DOUBLE) AS xmax, 0.0 AS ymin, CAST(20 + n_nationkey * 3 AS DOUBLE) AS ymax
FROM nation""",
    "profiles": """
SELECT l_orderkey AS profile_id, CAST((l_linenumber - 1) * 15 AS DOUBLE) AS upper_limit,
       CAST(l_linenumber * 15 AS DOUBLE) AS lower_limit, MIN(l_quantity) AS value
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "layers": """
SELECT c_custkey AS x, c_nationkey AS y, CAST(c_custkey % 4 AS STRING) AS m1, CAST(c_nationkey % 4 AS STRING) AS m2,
       CASE WHEN c_custkey % 9 <> 0 THEN CAST((c_custkey + c_nationkey) % 4 AS STRING) END AS m3
FROM customer""",
    "id_index": """
SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN CONCAT(' CTB', LPAD(CAST(p_partkey % 10000 AS STRING), 4, '0'), ' ')
       ELSE p_brand END AS dataset_id
FROM part""",
    "groups": """
SELECT CAST(o_orderkey AS BIGINT) AS row_id, o_custkey % 60 AS group_id,
       CASE WHEN (o_custkey % 60) % 3 = 0 THEN 'a' WHEN (o_custkey % 60) % 3 = 1 THEN 'b' ELSE 'c' END AS class,
       o_totalprice AS target
FROM orders""",
    "train_new": """
SELECT vec_id, label AS fold, CASE WHEN vec_id % 5 = 0 THEN 'new' ELSE 'train' END AS part, embedding FROM embeddings""",
}


#: Keys by which derived inputs are grouped, and rows of a group of them that one task takes.
GROUPED, TASK_ROWS = {"cells": ("lineitem", ["l_partkey", "l_suppkey"]), "profiles": ("lineitem", ["l_orderkey", "l_linenumber"])}, 500_000


def dealt(df: DataFrame, keys: list[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """Rows exchanged by their keys over as many tasks as there are rows for, so that a grouping by the keys has bounded
    tasks at any size; where the session's own number of partitions is enough, as they are."""
    n = -(-df.count() // task_rows)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input, from the same SQL as the oracles use."""
    text = DERIVED[name]
    for t in TABLES:
        if f"FROM {t}" in text:
            given, (grouped, keys) = table(spark, sf_dir, t), GROUPED.get(name, (None, []))
            (dealt(given, keys) if t == grouped else given).createOrReplaceTempView(t)
    return spark.sql(text)


def with_inputs(names: str, body: str) -> str:
    """DuckDB SQL: derived inputs as common table expressions before the rest (which may begin with more of them)."""
    ctes = ", ".join(f"{n} AS ({DERIVED[n]})" for n in names.split())
    body = body.strip()
    return f"WITH {ctes}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"
