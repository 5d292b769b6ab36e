"""Link extraction, dataset ids, file manifests, object paths and ledgers of finished work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns that may hold dataset ids, in order of preference, and tables that a dataset has.
ID_COLUMNS = ["dataset_id", "data_set", "data.set", "dataset", "id", "codigo", "identificacao", "data_id"]


TABLES = ["dataset", "observation", "layer", "metadata", "version"]


def require_links(links: DataFrame, step: str) -> DataFrame:
    """The links of a step of a walk, or an error if there are none."""
    if links.isEmpty():
        raise ValueError(f"no links at step {step}")
    return links


def require_tables(names: Sequence[str], known: Sequence[str] = TABLES) -> list[str]:
    """Distinct table names in lower case, or an error that names the unknown ones."""
    wanted = list(dict.fromkeys(n.strip().lower() for n in names))
    unknown = [n for n in wanted if n not in known]
    if unknown or not wanted:
        raise ValueError(f"unknown tables: {', '.join(unknown) or 'none given'}")
    return wanted


def catalog_links(pages: DataFrame, patterns: Sequence[str], strict: bool = False) -> DataFrame:
    """Links of pages that match all patterns, with the full path they stand for; if strict, a pattern that leaves
    none is an error."""
    links = pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))
    for p in patterns:
        links = links.where(F.col("href").rlike(p))
        if strict:
            require_links(links, p)
    return links.withColumn("path", F.concat(F.regexp_replace("url", "/+$", ""), F.lit("/"), F.regexp_replace("href", "^/+", "")))


def detect_dataset_ids(index: DataFrame) -> DataFrame:
    """Distinct ids of three letters and four digits, from the first id column that has any, else from all columns."""
    named = [c for c in ID_COLUMNS if c in index.columns]
    valid = F.lower(F.trim("value")).rlike("^[a-z]{3}[0-9]{4}$")
    if named:
        own = index.select(F.col(f"`{named[0]}`").cast("string").alias("value")).where(valid)
        own = own.select(F.lower(F.trim("value")).alias("dataset_id")).distinct()
        if not own.isEmpty():
            return own
    cells = F.explode(F.array(*[F.col(f"`{c}`").cast("string") for c in index.columns])).alias("value")
    return index.select(cells).where(valid).select(F.lower(F.trim("value")).alias("dataset_id")).distinct()


def invalid_ids(requested: DataFrame, column: str) -> DataFrame:
    """Distinct requested ids that are not of the expected form."""
    return requested.select(F.col(column).alias("requested")).distinct().where(~F.trim("requested").rlike("^[A-Za-z]{3}[0-9]{4}$"))


def manifest(ids: DataFrame, tables: Sequence[str], existing: DataFrame) -> DataFrame:
    """Expected files of every id and table name with their status; existing lists file paths and sizes."""
    wanted = ids.withColumn("table_name", F.explode(F.array(*[F.lit(t) for t in tables])))
    wanted = wanted.withColumn("file_path", F.concat_ws("/", "dataset_id", F.concat_ws("-", "dataset_id", F.concat("table_name", F.lit(".txt")))))
    out = wanted.join(existing.select("file_path", "n_bytes"), "file_path", "left")
    status = F.when(F.col("n_bytes").isNull(), "missing").when(F.col("n_bytes") == 0, "empty").otherwise("already_exists")
    return out.withColumn("checked_after", F.col("n_bytes").isNotNull()).withColumn("status", status)


def manifest_summary(files: DataFrame) -> DataFrame:
    """Files by status and presence."""
    return files.groupBy("status", "checked_after").agg(F.count(F.lit(1)).alias("n_files"))


def object_paths(files: DataFrame, root: str, bucket: str, pattern: str) -> DataFrame:
    """Object addresses of local paths below a root that match a pattern; others are rejected with the reason."""
    prefix = root.rstrip("/") + "/"
    inside, wanted = F.col("file_path").startswith(prefix), F.col("file_path").rlike(pattern)
    relative = F.substr("file_path", F.lit(len(prefix) + 1))
    return files.select(
        "file_path",
        F.when(inside & wanted, F.concat(F.lit(bucket.rstrip("/") + "/"), relative)).alias("object_uri"),
        F.when(~inside, "outside_root").when(~wanted, "pattern").alias("rejected"),
    )


def local_paths(objects: DataFrame, bucket: str, root: str) -> DataFrame:
    """Adds the local path below root of each object address below a bucket (or a folder in it); null for others."""
    prefix = bucket.rstrip("/") + "/"
    path = F.concat(F.lit(root.rstrip("/") + "/"), F.substr("object_uri", F.lit(len(prefix) + 1)))
    return objects.withColumn("local_path", F.when(F.col("object_uri").startswith(prefix), path))


def require_no_conflicts(found: DataFrame) -> None:
    """An error that tells the first conflicts of a ledger, if there are any."""
    some = found.limit(5).collect()
    if some:
        raise ValueError(f"settings differ from the ledger: {[r.asDict() for r in some]}")


def pending(requested: DataFrame, finished: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requested work that no ledger row finishes."""
    return requested.join(finished.select(*keys).distinct(), list(keys), "left_anti")


def conflicts(ledger: DataFrame, settings: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Ledger rows whose settings differ from those asked for now, field by field."""
    now = settings.select(*keys, *[F.col(f).alias(f"now_{f}") for f in fields])
    both = ledger.join(now, list(keys))
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("was"), F.col(f"now_{f}").cast("string").alias("now")) for f in fields])
    return both.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*").where("not (was <=> now)")
