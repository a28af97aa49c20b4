"""Upserts and deletes as new snapshots of immutable tables (SNK1-SNK12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """SNK1, SNK2, SNK8: ``table`` with the rows of ``changes`` put in by key; of changes with one key the last by ``order`` wins.

    Columns that ``changes`` lacks keep their old values.
    """
    if order:
        last = Window.partitionBy(*keys).orderBy(F.desc(order))
        changes = changes.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    fresh = changes.withColumn("_new", F.lit(True)).alias("n")
    old = table.alias("o")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    met = old.join(fresh, on, "full_outer")
    given = set(changes.columns)
    cols = [(F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in given else F.col(f"o.{c}")).alias(c) for c in table.columns]
    return met.select(*cols)


def update_by_path(files: DataFrame, changes: DataFrame) -> DataFrame:
    """SNK7: ``files`` with sizes and times from ``changes`` (path, size_bytes, modified_at), met by path, case aside."""
    new = changes.select(F.lower("path").alias("_path"), F.col("size_bytes").alias("_size"), F.col("modified_at").alias("_time")).dropDuplicates(["_path"])
    met = files.join(new, F.lower("path") == F.col("_path"), "left")
    return met.select(*[F.coalesce("_size", c).alias(c) if c == "size_bytes" else F.coalesce("_time", c).alias(c) if c == "modified_at" else F.col(c) for c in files.columns])


def without(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """SNK4, SNK5, SNK9, JN8: ``table`` without the rows whose key is in ``gone``."""
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def delete_files(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """SNK4: every table of the catalogue without the files at ``paths`` (path); chunks, vectors and postings go with them."""
    gone = tables["files"].join(paths.select(F.lower("path").alias("_p")).distinct(), F.lower("path") == F.col("_p"), "left_semi").select("file_id")
    return {name: without(t, gone, ["file_id"]) for name, t in tables.items()}


def replace_chunks(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """SNK3, Q7: the fresh files' chunks replace all their old ones."""
    return without(chunks, fresh, ["file_id"]).unionByName(fresh)


def stale_embeddings(embeddings: DataFrame, fresh: DataFrame) -> DataFrame:
    """SNK3: vectors without those of re-chunked files."""
    return without(embeddings, fresh, ["file_id"])


def set_status(files: DataFrame, results: DataFrame) -> DataFrame:
    """SNK6: extract_status and error_code from ``results`` (file_id, extract_status, error_code) where they have the file."""
    new = results.select("file_id", F.col("extract_status").alias("_status"), F.col("error_code").alias("_code"))
    met = files.join(new, "file_id", "left")
    code: Column = F.when(F.col("_status").isNotNull(), F.col("_code")).otherwise(F.col("error_code"))
    return met.select(*[F.coalesce("_status", "extract_status").alias(c) if c == "extract_status" else code.alias(c) if c == "error_code" else F.col(c) for c in files.columns])


def publish(df: DataFrame, path: str, version: str, partition_by: list[str] | None = None) -> None:
    """Writes a new snapshot beside the old one; readers take the version they are told, so a lost job leaves the old one whole."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/version={version}")
