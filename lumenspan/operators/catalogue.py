"""Filters, listings and counts over files and chunks (FLT*, AGG1-4, AGG23, TOP6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import words


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def scannable(size: Column, system: Column, link: Column) -> Column:
    """FLT1: no system file or link, of 10 bytes to 500 MB."""
    return ~system & ~link & size.between(10, 500_000_000)


def generated_folder(name: Column) -> Column:
    """FLT3: a GUID, or 16 or more hex digits and dashes."""
    return name.rlike(r"^.{8}-.{4}-.{4}-.{4}-.{12}$") | name.rlike(r"^[0-9a-fA-F-]{16,}$")


def skipped_folder(name: Column) -> Column:
    """FLT2"""
    low = F.lower(name)
    return name.startswith(".") | low.isin([w.lower() for w in words.EXCLUDED_FOLDERS]) | generated_folder(name) | any_of(low.endswith(s) for s in words.PACKAGE_SUFFIXES)


def in_skipped_folder(folder: Column) -> Column:
    """FLT2 for a path: any of its folders is skipped."""
    return F.exists(F.split(folder, r"[/\\]"), lambda part: (part != "") & skipped_folder(part))


def cloud_placeholder(attributes: Column) -> Column:
    """FLT4: offline, or recalled on access or open."""
    return attributes.bitwiseAND(F.lit(0x1000 | 0x400000 | 0x200000)) != 0


def searchable(ext: Column) -> Column:
    """SRC14"""
    return X.normal_extension(ext).isin(words.CONTENT_EXTENSIONS)


def pending(files: DataFrame, limit: int = 500) -> DataFrame:
    """FLT6: the next files to extract, by path."""
    return files.where((F.col("extract_status") == "PENDING") & searchable(F.col("extension"))).orderBy("path").limit(limit)


def under_folder(folder: str) -> Column:
    """FLT7: the path starts with ``folder``, ASCII case aside; /a/b also covers /a/bc."""
    return F.lower(F.col("path")).startswith(folder.lower())


def listing(files: DataFrame, folder: str | None = None, ext: str | None = None, limit: int = 50) -> DataFrame:
    """API3, FLT8, FN33, TOP6: newest files below a folder with an extension; 1 to 200 of them."""
    found = files.where(under_folder(folder)) if folder else files
    if ext:
        found = found.where(X.normal_extension(F.col("extension")) == X.normal_extension(F.lit(ext)))
    return found.orderBy(F.desc("modified_at"), "path").limit(max(1, min(200, limit)))


def _like(token: str) -> Column:
    return F.col("filename").ilike(f"%{token}%") | F.col("path").ilike(f"%{token}%")


def filename_search(files: DataFrame, tokens: list[str], limit: int = 20) -> DataFrame:
    """FLT9: every token in name or path."""
    return files.where(all_of(map(_like, tokens))).orderBy(F.desc("modified_at"), "path").limit(limit)


def quick_search(files: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """FLT10, API6: any word of the query in name or path, newest first."""
    tokens = [t for t in query.replace(",", " ").replace(".", " ").split(" ") if t]
    if not tokens:
        return files.limit(0)
    return files.where(any_of(map(_like, tokens))).orderBy(F.desc("modified_at"), "path").limit(limit)


def of_type(group: str) -> Column:
    """FLT12"""
    return F.lower(F.col("extension")).isin(words.TYPE_GROUPS.get(group, []))


def since(choice: str, as_of: Column) -> Column:
    """FLT13: modified in the last 30 or 90 days (``30d``, ``90d``) or in the year of ``as_of`` (``year``); unknown dates drop out."""
    when = F.col("modified_at")
    return {"30d": when >= as_of - F.expr("interval 30 days"), "90d": when >= as_of - F.expr("interval 90 days"), "year": F.year(when) == F.year(as_of)}[choice]


def changed(scanned: DataFrame, known: DataFrame) -> DataFrame:
    """FLT5, JN13, STR2: scanned files whose path (case aside) and time aren't known yet, or that were cloud files."""
    same = known.where(~F.coalesce(F.col("error_code") == "CLOUD_FILE", F.lit(False))).select(F.lower("path").alias("_path"), F.col("modified_at").alias("_when"))
    return scanned.join(same, (F.lower(scanned["path"]) == F.col("_path")) & (scanned["modified_at"] == F.col("_when")), "left_anti")


def totals(files: DataFrame) -> DataFrame:
    """AGG1, AGG2: files, folders, files to search in, pending and indexed ones."""
    ready = searchable(F.col("extension"))
    return files.agg(
        F.count("*").alias("files"),
        F.countDistinct("folder_path").alias("folders"),
        F.count_if(ready & (F.col("extract_status") != "SKIPPED")).alias("searchable"),
        F.count_if(ready & (F.col("extract_status") == "PENDING")).alias("pending"),
        F.count_if(ready & (F.col("extract_status") == "SUCCESS")).alias("indexed"),
    )


def skip_counts(files: DataFrame) -> DataFrame:
    """AGG3, Q5: skipped and failed files by cause, told by error code."""
    code = F.coalesce("error_code", F.lit(""))
    return files.agg(
        F.count_if(F.col("extract_status") == "SKIPPED").alias("cloud"),
        F.count_if(code == "TOO_LARGE").alias("too_large"),
        F.count_if(code == "ENCRYPTED").alias("encrypted"),
        F.count_if((F.col("extract_status") == "ERROR") & ~code.isin("TOO_LARGE", "ENCRYPTED")).alias("parse_error"),
    )


def percent(part: Column, whole: Column) -> Column:
    """AGG23: at most 100, 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.least(F.lit(100.0), part / whole * 100))


def missing_embeddings(chunks: DataFrame, embedded: DataFrame) -> DataFrame:
    """JN4, FLT17, Q20: chunks with text and without vector."""
    return chunks.where(F.coalesce(F.length("text"), F.lit(0)) > 0).join(embedded, ["file_id", "chunk_index"], "left_anti")


def by_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """JN6: rows whose (file_id, chunk_index) is among ``keys``."""
    return rows.join(keys, ["file_id", "chunk_index"], "left_semi")


def duplicates(chunks: DataFrame) -> DataFrame:
    """Texts that occur in more than one chunk: content_hash, copies, least chunk id."""
    return chunks.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("chunk_id").alias("first_chunk")).where("copies > 1")
