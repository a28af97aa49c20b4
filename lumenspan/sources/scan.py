"""Files as tables: scan, contents, logs, dumps (SRC1, SRC2, SRC13-SRC15, SNK14)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as X
from .tree import BYTES, DELETED, FileTree, contents, put

EXTRACTED = T.StructType(
    [T.StructField("success", T.BooleanType())] + [T.StructField(c, T.StringType()) for c in ("text", "source_type", "error_code", "error_detail")]
)


def scan_roots(asked: list[str] | None = None, settings: dict | None = None, home: str | None = None) -> list[str]:
    """SRC2: the folders to scan: those asked for, else those of the settings (scan_roots), else the user's home folder."""
    import os

    return list(asked or ()) or list((settings or {}).get("scan_roots") or ()) or [home or os.path.expanduser("~")]


def tree(spark: SparkSession, roots: list[str], content: bool = False, depth: int = 2) -> DataFrame:
    """SRC1: every file and folder below ``roots`` that is worth a look; skipped folders aren't entered."""
    spark.dataSource.register(FileTree)
    found = spark.read.format("file_tree").option("path", "\n".join(roots)).option("depth", depth).load()
    return with_contents(found) if content else found


def changes(spark: SparkSession, root: str, manifests: str, content: bool = True, depth: int = 2) -> DataFrame:
    """STR2: a stream of the files below ``root`` that were added, changed or deleted since the cycle before; ``manifests`` is a folder that driver and executors share."""
    spark.dataSource.register(FileTree)
    found = spark.readStream.format("file_tree").option("path", root).option("manifests", manifests).option("depth", depth).load()
    return with_contents(found) if content else found


def with_contents(found: DataFrame) -> DataFrame:
    """``found`` with the files' contents, null for what can't be read. One task lists a folder, whatever it holds; its files are dealt over all tasks before any is read."""
    spark = found.sparkSession
    schema, at = found.schema, found.schema.fieldNames().index
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            held, size, low = [], 0, 0
            paths, is_folder, change = (batch.column(at(c)).to_pylist() for c in ("path", "is_folder", "change"))
            for i, (path, folder, what) in enumerate(zip(paths, is_folder, change, strict=True)):
                data = None if folder or what == DELETED else contents(path)
                held.append(data)
                size += len(data or b"")
                if size >= BYTES or i + 1 == len(paths):
                    part = batch.slice(low, len(held))
                    yield pa.RecordBatch.from_arrays([*[part.column(k).cast(f.type) for k, f in enumerate(arrow) if f.name != "content"], pa.array(held, arrow.field("content").type)], schema=arrow)
                    held, size, low = [], 0, i + 1

    # A stated number of partitions, as the paths are too short to tell how much is read.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return found.repartition(parts, "path").mapInArrow(run, schema)


def describe(found: DataFrame, *more: str) -> DataFrame:
    """The file table's columns from rows of ``tree`` or ``changes``."""
    name = X.filename(F.col("path"))
    return found.where("not is_folder").select(X.file_id(F.col("path")).alias("file_id"), "path", name.alias("filename"), X.extension(name).alias("extension"), X.dirname(F.col("path")).alias("folder_path"), "modified_at", "size_bytes", *more)


def scan(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """SRC1: files below ``root`` that are worth a look; contents are only read if asked for."""
    return describe(tree(spark, [root], content), *(["content"] if content else []))


def folders(files: DataFrame) -> DataFrame:
    """SRC1: the directory rows: every folder that holds a file."""
    return files.select("folder_path").distinct().select(X.file_id(F.col("folder_path")).alias("file_id"), F.col("folder_path").alias("path"), X.filename(F.col("folder_path")).alias("filename"))


def with_text(files: DataFrame, whole: bool = False) -> DataFrame:
    """SRC13: ``files`` (extension, content, ...) without content, with success, text, source_type, error_code, error_detail; ``whole`` as in ``extract``."""
    from .extract import extract

    kept = [f for f in files.schema.fields if f.name != "content"]
    schema = T.StructType([*kept, *EXTRACTED.fields])
    arrow = to_arrow_schema(schema)
    at = [f.name for f in kept].index("extension")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # a file at a time: contents may be large
                row = batch.slice(i, 1)
                got = extract(row.column(len(kept))[0].as_py(), row.column(at)[0].as_py(), whole)
                same = [row.column(k).cast(arrow.field(k).type) for k in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*same, *[pa.array([got[f.name]], arrow.field(f.name).type) for f in EXTRACTED]], schema=arrow)

    return files.select(*[f.name for f in kept], "content").mapInArrow(run, schema)


def write_files(files: DataFrame) -> None:
    """Each row (path, content) as a file of a file system that all executors see; null content removes the file. A task that is run again writes the same."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                put(batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
            yield batch.select([0])

    files.select("path", F.col("content").cast("binary")).mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """SRC15: lines of a diagnostic log, for ``operators.logs.parse_log``."""
    return spark.read.text(path)


def dump(extracted: DataFrame, out: str, only: list[str] | None = None, max_size: int | None = None, include_failed: bool = False) -> DataFrame:
    """SNK14, FN35, AGG22: writes (path, text) as JSON lines below ``out`` and returns the summary: files by extension and result."""
    rows = extracted
    if only:
        rows = rows.where(F.lower("extension").isin([e.lower() if e.startswith(".") else f".{e.lower()}" for e in only]))
    if max_size is not None:
        rows = rows.where(F.col("size_bytes") <= max_size)
    kept = rows if include_failed else rows.where("success")
    kept.select("path", "extension", "text", "error_code").write.mode("overwrite").json(f"{out}/texts")
    summary = rows.groupBy("extension", F.coalesce("error_code", F.lit("SUCCESS")).alias("result")).agg(F.count("*").alias("n"))
    summary.write.mode("overwrite").json(f"{out}/summary")
    return summary


def parse_size(text: str) -> int:
    """FN35: 10MB and the like in bytes."""
    text = text.strip().upper()
    for unit, factor in (("KB", 1 << 10), ("MB", 1 << 20), ("GB", 1 << 30), ("B", 1)):
        if text.endswith(unit):
            return int(float(text.removesuffix(unit)) * factor)
    return int(text)
