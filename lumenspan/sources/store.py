"""Where stored tables lie, and the small file operations on them."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import SparkSession


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path in its terms."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = filesystem(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = filesystem(spark, path)
    fs.delete(where, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, where = filesystem(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def materialize(df, name: str):
    """``df`` written to the shared folder and read back: computed once, and its lineage ends there. The files go with the application."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumenspan/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, where = filesystem(spark, path)
    fs.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path."""
    fs, where = filesystem(spark, path)
    return fs.getContentSummary(where).getLength() if fs.exists(where) else 0


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its place and moved there, so that readers see all of it or none."""
    fs, where = filesystem(spark, path)
    part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    fs.delete(where, False)
    fs.rename(part, where)


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = filesystem(spark, path)
    held = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8")
    finally:
        held.close()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, the folder that driver and executors share.

    Only where it is unset and everything runs on one machine a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        found = f"file://{tempfile.mkdtemp(prefix='lumenspan-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stamp(spark: SparkSession, path: str) -> str:
    """Short text that changes when a file or folder of files does: from names, sizes and times."""
    fs, where = filesystem(spark, path)
    found = sorted(f"{s.getPath().getName()} {s.getLen()} {s.getModificationTime()}" for s in fs.listStatus(where))
    return hashlib.sha256("\n".join([path, *found]).encode()).hexdigest()[:16]
