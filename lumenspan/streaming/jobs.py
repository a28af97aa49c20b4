"""Structured Streaming jobs: ingest of changed files, running click counts, windows (STR1-STR3, STR5-STR7); ``processors`` has those that remember."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.chunks import chunk_files
from ..operators.feedback import click_key
from ..sources import store
from ..sources.scan import changes, describe, with_contents, with_text
from ..sources.tree import DELETED


def ingest(spark: SparkSession, root: str, out: str, checkpoint: str, once: bool = True, every: str = "10 minutes", delete: bool = False, depth: int = 2):
    """STR1-STR3: files below ``root`` that are new or changed are read and chunked; ``tables`` gives the result.

    Each cycle looks at the whole tree and takes up what differs from the cycle before:
    a changed file's row and chunks replace the old ones, with ``delete`` those of a deleted
    file go. ``checkpoint`` holds the manifests too; it has one query at a time, so cycles
    never overlap. With ``once`` one cycle is run, otherwise one ``every`` so long. Plain
    texts are read and chunked whole, however long they are.
    """
    sink = upsert_sink(f"{out}/files", ["file_id"])

    def write(batch: DataFrame, number: int) -> None:
        present = with_contents(batch.where(F.col("change") != DELETED))
        # Extracted once for both tables. A batch that is run again after a failure replaces what it wrote before.
        read = with_text(describe(present, "content"), True).withColumn("extract_status", F.when(F.col("success"), "SUCCESS").otherwise("ERROR")).persist()
        files = read.drop("text", "success").withColumn("gone", F.lit(False))
        if delete:
            files = files.unionByName(describe(batch.where(F.col("change") == DELETED)).withColumn("gone", F.lit(True)), allowMissingColumns=True)
        chunks = chunk_files(read.where("success").select("file_id", "filename", "folder_path", "text"), most=None)
        chunks.withColumn("chunk_id", X.chunk_id(F.col("file_id"), F.col("chunk_index"))).withColumn("version", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        sink(files.withColumn("version", F.lit(number).cast("long")), number)
        read.unpersist()
        if number and number % COMPACT == 0:
            settle(f"{out}/chunks", number, _current(spark, out)[1])

    found = changes(spark, root, f"{checkpoint}/manifests", False, depth)
    writer = found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def _current(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    files = latest(spark, f"{out}/files", ["file_id"]).where("not gone").drop("gone")
    chunks = _versions(spark, f"{out}/chunks").drop("batch")
    return files, chunks.join(files.select("file_id", "version"), ["file_id", "version"], "left_semi")


def tables(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """Files and chunks of an ingest as they are now: each file's newest version, and that version's chunks."""
    files, chunks = _current(spark, out)
    return files.drop("version"), chunks.drop("version")


def click_counts(clicks: DataFrame) -> DataFrame:
    """STR5: running clicks, last click and least position per query and path; for update mode."""
    return clicks.groupBy(click_key(F.col("query")).alias("query"), X.click_path(F.col("path")).alias("path_key")).agg(F.count("*").alias("click_count"), F.max("ts").alias("last_clicked"), F.min("position").alias("position"))


#: Batches after which what is still wanted becomes one snapshot.
COMPACT = 20


def upsert_sink(path: str, keys: list[str], compact: int = COMPACT) -> Callable[[DataFrame, int], None]:
    """SNK10: for foreachBatch: each batch of updated keys becomes a folder of its own; ``latest`` reads the newest row of each key.

    Every ``compact`` batches the newest rows of all keys become one snapshot and the
    folders behind it go, so readers meet a bounded number of them.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if number and number % compact == 0:
            settle(path, number, latest(batch.sparkSession, path, keys))

    return write


def settle(path: str, number: int, rows: DataFrame) -> None:
    """Writes ``rows``, all that is still wanted of the batches up to ``number``, as one snapshot; the folders behind it go."""
    spark = rows.sparkSession
    old = store.names(spark, path)
    rows.write.mode("overwrite").parquet(f"{path}/snapshot={number}")
    for name in old:
        if _number(name) <= number and name != f"snapshot={number}":
            store.delete(spark, f"{path}/{name}")


def _number(name: str) -> int:
    head, _, n = name.partition("=")
    return int(n) if head in ("batch", "snapshot") and n.isdigit() else -1


def _versions(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last whole snapshot and the batches since, with their number as ``batch``."""
    names = store.names(spark, path)
    whole = [n for n in names if n.startswith("snapshot=") and store.exists(spark, f"{path}/{n}/_SUCCESS")]
    since = max(map(_number, whole), default=-1)
    kept = [n for n in names if n.startswith("batch=") and (_number(n) > since or not whole)] + ([f"snapshot={since}"] if whole else [])
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{path}/{n}").withColumn("batch", F.lit(_number(n)).cast("long")) for n in kept])


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest version of each key of an upsert sink."""
    rows = _versions(spark, path)
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(*keys, "r.*")


def throttle(events: DataFrame, key: str, phase: str, order: list[str], every: float = 0.5) -> DataFrame:
    """STR7: the progress reports that are passed on: each change of phase, else one when ``every`` seconds have gone since the last.

    ``events`` sorted by ``order`` (a timestamp first) within their key; keys are walked one
    row after the other, so a key of any length takes no memory.
    """
    schema = events.schema
    at = schema.fieldNames().index

    def run(batches):
        now, before, fired = object(), None, None
        for batch in batches:
            keys, phases, times = (batch.column(at(c)).to_pylist() for c in (key, phase, order[0]))
            keep = []
            for k, p, t in zip(keys, phases, times, strict=True):
                shown = k != now or p != before or (t - fired).total_seconds() >= every
                now, before, fired = k, p, t if shown else fired
                keep.append(shown)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return events.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def typing_sessions(keys: DataFrame, gap: str = "250 milliseconds", late: str = "1 minute") -> DataFrame:
    """STR6: what a user typed within pauses shorter than ``gap`` is one search, by its last text."""
    return keys.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.max_by("query", "ts").alias("query"), F.count("*").alias("keystrokes"))


def event_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Extension: events by type in tumbling or sliding windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide or width), "event_type").agg(F.count("*").alias("n"))
