"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one Arrow batch that are turned into Python objects at a time.
SLICE = 128


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and everything runs on one machine (tests) a temporary folder is
    made and set; a cluster without that setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lumenspan-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    This cuts the lineage and, unlike ``checkpoint()``, computes ``df`` once. The
    files go when the application ends, or earlier through ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumenspan/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    fs, where = _filesystem(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._lumenspan_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes the files of a frame that ``materialize`` returned and no plan needs any more."""
    fs, where = _filesystem(df.sparkSession, df._lumenspan_path)
    fs.delete(where, True)


#: ``hot_join`` deals keys with more than one in so many rows over several tasks.
HOT = 1024


def hot_join(left: DataFrame, right: DataFrame, on: Sequence[str], total: int, salt, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row a key and in ``n`` how many of ``left``'s ``total`` rows have that key.

    A key with more than a HOT-th of all rows gets as many copies of its row, and
    ``left``'s rows are dealt among them by ``salt`` (a long column). Only those keys,
    fewer than HOT, are broadcast. The result has no column ``n``.
    """
    many = F.col("n") * HOT > F.lit(total)
    hot = F.broadcast(right.where(many).select(*on, F.ceil(F.col("n") * HOT / F.lit(max(1, total))).cast("int").alias("parts_")))
    dealt = left.join(hot, list(on), "left").withColumn("part_", F.pmod(salt, F.coalesce("parts_", F.lit(1))).cast("int")).drop("parts_")
    parts = F.when(many, F.ceil(F.col("n") * HOT / F.lit(max(1, total)))).otherwise(1).cast("int")
    copied = right.withColumn("part_", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    return dealt.join(copied, [*on, "part_"], how).drop("part_")


def map_rows(df: DataFrame, columns: Sequence[str], make: Callable[[], Callable[..., dict]], schema: T.StructType, rows: int = SLICE) -> DataFrame:
    """Runs a function over slices of the given columns, in Arrow batches.

    ``make`` is called once a partition and returns a function from one list per
    column to a dict of output lists. Only the named columns reach Python.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                if step is None:
                    step = make()
                part = batch.slice(at, rows)
                made = step(*[part.column(i).to_pylist() for i in range(part.num_columns)])
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.select(*[F.col(c) for c in columns]).mapInArrow(run, schema)


def learn_rows(ids: str = "doc_id"):
    """True for rows that models may learn from: crc32 of the id as text, mod 5, is not 0."""
    return F.crc32(F.col(ids).cast("string")) % 5 != 0


def sample_share(wanted: int, there: int) -> float:
    """Share of ``there`` rows that gives ``wanted`` rows or a few more."""
    return 1.0 if there <= wanted else min(1.0, (wanted + 4 * wanted**0.5) / there)


def by_hash(share, ids: str = "doc_id", seed: int = 7):
    """A row filter that keeps about ``share`` of the rows, the same ones whatever the partitioning."""
    return (F.pmod(F.xxhash64(F.col(ids), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))) < share
