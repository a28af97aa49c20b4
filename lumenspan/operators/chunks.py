"""Chunking of texts and assembly of contents (FN20, FN34, TOP13)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SIZE, MOST = 1000, 500
#: Characters of chunks after which a batch of them is handed on.
HELD = 1 << 22
GAP = re.compile(r"\r\n\r\n|\n\n")


def _pieces(text: str | None, size: int) -> Iterator[tuple[int, str]]:
    held: list[str] = []
    start = at = long = 0
    for part in GAP.split(text) if text else ():
        if held and long + 2 + len(part) > size:
            yield start, "\n\n".join(held)
            held = []
        if len(part) > size:
            yield from ((at + i, part[i : i + size]) for i in range(0, len(part), size))
        elif held or part:
            if not held:
                start, long = at, -2
            held.append(part)
            long += 2 + len(part)
        at += len(part) + 2
    if held:
        yield start, "\n\n".join(held)


def chunk_text(text: str | None, size: int = SIZE, most: int | None = MOST) -> list[tuple[int, str]]:
    """(start, text) of a text's chunks: whole paragraphs up to ``size`` characters, longer paragraphs cut; the first ``most`` of them, None: all.

    A paragraph's separator counts two characters, so starts drift behind four-character ones.
    """
    return list(islice(_pieces(text, size), most))


def chunk_files(files: DataFrame, text_col: str = "text", size: int = SIZE, most: int | None = MOST) -> DataFrame:
    """FN20: the other columns of ``files`` with chunk_index, text, start_offset, end_offset; null and empty texts give no rows. ``most`` as in ``chunk_text``."""
    kept = [f for f in files.schema.fields if f.name != text_col]
    schema = T.StructType([*kept, T.StructField("chunk_index", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("start_offset", T.LongType()), T.StructField("end_offset", T.LongType())])
    arrow = to_arrow_schema(schema)

    def made(batch, found):
        rows, numbers, texts, starts = zip(*found, strict=True)
        pick = pa.array(rows, pa.int64())
        same = [batch.column(i).take(pick).cast(arrow.field(i).type) for i in range(len(kept))]
        ends = [s + len(t) for s, t in zip(starts, texts, strict=True)]
        return pa.RecordBatch.from_arrays([*same, pa.array(numbers, pa.int32()), pa.array(texts, arrow.field("text").type), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], schema=arrow)

    def run(batches):
        for batch in batches:
            found, held = [], 0
            for i, text in enumerate(batch.column(batch.num_columns - 1)):  # a text at a time: it may be long
                for n, (start, piece) in enumerate(islice(_pieces(text.as_py(), size), most)):
                    found.append((i, n, piece, start))
                    held += len(piece)
                    if held >= HELD:
                        yield made(batch, found)
                        found, held = [], 0
            if found:
                yield made(batch, found)

    return files.select(*[f.name for f in kept], text_col).mapInArrow(run, schema)


def file_content(chunks: DataFrame, cap: int = 1_048_576) -> DataFrame:
    """FN34: (file_id, content, n_chunks, truncated): a file's chunks in order, joined by blank lines, until ``cap`` characters of them are passed.

    The chunk that passes the cap is cut there; separators aren't counted (Q23).
    """
    before = Window.partitionBy("file_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    held = chunks.select("file_id", "chunk_index", "text").withColumn("before", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)))
    cut = held.withColumn("over", F.col("before") + F.length("text") > cap).withColumn("text", F.expr(f"substring(text, 1, cast(greatest(0, {cap} - before) as int))"))
    parts = F.sort_array(F.collect_list(F.when(F.length("text") > 0, F.struct("chunk_index", "text"))))
    return cut.groupBy("file_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("content"), F.count("*").alias("n_chunks"), F.bool_or("over").alias("truncated"))
