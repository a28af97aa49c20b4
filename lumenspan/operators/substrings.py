"""Stored trigrams of names and paths, so a search for a part of a name reads candidates only (FLT9, FLT10, FTS8).

Names and paths, in lower case and with two marks behind, are cut into all runs of three
letters. Postings (gram, file_id) lie sorted by gram, with a table of how many files each gram
has. A word's rarest grams tell its candidates, and the words are looked for in these. A
word of one or two letters is the beginning of some gram wherever it occurs, so its
candidates are a range of grams: nothing is too short to be found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store

#: Not part of any name: fills the last grams up.
END = "\0"
#: Grams of a word that candidates must have.
RAREST = 3
FILE_ROWS = 4_000_000


def _grams(text: Column) -> Column:
    low = F.concat(F.lower(text), F.lit(END * 2))
    cut = F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))
    return F.when(F.length(low) > 2, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def build(files: DataFrame, path: str) -> None:
    """Writes the postings of ``files`` (file_id, filename, path) and the number of files of each gram below ``path``."""
    spark = files.sparkSession
    texts = [F.coalesce(F.col(c), F.lit("")) for c in ("filename", "path")]
    cut = files.select("file_id", F.explode(F.array_distinct(F.concat(*map(_grams, texts)))).alias("gram"))
    n = files.count() * 64  # about; only the number of files depends on it
    cut.repartitionByRange(max(1, n // FILE_ROWS), "gram", "file_id").sortWithinPartitions("gram", "file_id").write.mode("overwrite").parquet(f"{path}/postings")
    counts = spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count("*").alias("n"))
    counts.repartitionByRange(max(1, n // FILE_ROWS // 64), "gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/counts")


def exists(spark: SparkSession, path: str) -> bool:
    return store.exists(spark, f"{path}/counts/_SUCCESS")


class Substrings:
    """Stored trigrams that are there."""

    def __init__(self, spark: SparkSession, path: str):
        self.postings, self.counts = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/counts")

    def rarest(self, word: str) -> list[str] | None:
        """The grams of a word that the fewest files have; None if no file has one of them."""
        grams = sorted({word[i : i + 3] for i in range(len(word) - 2)})
        found = self.counts.where(F.col("gram").isin(grams)).orderBy("n", "gram").collect()  # as many rows as the word has grams
        return [r["gram"] for r in found[:RAREST]] if len(found) == len(grams) else None

    def candidates(self, word: str) -> DataFrame:
        """(file_id) of the files that may hold a word in name or path."""
        word, ids = word.lower(), self.postings.select("gram", "file_id")
        if len(word) < 3:
            return ids.where(F.col("gram").startswith(word)).select("file_id").distinct()
        grams = self.rarest(word)
        if grams is None:
            return ids.where("false").select("file_id")
        return reduce(lambda a, b: a.join(b, "file_id", "left_semi"), [ids.where(F.col("gram") == g).select("file_id") for g in grams])

    def search(self, files: DataFrame, words: list[str], every: bool = True, limit: int = 20) -> DataFrame:
        """FLT9 (``every`` word) or FLT10 (any): files that hold words in name or path, case aside, the newest first. Words stand for themselves."""
        words = [w for w in words if w]
        if not words:
            return files.limit(0)
        found = [self.candidates(w) for w in words]
        ids = reduce(lambda a, b: a.join(b, "file_id", "left_semi"), found) if every else reduce(DataFrame.unionByName, found).distinct()
        holds = [F.contains(F.lower("filename"), F.lit(w.lower())) | F.contains(F.lower("path"), F.lit(w.lower())) for w in words]
        near = files.join(ids, "file_id", "left_semi")
        return near.where(reduce((lambda a, b: a & b) if every else (lambda a, b: a | b), holds)).orderBy(F.desc("modified_at"), "path").limit(limit)
