"""Removal of repeated three-line windows, with DataFrame functions only.

Every three consecutive lines of a document are a window, known by 128 bits of hash.
Of windows found twice or more anywhere, the first (least document id, then mark of the
text, then position) stays and the lines that any later one covers are removed. Only hashes are shuffled to
find them; texts move once, to meet the positions to cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a window.
LINES = 3


def _lines(text_col: str):
    return F.split(F.col(text_col), "\n", -1)


def _mark(text_col: str):
    """60 bits that tell texts of one id apart."""
    return F.conv(F.substring(F.md5(F.col(text_col)), 1, 15), 16, 10).cast("long")


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, pos, h, g): one row per window that holds a word; id and mark tell its text, (h, g) its lines."""
    ready = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), _mark(text_col).alias("mark"), _lines(text_col).alias("lines")).where(F.size("lines") >= LINES)
    # Per line: two independent hashes, and whether it holds a word.
    hashed = ready.select("id", "mark", F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"), x.rlike(r"[^\x20\x09-\x0D]").alias("word"))).alias("lines"))

    def window(i):
        own = [F.get("lines", i + k) for k in range(LINES)]
        word = own[0]["word"] | own[1]["word"] | own[2]["word"]
        return F.struct(i.alias("pos"), F.xxhash64(*[o["h"] for o in own]).alias("h"), F.xxhash64(*[o["g"] for o in own]).alias("g"), word.alias("word"))

    found = hashed.select("id", "mark", F.explode(F.transform(F.sequence(F.lit(0), F.size("lines") - LINES), window)).alias("w"))
    return found.where("w.word").select("id", "mark", "w.pos", "w.h", "w.g")


def later_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, starts): for documents with repeats, the sorted positions of windows that came before elsewhere or further up.

    Counting combines before the shuffle, so a window that millions of documents share
    is one row a task; the join that follows splits it (adaptive skew join).
    """
    seen = windows(docs, id_col, text_col)
    first = seen.groupBy("h", "g").agg(F.min(F.struct("id", "mark", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = seen.join(first, ["h", "g"]).where(~F.struct("id", "mark", "pos").eqNullSafe(F.col("first")))
    return later.groupBy("id", "mark").agg(F.sort_array(F.collect_set("pos")).alias("starts"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeats cut from ``text_col``, and two more columns: n_lines, n_removed.

    Null texts stay null (0 lines); texts of fewer than three lines stay as they are.
    Windows without any word never count as repeats. Rows that repeat an id are documents
    of their own where their texts differ; rows equal in id and text count as one document.
    Rows without id come before all others. A text whose lines all go becomes empty. Empty
    tables give no rows. Columns of ``docs`` named n_lines or n_removed are replaced.
    """
    # Columns have names of their own until the end, so none of the caller's is in the way.
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    plain = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)])
    own_id, own_text = f"c{kept.index(id_col)}", f"c{kept.index(text_col)}"
    cuts = later_windows(plain, own_id, own_text).select(F.col("id").alias("cut_id"), F.col("mark").alias("cut_mark"), "starts")
    met = plain.join(cuts, F.col(own_id).eqNullSafe(F.col("cut_id")) & (_mark(own_text) == F.col("cut_mark")), "left")
    lines, cut = _lines(own_text), F.col("starts").isNotNull()
    # Kept lines lie between the end of one cut window and the start of the next.
    stops = F.concat(F.array(F.lit(-LINES)), F.col("starts"), F.array(F.size(lines)))
    met = met.withColumn("lines", F.when(cut, lines)).withColumn("stops", F.when(cut, stops))
    rest = F.flatten(F.transform(F.sequence(F.lit(0), F.size("stops") - 2), lambda i: F.slice(F.col("lines"), F.get("stops", i) + LINES + 1, F.greatest(F.lit(0), F.get("stops", i + 1) - F.get("stops", i) - LINES))))
    met = met.withColumn("rest", F.when(cut, rest))
    n = F.when(F.col(own_text).isNull(), 0).otherwise(F.length(own_text) - F.length(F.replace(F.col(own_text), F.lit("\n"), F.lit(""))) + 1)
    gone = F.when(cut, F.size("lines") - F.size("rest")).otherwise(0)
    text = F.when(cut, F.array_join("rest", "\n")).otherwise(F.col(own_text))
    out = {c: F.col(f"c{i}") for i, c in enumerate(kept)} | {text_col: text, "n_lines": n.cast("long"), "n_removed": gone.cast("long")}
    return met.select(*[v.alias(c) for c, v in out.items()])
