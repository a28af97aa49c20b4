"""What is shown of a search: sections, families, folders, badges, filters, positions (AGG7-AGG11, SET1-SET5, TOP8-TOP10, TOP12, JN14, JN15, §2.10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

NAME_CAP, OPENED_CAP, CONTENT_CAP, FOLDER_CAP, ROLLUP_CAP = 20, 5, 50, 10, 50
FILE_NAME, CONTENT, FOLDER = 1, 2, 4


def match_names(source: Column) -> Column:
    """MatchSource as text: FileName, Content, Folder, or None."""
    parts = F.array(*[F.when(source.bitwiseAND(F.lit(bit)) != 0, name) for bit, name in ((FILE_NAME, "FileName"), (CONTENT, "Content"), (FOLDER, "Folder"))])
    return F.when(source == 0, "None").otherwise(F.array_join(parts, ", "))


def families(hits: DataFrame) -> DataFrame:
    """AGG7: files whose names differ by version, date or copy marks: family_key, files (best first), latest date, score; best family first by ``score``.

    Input: file_id, filename, folder_path, modified_at, score.
    """
    key = X.family_key(F.col("folder_path"), F.col("filename"))
    files = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("order"), F.col("file_id"))))
    return hits.groupBy(key.alias("family_key")).agg(F.transform(files, lambda f: f["file_id"]).alias("files"), F.max("modified_at").alias("latest"), F.max("score").alias("score"), F.count("*").alias("n_files"))


def family_positions(hits: DataFrame) -> DataFrame:
    """TOP10: for files of families with more than one: versions, position (1 is the best), is_latest."""
    key = X.family_key(F.col("folder_path"), F.col("filename"))
    own = Window.partitionBy("_family")
    out = hits.withColumn("_family", key).withColumn("versions", F.count("*").over(own)).withColumn("position", F.row_number().over(own.orderBy(F.desc("score"), "file_id")))
    return out.where("versions > 1").select("file_id", "versions", "position", (F.col("position") == 1).alias("is_latest"))


def folders(hits: DataFrame, cap: int = ROLLUP_CAP) -> DataFrame:
    """AGG8: folders (case aside) with file count, best score and latest change; the best ``cap`` by score."""
    rows = hits.where(F.coalesce("folder_path", F.lit("")) != "").groupBy(F.lower("folder_path").alias("folder_key")).agg(F.min("folder_path").alias("folder"), F.count("*").alias("n_files"), F.max("score").alias("score"), F.max("modified_at").alias("latest"))
    return rows.orderBy(F.desc("score"), "folder_key").limit(cap)


def merge_folders(a: DataFrame, b: DataFrame, cap: int = FOLDER_CAP) -> DataFrame:
    """AGG9, SET1: of two rollups each folder's entry with more files; the ``cap`` with most files."""
    best = Window.partitionBy("folder_key").orderBy(F.desc("n_files"), F.desc("score"))
    both = a.unionByName(b).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    return both.orderBy(F.desc("n_files"), "folder_key").limit(cap)


def format_siblings(files: DataFrame) -> DataFrame:
    """AGG11: files of one folder and stem in PDF and in an office format: file_id, note (final_pdf or has_pdf)."""
    own = Window.partitionBy(F.lower("folder_path"), F.lower(X.file_stem(F.col("filename"))))
    ext = F.lower("extension")
    office = ext.isin(".pptx", ".ppt", ".docx", ".doc")
    met = files.withColumn("_pdf", F.max((ext == ".pdf").cast("int")).over(own)).withColumn("_office", F.max(office.cast("int")).over(own)).where("_pdf = 1 and _office = 1")
    return met.where((ext == ".pdf") | office).select("file_id", F.when(ext == ".pdf", "final_pdf").otherwise("has_pdf").alias("note"))


def content_threshold(hits: DataFrame, share: float = 0.25) -> DataFrame:
    """FLT15: with three or more hits, those of at least a quarter of the three best ones' mean score."""
    best = hits.orderBy(F.desc("score"), "file_id").limit(3).agg(F.avg("score").alias("_mean"), F.count("*").alias("_n"))
    return hits.crossJoin(F.broadcast(best)).where((F.col("_n") < 3) | (F.col("score") >= share * F.col("_mean"))).drop("_mean", "_n")  # one row


def sections(hybrid: DataFrame, quick: DataFrame, opened: DataFrame, keep_overflow: bool = False) -> DataFrame:
    """JN15, SET2, SET5, TOP8, Q10: each result's one section: file_id, section (filename, opened, content), place (from 1), score.

    ``hybrid`` and ``quick``: file_id, path, score, match_source; ``opened``: path_key,
    last_opened. A file goes to the first section that it fits. What a section's cap
    turns away is shown nowhere, or with ``keep_overflow`` goes on to the next section.
    """
    both = hybrid.select("file_id", "path", "score", "match_source", F.lit(0).alias("list")).unionByName(quick.select("file_id", "path", "score", F.lit(FILE_NAME).alias("match_source"), F.lit(1).alias("list")))
    first = Window.partitionBy("file_id").orderBy("list", F.desc("score"))
    names = both.where(F.col("match_source").bitwiseAND(F.lit(FILE_NAME)) != 0).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    shown = _first(names, NAME_CAP, "list", F.desc("score"), "file_id")
    rest = both.join(shown if keep_overflow else names, "file_id", "left_anti").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    seen = rest.withColumn("path_key", X.click_path(F.col("path"))).join(opened.select("path_key", "last_opened"), "path_key")
    shown_seen = _first(seen, OPENED_CAP, F.desc("last_opened"), "file_id")
    left = rest.where("list = 0").where(F.col("match_source").bitwiseAND(F.lit(CONTENT)) != 0).join(shown_seen if keep_overflow else seen, "file_id", "left_anti")
    content = _first(content_threshold(left), CONTENT_CAP, F.desc("score"), "file_id")
    named = [d.select("file_id", F.lit(n).alias("section"), "place", "score") for n, d in (("filename", shown), ("opened", shown_seen), ("content", content))]
    return named[0].unionByName(named[1]).unionByName(named[2])


def _first(rows: DataFrame, cap: int, *order) -> DataFrame:
    """The first ``cap`` rows with their place; only those are numbered in one task."""
    return rows.orderBy(*order).limit(cap).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def positions(placed: DataFrame) -> DataFrame:
    """TOP12: position of each result over all sections, from 0."""
    order = F.when(F.col("section") == "filename", 0).when(F.col("section") == "opened", 1).otherwise(2)
    return placed.withColumn("position", F.row_number().over(Window.orderBy(order, "place")) - 1)


def jaccard_distance(a: Column, b: Column) -> Column:
    """SET4: 1 - |common| / |all|; 0 of two empty lists."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_intersect(a, b)) / union)


def badges(files: DataFrame, as_of: Column, opened: DataFrame | None = None, versions: DataFrame | None = None, matched: DataFrame | None = None, most: int = 3) -> DataFrame:
    """§2.10, JN14, AGG10, TOP9: file_id, notes: up to three (priority, code, n), most important first, of equal ones in the order of rules.

    ``opened``: path_key, last_opened, clicks; ``versions``: as family_positions;
    ``matched``: as match_counts.
    """
    out = files.withColumn("path_key", X.click_path(F.col("path"))).withColumn("_in_folder", F.count("*").over(Window.partitionBy(F.lower("folder_path"))))
    out = out.join(format_siblings(files), "file_id", "left")
    for side, key, columns in ((opened, "path_key", ("last_opened timestamp_ntz", "clicks long")), (versions, "file_id", ("versions long", "position int", "is_latest boolean")), (matched, "file_id", ("match_count long", "first_match int"))):
        if side is not None:
            out = out.join(side.select(key, *[c.split()[0] for c in columns]), key, "left")
        else:
            out = out.withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in columns})
    ago, age = F.floor(X.age_days(F.col("last_opened"), as_of)).cast("long"), X.age_days(F.col("modified_at"), as_of)
    later = F.lit(None).cast("long")

    def note(when: Column, priority: int, code: str, n: Column = later) -> Column:
        return F.when(when, F.struct(F.lit(priority).alias("priority"), F.lit(code).alias("code"), n.cast("long").alias("n")))

    in_time = F.when(ago < 1, "opened_today").when(ago < 7, "opened_days_ago").when(ago < 14, "opened_last_week").when(ago < 60, "opened_last_month")
    rules = [
        note(F.col("note") == "final_pdf", 1, "final_pdf"),
        note(F.col("note") == "has_pdf", 1, "has_pdf"),
        note(F.col("is_latest"), 2, "latest", F.col("versions")),
        note(~F.col("is_latest"), 2, "not_latest"),
        note(F.col("clicks") >= 5, 3, "often_opened", F.col("clicks")),
        *[note(in_time == c, 4, c, ago if c == "opened_days_ago" else later) for c in ("opened_today", "opened_days_ago", "opened_last_week", "opened_last_month")],
        note(F.col("first_match") == 0, 5, "in_title"),
        note(F.col("first_match").isin(1, 2), 5, "on_first_page"),
        note(F.col("match_count") >= 2, 6, "in_places", F.col("match_count")),
        note(age < 1, 7, "modified_today"),
        note((age >= 1) & (age < 7), 7, "modified_this_week"),
        note(F.col("_in_folder") >= 3, 8, "related_in_folder", F.col("_in_folder")),
        note((age >= 7) & (age < 30), 9, "modified_this_month"),
        note(X.is_copy_name(F.col("filename")), 10, "copy"),
        note(age > 730, 10, "old"),
        note(~F.col("is_latest"), 11, "nth_version", F.col("position")),
    ]
    return out.select("file_id", F.slice(F.filter(F.array(*rules), lambda x: x.isNotNull()), 1, most).alias("notes"))
