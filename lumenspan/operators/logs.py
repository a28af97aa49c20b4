"""Diagnostic log analytics (SRC15, FN38, AGG12-AGG18, TOP11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store

PAIR = r'(\w+)=("(?:\\.|[^"\\])*"|\S*)'


def parse_log(lines: DataFrame, since: str | None = None) -> DataFrame:
    """SRC15: (ts, category, kv) of the lines in column ``value``; comments and lines of fewer than four fields drop out."""
    parts = F.split(F.col("value"), "\t", 4)
    ok = lines.where(~F.col("value").startswith("#")).select(parts.alias("p")).where(F.size("p") == 4)
    rest = F.get("p", F.lit(3))
    keys, raw = F.regexp_extract_all(rest, F.lit(PAIR), F.lit(1)), F.regexp_extract_all(rest, F.lit(PAIR), F.lit(2))
    bare = F.transform(raw, lambda v: F.when(v.startswith('"'), F.regexp_replace(F.substring(v, F.lit(2), F.length(v) - 2), r"\\(.)", "$1")).otherwise(v))
    # Of a key that repeats the last value counts.
    last = F.filter(F.arrays_zip(keys.alias("k"), bare.alias("v"), F.sequence(F.lit(1), F.size(keys)).alias("i")), lambda e: ~F.array_contains(F.slice(keys, e["i"] + 1, F.size(keys)), e["k"]))
    out = ok.select(F.get("p", F.lit(0)).alias("ts"), F.get("p", F.lit(2)).alias("category"), F.when(F.size(keys) > 0, F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))).otherwise(F.create_map().cast("map<string,string>")).alias("kv"))
    return out.where(F.col("ts") >= since) if since else out


def extracts(events: DataFrame) -> DataFrame:
    """EXTRACT_FILE events: path, ext, size_bytes, ms, result."""
    return events.where("category = 'EXTRACT_FILE'").select(F.col("kv.path").alias("path"), F.col("kv.ext").alias("ext"), F.expr("try_cast(kv.size_bytes as bigint)").alias("size_bytes"), F.expr("try_cast(kv.extract_ms as double)").alias("ms"), F.col("kv.result").alias("result"))


def details(events: DataFrame) -> DataFrame:
    """PARSE_DETAIL events: ext, stage, ms."""
    return events.where("category = 'PARSE_DETAIL'").select(F.col("kv.ext").alias("ext"), F.col("kv.stage").alias("stage"), F.expr("try_cast(kv.time_ms as double)").alias("ms"))


#: Ranges that a round cuts a target's range of values into, and targets that are broadcast.
RANGES, FEW_TARGETS = 256, 10_000


def percentiles(rows: DataFrame, by: list[str], ps: list[int], value: str = "ms") -> DataFrame:
    """AGG13: nearest-rank percentiles as item min(floor(n p / 100), n - 1) of the sorted values, plus n, total and max.

    Exact, and no group is ever sorted or met in one task: equal values are counted once,
    then each round counts what lies in RANGES parts of a target's range of values and
    goes on with the part that holds its rank, from that part's least to its largest value,
    until these are equal. A window sees RANGES rows of a target.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    hist = store.materialize(counted, "counted")
    base = hist.groupBy(*by).agg(F.sum("_c").alias("n"), F.sum(F.col("_v") * F.col("_c")).alias("total_ms"), F.max("_v").alias("max_ms"), F.min("_v").alias("_lo"))
    each = base.withColumn("_p", F.explode(F.array(*[F.lit(p) for p in ps])))
    targets = store.materialize(each.select(*by, "n", "total_ms", "max_ms", "_p", F.least(F.floor(F.col("n") * F.col("_p") / 100), F.col("n") - 1).alias("_rank"), "_lo", F.col("max_ms").alias("_hi")), "targets")
    own = [*by, "n", "total_ms", "max_ms", "_p"]
    while unsettled := targets.where("_lo < _hi").count():
        # Values of each target's range by part; ranks count from the range's start.
        asked = targets.where("_lo < _hi").select(*[F.col(c).alias(f"_{c}") if c in by else F.col(c) for c in targets.columns])
        asked = F.broadcast(asked) if unsettled <= FEW_TARGETS else asked
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
        met = hist.join(asked, [*same, F.col("_v").between(F.col("_lo"), F.col("_hi"))])
        part = F.least(F.lit(RANGES - 1), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * RANGES))
        parts = met.groupBy(*own, "_rank", part.alias("_part")).agg(F.sum("_c").alias("_m"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        up = Window.partitionBy(*own).orderBy("_part")
        held = parts.withColumn("_to", F.sum("_m").over(up)).where((F.col("_to") > F.col("_rank")) & (F.col("_to") - F.col("_m") <= F.col("_rank")))
        now = held.select(*own, (F.col("_rank") - F.col("_to") + F.col("_m")).alias("_rank"), "_lo", "_hi")
        targets = store.materialize(now.unionByName(targets.where("_lo >= _hi")), "targets")
    picks = [F.max(F.when(F.col("_p") == p, F.col("_lo"))).alias(f"p{p}") for p in ps]
    return targets.groupBy(*own[:-1]).agg(*picks)


def by_extension(rows: DataFrame) -> DataFrame:
    """AGG12, AGG14: per extension: n, p50, p95, max, total and its share of all time."""
    per = percentiles(rows, ["ext"], [50, 95])
    whole = F.sum("total_ms").over(Window.partitionBy())
    return per.withColumn("share", F.col("total_ms") / F.greatest(whole, F.lit(1.0)))


def results(rows: DataFrame) -> DataFrame:
    """AGG12: events by extension and result."""
    return rows.groupBy("ext", "result").count().withColumnRenamed("count", "n")


def failures(rows: DataFrame) -> DataFrame:
    """AGG17"""
    return rows.where(F.col("result").startswith("error") | (F.col("result") == "skip_cloud")).groupBy("ext", "result").agg(F.count("*").alias("n"))


def size_bucket(n: Column) -> Column:
    """AGG15"""
    kb = 1024
    return F.when(n.isNull() | (n < 0), "unknown").when(n < 100 * kb, "<100KB").when(n < kb * kb, "100KB-1MB").when(n < 10 * kb * kb, "1-10MB").otherwise(">10MB")


def by_size(rows: DataFrame) -> DataFrame:
    """AGG15"""
    return rows.groupBy(size_bucket(F.col("size_bytes")).alias("bucket")).agg(F.count("*").alias("n"), F.avg("ms").alias("mean_ms"))


def by_stage(rows: DataFrame) -> DataFrame:
    """AGG16"""
    return percentiles(rows, ["ext", "stage"], [50, 95])


def slowest(rows: DataFrame, limit: int = 20) -> DataFrame:
    """TOP11"""
    return rows.orderBy(F.desc("ms"), "path").select("path", "ext", "size_bytes", "ms").limit(limit)


def throughput(rows: DataFrame) -> DataFrame:
    """AGG14: files, total time, files per minute."""
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("ms"), F.lit(0.0)).alias("total_ms")).withColumn("per_minute", F.col("n") / F.greatest(F.col("total_ms") / 60000, F.lit(1e-9)))


def bottlenecks(rows: DataFrame, stages: DataFrame, top: int = 5, ext_share: float = 0.15, stage_share: float = 0.7) -> DataFrame:
    """AGG18: among the ``top`` extensions by time those with over 15 % of it whose main stage takes over 70 % of their stages' time."""
    ext = by_extension(rows).orderBy(F.desc("total_ms"), "ext").limit(top).where(F.col("share") > ext_share).select("ext", "share")
    per = stages.groupBy("ext", "stage").agg(F.sum("ms").alias("stage_ms"))
    main = per.groupBy("ext").agg(F.max(F.struct("stage_ms", "stage")).alias("m"), F.sum("stage_ms").alias("all_ms"))
    return ext.join(main, "ext").select("ext", "share", F.col("m.stage").alias("stage"), (F.col("m.stage_ms") / F.greatest(F.col("all_ms"), F.lit(1.0))).alias("stage_share")).where(F.col("stage_share") > stage_share)


def quote(value: Column) -> Column:
    """FN38: a value as it stands in a log line, quoted where it holds white space or quotes."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike(r'[\s"\\=]'), F.concat(F.lit('"'), F.regexp_replace(text, r'(["\\])', r"\\$1"), F.lit('"'))).otherwise(text)


def log_line(ts: Column, elapsed: Column, category: Column, pairs: dict[str, Column]) -> Column:
    """SNK16"""
    return F.concat_ws("\t", ts, elapsed, category, *[F.concat(F.lit(f"{k}="), quote(v)) for k, v in pairs.items()])


def markdown(tables: dict[str, DataFrame], limit: int = 50) -> str:
    """SNK17: a report of small result tables; rendering is the driver's work, the numbers aren't."""
    out = []
    for title, df in tables.items():
        rows = df.limit(limit).collect()
        out += [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows] + [""]
    return "\n".join(out)
