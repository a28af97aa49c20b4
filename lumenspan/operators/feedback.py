"""Click log analytics (SNK10, AGG5, FTS13, STR4, STR5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def bounces(events: DataFrame, within_seconds: float = 10.0) -> DataFrame:
    """STR4: the clicks of ``events`` with ``is_bounce``: the user's next event is a search within the given time, not by typing on.

    Typing on means that one query starts with the other. Events: event_id, user_id, ts,
    event_type (click, view: a search), query.
    """
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    nxt = events.withColumn("_type", F.lead("event_type").over(order)).withColumn("_ts", F.lead("ts").over(order)).withColumn("_query", F.lead("query").over(order))
    gap = (F.unix_micros(F.col("_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    a, b = F.lower("query"), F.lower("_query")
    again = (F.col("_type") == "view") & (gap <= within_seconds) & ~(a.startswith(b) | b.startswith(a))
    return nxt.where("event_type = 'click'").withColumn("is_bounce", F.coalesce(again, F.lit(False))).drop("_type", "_ts", "_query")


def click_key(query: Column) -> Column:
    """The form of a query that clicks are counted under, in batches and streams alike."""
    return F.lower(F.trim(X.remove_stop_words(query)))


def click_table(clicks: DataFrame, forgive: bool = False) -> DataFrame:
    """SNK10, Q25: per query and path: clicks, last click, least position, bounce.

    A bounce stays for good, or with ``forgive`` only until a later click without one.
    """
    last = F.max(F.struct("ts", "is_bounce")).getField("is_bounce") if forgive else F.max("is_bounce")
    return clicks.groupBy(click_key(F.col("query")).alias("query"), X.click_path(F.col("path")).alias("path_key")).agg(F.count("*").alias("click_count"), F.max("ts").alias("last_clicked"), F.min("position").alias("position"), last.alias("is_bounce"))


def boosts(clicks: DataFrame, query: str) -> DataFrame:
    """FTS13: (path_key, click_boost) of one query."""
    from ..functions.query import remove_stop_words

    return clicks.where(F.col("query") == remove_stop_words(query).strip().lower()).select("path_key", X.click_boost(F.col("click_count"), F.col("position"), F.col("is_bounce")).alias("click_boost"))


def recently_opened(clicks: DataFrame, limit: int = 5, paths: DataFrame | None = None) -> DataFrame:
    """AGG5, Q22: paths by their last click that didn't bounce, with all their clicks; of ``paths`` (path_key) only."""
    good = clicks.where(~F.col("is_bounce"))
    if paths is not None:
        good = good.join(paths.select("path_key").distinct(), "path_key", "left_semi")
    return good.groupBy("path_key").agg(F.max("last_clicked").alias("last_opened"), F.sum("click_count").alias("clicks")).orderBy(F.desc("last_opened"), "path_key").limit(limit)


def count_bucket(n: Column) -> Column:
    """A8"""
    return F.when(n < 1000, "<1k").when(n < 10_000, "1k-10k").when(n < 100_000, "10k-100k").otherwise("100k+")


def telemetry(searches: DataFrame, total_files: Column) -> DataFrame:
    """AGG19, Q18: counters over searches (mode, duration_ms, results): count, empty ones, whole-number mean duration, by mode, size bucket."""
    n = F.count("*")
    return searches.agg(
        n.alias("searches"),
        F.count_if(F.col("results") == 0).alias("empty"),
        F.coalesce(F.try_divide(F.sum("duration_ms") - F.sum("duration_ms") % F.greatest(n, F.lit(1)), n).cast("long"), F.lit(0)).alias("mean_ms"),
        *[F.count_if(F.col("mode") == m).alias(m.lower()) for m in ("Fast", "Smart", "Deep")],
        F.max(count_bucket(total_files)).alias("files_bucket"),
    )


def subtract(counters: DataFrame, sent: DataFrame, keys: list[str]) -> DataFrame:
    """AGG20: counters less what was sent already, so increments between aren't lost; never below zero."""
    now, old = counters.alias("n"), sent.alias("s")
    return now.crossJoin(F.broadcast(old)).select(*[F.greatest(F.lit(0), F.col(f"n.{k}") - F.col(f"s.{k}")).alias(k) for k in keys])  # one row each
