"""Vector search and fusion (FLT14, FLT19, JN10-JN12, TOP3-TOP5, FN29, AGG23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

LEAST_SIMILARITY, RRF_K, LEAST_COVERAGE = 0.1, 60, 0.8
MOST_QUERIES = 1000


def similar(vectors: DataFrame, query: list[float], top: int = 20, least: float = LEAST_SIMILARITY, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """TOP3, FLT14: the ``top`` most similar vectors by cosine, at least ``least``; ties by key. The query is a literal: one scan, no join."""
    sim = X.cosine(F.col(column), F.array(*[F.lit(float(x)) for x in query]))
    return vectors.withColumn("similarity", sim).where(F.col("similarity") >= least).orderBy(F.desc("similarity"), key).limit(top)


def similar_to(vectors: DataFrame, queries: DataFrame, top: int = 20, least: float = LEAST_SIMILARITY) -> DataFrame:
    """TOP3 for a stated set of queries (query_id, query): their best vectors by rank. The set is broadcast; more than MOST_QUERIES are refused."""
    if queries.limit(MOST_QUERIES + 1).count() > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries; search them in parts")
    met = vectors.join(F.broadcast(queries), F.size("embedding") == F.size("query")).withColumn("similarity", X.cosine(F.col("embedding"), F.col("query"))).where(F.col("similarity") >= least)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "similarity")


def pooled(tokens: DataFrame, by: str, column: str = "embedding", mask: str = "mask") -> DataFrame:
    """FN26: (by, vector, n): the mean of each group's vectors whose ``mask`` isn't 0, scaled to length one; zeros where nothing counts or the mean is zero.

    Components are averaged apart, so a group of any size combines before the shuffle and no task holds its vectors.
    """
    own = F.coalesce(F.col(mask), F.lit(0)) != 0
    each = tokens.select(by, own.alias("_own"), F.posexplode(column).alias("_at", "_x"))
    mean = each.groupBy(by, "_at").agg(F.coalesce(F.avg(F.when(F.col("_own"), F.col("_x").cast("double"))), F.lit(0.0)).alias("_x"), F.count_if("_own").alias("n"))
    held = mean.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_x"))), lambda e: e["_x"]).alias("v"), F.max("n").alias("n"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return held.select(by, F.transform("v", lambda x: F.when(norm > 0, x / norm).otherwise(0.0)).alias("vector"), "n")


def rerank(hits: DataFrame, vectors: DataFrame, query: list[float]) -> DataFrame:
    """JN10, TOP4: keyword hits that have a vector, ranked by similarity (column dense_rank), ties by keyword rank."""
    met = hits.join(vectors, ["file_id", "chunk_index"]).withColumn("similarity", X.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])))
    top = met.where(F.col("similarity") >= LEAST_SIMILARITY)
    return top.withColumn("dense_rank", F.row_number().over(Window.orderBy(F.desc("similarity"), "bm25_rank"))).drop("embedding")


def fuse(keyword: DataFrame, dense: DataFrame, top: int = 20, weights: tuple[float, float] = (1.0, 1.0), key: str = "file_id") -> DataFrame:
    """JN11, FN29, TOP5, Q17, Q31: reciprocal rank fusion of two ranked lists (key, rank, score).

    Each list counts a key once, by its best rank. Missing sides score 0.
    """
    k = _best(keyword, key).select(key, F.col("rank").alias("k_rank"), F.col("score").alias("keyword_score"))
    d = _best(dense, key).select(key, F.col("rank").alias("d_rank"), F.col("score").alias("dense_score"))
    met = k.join(d, key, "full_outer")
    share = [F.coalesce(w / (F.lit(float(RRF_K)) + F.col(r)), F.lit(0.0)) for w, r in zip(weights, ("k_rank", "d_rank"), strict=True)]
    out = met.select(key, F.coalesce("keyword_score", F.lit(0.0)).alias("keyword_score"), F.coalesce("dense_score", F.lit(0.0)).alias("dense_score"), (share[0] + share[1]).alias("hybrid_score"))
    return out.orderBy(F.desc("hybrid_score"), key).limit(top)


def _best(ranked: DataFrame, key: str) -> DataFrame:
    return ranked.groupBy(key).agg(F.min(F.struct("rank", "score")).alias("b")).select(key, "b.rank", "b.score")


def enrich(hits: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """JN12: vector hits with their file's and chunk's columns where those exist."""
    return hits.join(files.select("file_id", "path", "filename", "extension", "modified_at"), "file_id", "left").join(chunks.select("file_id", "chunk_index", F.col("text").alias("content")), ["file_id", "chunk_index"], "left")


def available(embedded: Column, embeddable: Column, ready: bool = True) -> Column:
    """FLT19, STR9: the vector path is used from 80 % coverage on."""
    return F.lit(ready) & (embeddable > 0) & (embedded / F.greatest(embeddable, F.lit(1)) >= LEAST_COVERAGE)
