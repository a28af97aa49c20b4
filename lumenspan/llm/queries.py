"""The registered queries, one for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, codebooks, digests, langid, linededup, neighbours, packing, quality, sentencepieces, simhash, toxicity, wordpiece, wrapper
from .common import read


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(read(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(read(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.sentence_pieces(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.compare_edits(read(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compress(read(spark, sf_dir, "embeddings"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.lloyd(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_quality_rules,
        op3_html_extraction,
        op4_language_id,
        op5_best_fit_packing,
        op6_token_counts,
        op7_sentencepiece,
        op8_line_dedup,
        op9_nearest_neighbours,
        op10_toxicity,
        op11_document_fingerprints,
        op12_vector_codes,
        op13_centroid_clustering,
    )
}
