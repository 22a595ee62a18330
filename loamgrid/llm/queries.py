"""The queries of this subpackage, one per operator, over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from loamgrid.llm import bpe, collocations, contamination, counts, html, jaccard, licenses, neighbours, packing, quality, resampling, secrets, suffixes
from loamgrid.llm.base import table


def op1_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return html.extract(table(spark, sf, "pages"))


def op2_license_scans(spark: SparkSession, sf: str) -> DataFrame:
    """A document is a file; its directory is its source and, below that, its language."""
    files = table(spark, sf, "documents").select(F.col("doc_id").alias("file"), F.concat_ws("/", "source", "lang").alias("directory"), "text")
    return licenses.scan(files)


def op3_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffixes.remove_copies(table(spark, sf, "documents"))


def op4_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op5_byte_level_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf, "documents"))


def op6_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return counts.token_counts(table(spark, sf, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf, "documents")).drop("text_key")


def op8_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.host_quality(table(spark, sf, "documents")).drop("text_key")


def op9_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"))


def op10_secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.scan(table(spark, sf, "documents"))


def op11_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contamination.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op12_phrase_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"))


def op13_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return resampling.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_html_extraction, op2_license_scans, op3_suffix_array_dedup, op4_nearest_neighbours, op5_byte_level_bpe, op6_token_counts,
        op7_ngram_jaccard_join, op8_quality_rules, op9_packing, op10_secret_scans,
        op11_benchmark_decontamination, op12_phrase_collocations, op13_importance_resampling, pipeline,
    )
    return {q.__name__: q for q in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op8_quality_rules": quality.ORACLE,
        "op11_benchmark_decontamination": contamination.ORACLE,
        "op12_phrase_collocations": collocations.ORACLE,
        "op13_importance_resampling": resampling.ORACLE,
    }
