"""One query for each numbered operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embeddings, exact, fill_in_middle, html_text, packing, quality, simhash, suffix, token_counts, token_files, urls, vector_codes
from .common import load


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_components(load(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(load(spark, sf_dir, "documents")).drop("kept")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(load(spark, sf_dir, "documents"), end_id=2)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the page of a document is bad if the document is labelled low quality or toxic."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    outcomes = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("document"), bad.alias("bad"))
    return urls.judge(load(spark, sf_dir, "pages"), outcomes)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), end_id=0, capacity=1024)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(load(spark, sf_dir, "documents"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(load(spark, sf_dir, "embeddings"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(load(spark, sf_dir, "pages"))


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(load(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(load(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_simhash, op2_decontaminate, op3_suffix, op4_quality, op5_token_files,
        op6_url_filters, op7_packing, op8_token_counts, op9_embeddings, op10_html_text,
        op11_exact, op12_vector_codes, op13_fill_in_middle,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filters": urls.ORACLE, "op11_exact": exact.ORACLE, "op12_vector_codes": vector_codes.ORACLE, "op13_fill_in_middle": fill_in_middle.ORACLE}
