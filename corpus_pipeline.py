"""The corpus pipeline: quality, near-duplicates, repeated passages, decontamination, packing.

Each stage takes all that the stage before kept; the first four return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilewright.llm import decontaminate, packing, quality, simhash, suffix
from tilewright.llm.common import free_name, load, scratch, scratch_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of 0.3 or more, by a classifier fitted on the labels."""
    model = quality.fit(docs, load(spark, sf_dir, "labels"))
    name = free_name(docs, "score")
    scored = quality.score(docs, model, docs.columns, name)
    return scored.where(scored[name] >= 0.3).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles are alike to 0.8 or more."""
    return simhash.drop_near_duplicates(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes and more that occur more than once."""
    return suffix.without_repeats(docs)


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, load(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("repeated passages", remove_repeated_passages),
    ("decontamination", decontaminate_documents),
    ("packing", pack_sequences),
]

#: No stage can be said in SQL; tests/llm/test_pipeline.py holds each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage wrote on its way is deleted once its documents are written."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
