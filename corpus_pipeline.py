"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandspark.llm import contamination, jaccard, mixing, quality, substrings
from strandspark.llm.ship import release_since, shared_folder, stashed


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go; a null text is judged as an empty one."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similar word shingles link stays: the one with the smallest doc_id.

    Texts without words, and rows without doc_id, stay; so do all rows of an id that stays.
    """
    return jaccard.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of twenty words or more that begin earlier too (by doc_id, nulls last) are cut from the texts; no row goes."""
    return substrings.remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item go, judged by their texts alone; null and empty texts stay."""
    return contamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with words taken and all passes (each its position and words), in order of the first position.

    Texts without words aren't taken; a null source is a source.
    """
    return mixing.in_order(mixing.mix(docs).filter("taken > 0"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: The classifier, trained here, has no SQL; ``tests/llm`` holds each stage against a brute-force version of its rules.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``.  What a stage stashed on its way goes once its result is written.

    Nulls, empty texts, repeated rows and further columns are what the operators of the stages say; an empty table stays empty.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path, mark = f"{shared_folder(spark)}/pipeline/{uuid.uuid4().hex}-{name}", stashed()
        stage(spark, docs, sf_dir).write.parquet(path)
        release_since(spark, mark)
        docs = spark.read.parquet(path)
    return docs
