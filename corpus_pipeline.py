"""A training-data pipeline over ``documents``: five stages, each one operator of ``surveyspark.llm``.

Each stage takes (spark, docs, sf_dir) and gives the documents it keeps; every stage but the last
returns the columns of ``documents``. Stages run one after the other on Parquet in the cluster's
shared folder, so a lost executor costs its running tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from surveyspark.llm import jaccard_join, language_id, mixing, pii, sentencepiece_codec
from surveyspark.llm.common import light_files, rest_executors, small_batches, staged, table
from surveyspark.session import ensure_checkpoint_dir, ship_package


def _ready(spark: SparkSession) -> None:
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    small_batches(spark)
    light_files(spark)
    rest_executors(spark)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determined language go."""
    _ready(spark)
    return language_id.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    _ready(spark)
    return jaccard_join.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced in the texts."""
    _ready(spark)
    return pii.sanitise_stage(docs)


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as the mixture asks for."""
    _ready(spark)
    return mixing.resample_stage(docs, table(spark, sf_dir, "labels"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their SentencePiece ids, checked by decoding."""
    _ready(spark)
    return sentencepiece_codec.encode_stage(docs)


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", near_duplicates),
    ("pii", personal_data),
    ("mixing", target_weights),
    ("sentencepiece", token_ids),
]

#: no SQL: context trees, MinHash verification and subword ids can't be expressed in it
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
