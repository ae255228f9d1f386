"""Five stages that turn raw documents into token ids. Each takes ``(spark, docs, sf_dir)`` and returns the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallywind.llm import decontaminate, exact_dedup, jaccard_join, piece_codec, quality_knn
from tallywind.llm.queries import SETTINGS
from tallywind.llm.shipping import ship
from tallywind.session import scratch_path


def _ready(spark: SparkSession) -> None:
    ship(spark)
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled neighbours do not reject."""
    _ready(spark)
    return quality_knn.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text but for white space, the one with the smallest id."""
    _ready(spark)
    return exact_dedup.drop_copies(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents connected by a Jaccard similarity of 0.8 or more, the one with the smallest id."""
    _ready(spark)
    return jaccard_join.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item aligns."""
    _ready(spark)
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, checked against the other library and by decoding."""
    _ready(spark)
    return piece_codec.encode(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_deduplication),
    ("n-gram Jaccard join", near_deduplication),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", piece_encoding),
]

# The first and the last stage cannot be expressed in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and reread as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
