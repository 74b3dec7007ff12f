"""Corpus pipeline over ``documents``: classify, drop exact copies, drop near copies, mix, encode.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a
DataFrame; every result is written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bpe, classifier, exact_dedup, mixing, near_dedup
from tidewell.llm.rows import copies_of, first_rows, text_key
from tidewell.session import scratch_path


def vocabulary() -> str:
    """Vocabulary file that an installed package brings to every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; of rows that repeat id and text, one."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = classifier.classify(docs, labels)
    return first_rows(docs, judged.filter("kept"), text_key(), "text_key")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of equal texts."""
    return first_rows(docs, exact_dedup.exact_duplicates(docs).filter("kept"), F.sha2(exact_dedup.normalised().cast("binary"), 256), "text_sha256")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return first_rows(docs, near_dedup.near_duplicates(docs).filter("kept"), text_key(), "text_key")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; rows that share an id are taken alike."""
    mixed = mixing.mix_documents(docs)
    return copies_of(docs, mixed.groupBy("doc_id").agg(F.max("copies").alias("copies")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of the mix."""
    return bpe.encode_documents(docs, vocabulary(), digests=True)


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("source mix", mix),
    ("byte-pair encoding", encode),
]

#: Classifier, sampling and tokens are beyond SQL; tests compare with plain computations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
