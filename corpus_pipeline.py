"""From raw documents to packed sequences: each stage reads what its predecessor kept, as Parquet."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from boardwise.llm import exact_dedup, near_copies as copies, packing, pii, quality
from boardwise.llm.common import delete, shared_folder

#: All stages: nulls, empty texts, ties and repeated rows have the results that the operators' docstrings state, other
#: columns of documents stay, whatever their names, and an empty table gives an empty result.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that too many documents of their source share."""
    return quality.keep_and_clean(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each text; null counts as empty."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group that pairs of Jaccard 0.8 or more connect, by five-word shingles.

    Pairs are found by fingerprints that meet in the middle, and verified."""
    return copies.drop_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked."""
    return pii.mask_personal_data(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, packing.SPECIAL)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("near-duplicates", near_copies),
    ("personal data", personal_data),
    ("packing", packed),
]

#: Fingerprints, labels of the random field and token ids have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table is deleted once its successor is written, so only the last one stays."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
    return docs
