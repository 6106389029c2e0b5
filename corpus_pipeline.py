"""The corpus pipeline: classify, drop near-duplicates, cut repeats, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
every stage's output is a Parquet table in the shared folder, read again as the next
one's documents. All but the last return the columns of documents. Columns with other
names are carried along. Empty in, empty out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinetrace.llm import minhash, mixing, pieces, quality_model, suffix_dedup
from kinetrace.storage import keep


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of ``sf_dir``, accepts."""
    return quality_model.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return minhash.deduplicated(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 200 bytes and more that start elsewhere too."""
    return suffix_dedup.without_repeats(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents repeated, cut or left out as their source's target asks."""
    return mixing.mixed_documents(docs)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids) of every document of the mix."""
    return pieces.encoded(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources to target weights", source_mixing),
    ("SentencePiece encoding", sentencepiece_encoding),
]

#: The classifier and the tokenizer can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
