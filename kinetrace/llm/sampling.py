"""Labelled rows for fitting: a documented bound, the same rows on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled documents that a classifier is fitted on.
MOST_LABELLED = 20_000


def remainder(modulus: int):
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def held_out(modulus: int, fold: int):
    return F.coalesce(remainder(modulus) == fold, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, modulus: int, fold: int, most: int = MOST_LABELLED) -> DataFrame:
    """(text, y, doc_id) of at most ``most`` labelled documents outside the held-out fold, chosen by a hash of the id.

    Ids with conflicting labels are left out. The chosen ids are bounded by ``most``, so they are broadcast.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
    known = known.where(~held_out(modulus, fold)).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y1")).where("y = y1").select("doc_id", "y")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("text", "y", "doc_id")
