"""Labelled documents: the bounded sample that a classifier is fitted on, and the held-out rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FOLDS = 5


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; labels of such rows are never learned from."""
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")
    return F.crc32(text) % FOLDS == 0


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, rows: int) -> DataFrame:
    """(text, label, part) of at most ``rows`` labelled ids outside the held-out fold; part is a hash in [0, 1000).

    The ids with the smallest hashes are taken, so that the sample is the same on every run. It is bounded, and so may
    be broadcast: the documents are scanned once, and only the sample's are shuffled. An id that occurs more than once
    has its highest label and, of its texts, the least one. Null ids and null labels are left out.
    """
    label = F.when(F.col(label_col) > 0, 1).otherwise(0)
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull())
             .select(F.col("doc_id").cast("long").alias("doc_id"), label.alias("label"))
             .where(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    one = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return one.select(
        "text", "label", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1000)).cast("int").alias("part"))
