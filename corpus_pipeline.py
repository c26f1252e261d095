"""From documents to packed sequences: toxic and poor texts go, one of each group of near copies stays, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cueloom.llm import packing, quality, simhash, staging, toxicity


def free(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have."""
    while name in docs.columns:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject; it learns from the labelled rows of the whole table."""
    known = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.train(known, spark.read.parquet(f"{sf_dir}/labels.parquet"), corpus=docs)
    score = free(docs, "toxicity")
    return toxicity.score(docs, model, score).where(F.col(score) < toxicity.THRESHOLD).select(docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    known = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.train(known, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free(docs, "quality")
    return quality.score(docs, model, score).where(F.col(score) >= quality.THRESHOLD).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group, once; rows without an id stay.

    Of rows that share the id the first one by text and then by the other columns stays.
    """
    kept = simhash.simhash_groups(docs).where("doc_id = component_id").select("doc_id").distinct()
    order = Window.partitionBy("doc_id").orderBy("text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    row = free(docs, "row")
    first = docs.join(kept, "doc_id", "left_semi").withColumn(row, F.row_number().over(order)).where(F.col(row) == 1).drop(row)
    return first.unionByName(docs.where("doc_id is null")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left and their places in sequences."""
    return packing.packed_digest(docs)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("simhash", drop_copies), ("packing", pack)]

#: SQL expresses neither the classifiers nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each but the last written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staging.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
