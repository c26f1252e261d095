"""Rows dealt out to all cores before work that costs much more than its rows are large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

#: Tasks for each core, so that a slow one doesn't keep the others waiting.
TASKS_A_CORE = 8

#: Files of one task, about, where each key has files of its own: creating one costs much more than its bytes.
FILES_A_TASK = 500


def tasks_of(rows: DataFrame, at_least: int = 1) -> int:
    """Tasks for costly work: some for each core, no less than there are shuffle partitions."""
    spark = rows.sparkSession
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_A_CORE * spark.sparkContext.defaultParallelism)


def spread(rows: DataFrame, key: str, at_least: int = 1) -> DataFrame:
    """The rows by hash of a key. A compact table is read in one task for each row group, however many rows that has, and a
    shuffle of few bytes is joined to few tasks again; a number that is asked for stays."""
    return rows.repartition(tasks_of(rows, at_least), key)


def spread_files(rows: DataFrame, key: str, keys: DataFrame, *more: Column) -> DataFrame:
    """The rows by hash of a key, and of more, for a writer with a folder for each key: as many tasks as its keys ask for."""
    return rows.repartition(tasks_of(rows, keys.select(key).distinct().count() // FILES_A_TASK), key, *more)
