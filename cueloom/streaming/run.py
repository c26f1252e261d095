"""Streams run to the end of what is there, with results and state in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..operators.spread import tasks_of


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset, a temporary one if the session runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root}/cueloom/{name}-{uuid.uuid4().hex}"


_STORE = "spark.sql.streaming.stateStore.providerClass"
#: What opening a file costs, as the bytes that could be read meanwhile; Spark's 4 MB make a task of every few files.
_OPENING = 1 << 18


@contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def state_on_disk(spark: SparkSession):
    """Streams that are started inside keep their state in RocksDB, in the executors' own scratch space, with changes in the checkpoint."""
    return _settings(spark, **{_STORE: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"})


def small_files(spark: SparkSession):
    """Reads that are planned and streams that are started inside list folders in as many tasks as other work has, not one for
    each folder, and read hundreds of small files in a task."""
    return _settings(spark, **{"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(tasks_of(spark.range(0))), "spark.sql.files.openCostInBytes": str(_OPENING)})


def rows_of_stream(stream: DataFrame, name: str) -> DataFrame:
    """All rows that an append stream emits for the input there is now; the file sink takes each batch exactly once."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession, name)
    with state_on_disk(spark):
        query = (stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
                 .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def rows_of_batches(started: Callable, spark: SparkSession, name: str, schema: str) -> DataFrame:
    """All rows of a stream's batches: ``started(sink)`` gives its writer; a batch that is run again replaces its folder."""
    folder = shared_folder(spark, name)

    def sink(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch_id={batch_id}")

    started(sink).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/rows")
