"""Folders named by the value of a key (``doc_id=7/...``), laid out as Spark's partitioned writers do, on file systems that every machine mounts.

Spark's own writer gives each file, checksum and folder its rights through a process of its own there, and its driver moves
all files one by one; its reader deserializes a configuration for each folder that it lists. Here the tasks make, name and
read the files themselves, and change only the files' own folders, as a folder that all change makes them wait for each
other. Spark reads what is written here, and the other way round.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from itertools import groupby, repeat

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession

from ..operators.spread import spread, tasks_of

_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")
_NAMES = {"encoding": "utf-8", "errors": "surrogateescape", "newline": "\n"}
#: Rows of many small files that are handed on at once, about.
BATCH_ROWS = 10_000


def mounted(spark: SparkSession, path: str) -> str | None:
    """The path as the operating system names it; None where it is on one of Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    named = jvm.org.apache.hadoop.fs.Path(path)
    uri = named.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(named).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def folder_name(key: str, value) -> str:
    return f"{key}=" + (_NO_VALUE if value is None or value == "" else _ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", str(value)))


def value_of(folder: str) -> str | None:
    value = folder.split("=", 1)[1]
    return None if value == _NO_VALUE else re.sub("%([0-9A-Fa-f]{2})", lambda h: chr(int(h[1], 16)), value)


class TextFile:
    """One line a row, as Spark's text files."""

    ending = "txt"

    def __init__(self, path: str, first: pa.RecordBatch):
        self.out = open(path, "wb")

    def add(self, rows: pa.RecordBatch) -> None:
        for value in rows.column(0).to_pylist():
            self.out.write((value or "").encode() + b"\n")

    def close(self) -> None:
        self.out.close()


class ParquetFile:
    ending = "parquet"

    def __init__(self, path: str, first: pa.RecordBatch):
        self.out = pq.ParquetWriter(path, first.schema, use_dictionary=first.num_rows >= 1_000, store_schema=False)

    def add(self, rows: pa.RecordBatch) -> None:
        self.out.write_batch(rows)

    def close(self) -> None:
        self.out.close()


def _writer(root: str, key: str, kind: type, name: str | None, lists: str | None) -> Callable:
    """Writes each run of rows with one key (and part) as a hidden file of the key's folder. It gets its name at once, or with
    ``lists`` is put on a list there before it is made. Gives (list, files)."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, out, made, task, me, at, nth = None, None, 0, TaskContext.get().partitionId(), uuid.uuid4().hex, None, 0
        listed = open(f"{lists}/{task}-{me}", "w", 1, **_NAMES) if lists else None

        def begin(piece):
            nonlocal out, at, nth
            last, at = at and at[0], folder_name(key, run[0])
            nth = nth + 1 if at == last else 0  # no value and an empty one share a folder
            at = at, (f"{name}-{run[1]}" if name else f"part-{task:05d}.c{nth:03d}") + f".{kind.ending}"
            if listed:
                listed.write("\t".join((*at, f".{at[1]}.{me}")) + "\n")
            os.path.isdir(f"{root}/{at[0]}") or os.makedirs(f"{root}/{at[0]}", exist_ok=True)
            out = kind(f"{root}/{at[0]}/.{at[1]}.{me}", piece)

        def end():
            nonlocal made
            out.close()
            if not listed:
                os.replace(f"{root}/{at[0]}/.{at[1]}.{me}", f"{root}/{at[0]}/{at[1]}")
            made += 1

        for batch in batches:
            runs = zip(batch.column(key).to_pylist(), batch.column("_part").to_pylist() if name else repeat(0))
            plain, start = batch.drop_columns([key, "_part"] if name else [key]), 0
            for named, rows in groupby(runs):
                n = sum(1 for _ in rows)
                piece, start = plain.slice(start, n), start + n
                if out is None or named != run:
                    if out is not None:
                        end()
                    run = named
                    begin(piece)
                out.add(piece)
        if out is not None:
            end()
        if listed:
            listed.close()
        yield pa.record_batch({"list": pa.array([f"{task}-{me}"]), "files": pa.array([made], pa.int64())})

    return write


def write_new(rows: DataFrame, path: str, key: str, kind: type) -> int:
    """Writes a folder for each key, all of which take the place of a path at once when they are whole; gives the number of files.

    All rows of a key must be in one partition. A task that runs again writes the same files again.
    """
    made = f"{os.path.dirname(path)}/.{os.path.basename(path)}-{uuid.uuid4().hex}"
    os.makedirs(made)
    try:
        files = sum(r["files"] for r in rows.sortWithinPartitions(key).mapInArrow(_writer(made, key, kind, None, None), "list string, files long").collect())
        open(f"{made}/_SUCCESS", "wb").close()
        if os.path.lexists(path):
            os.rename(path, f"{made}-old")
        os.rename(made, path)
    except BaseException:
        shutil.rmtree(made, ignore_errors=True)
        raise
    shutil.rmtree(f"{made}-old", ignore_errors=True)
    rows.sparkSession.catalog.refreshByPath(path)
    return files


def write_over(rows: DataFrame, root: str, key: str, kind: type, name: str, part: Column, order: tuple[str, ...] = ()) -> int:
    """Writes one file (name-part) for each key and part into the keys' folders; gives their number.

    All files are whole, and hidden, before the first one gets its name; then each takes the place of the one of its part, and
    files that aren't named so leave the folder. All rows of a file must be in one partition.
    """
    spark = rows.sparkSession
    lists = f"{root}/.new-{uuid.uuid4().hex}"
    os.makedirs(lists)
    kept = set()
    try:
        ordered = rows.withColumn("_part", part).sortWithinPartitions(key, "_part", *order)
        written = ordered.mapInArrow(_writer(root, key, kind, name, lists), "list string, files long").collect()
        won = [r["list"] for r in written if r["files"]]
        if won:
            spread(spark.createDataFrame([(w,) for w in won], "list string"), "list", len(won)).mapInArrow(_namer(root, lists, name), "files long").collect()
        open(f"{root}/_SUCCESS", "wb").close()
        kept = set(won)
    finally:  # what tasks left that failed, or ran twice
        for one in set(os.listdir(lists)) - kept:
            _leave(root, f"{lists}/{one}")
        shutil.rmtree(lists)
    spark.catalog.refreshByPath(root)
    return sum(r["files"] for r in written)


def _listed(path: str) -> Iterator[list[str]]:
    with open(path, **_NAMES) as f:
        yield from (line[:-1].split("\t") for line in f if line.endswith("\n"))


def _leave(root: str, path: str) -> None:
    for folder, _, hidden in _listed(path):
        with suppress(OSError):
            os.unlink(f"{root}/{folder}/{hidden}")
        with suppress(OSError):  # it stays where there are other files
            os.rmdir(f"{root}/{folder}")


def _namer(root: str, lists: str, name: str) -> Callable:
    """Names the files of lists; those that are named already, by a task that runs again, stay so."""
    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            for one in batch.column(0).to_pylist():
                for folder, file, hidden in _listed(f"{lists}/{one}"):
                    for other in os.listdir(f"{root}/{folder}"):
                        if other[0] != "." and not other.startswith(f"{name}-"):
                            with suppress(FileNotFoundError):
                                os.unlink(f"{root}/{folder}/{other}")
                                os.unlink(f"{root}/{folder}/.{other}.crc")
                    with suppress(FileNotFoundError):
                        os.replace(f"{root}/{folder}/{hidden}", f"{root}/{folder}/{file}")
                    done += 1
        yield pa.record_batch({"files": pa.array([done], pa.int64())})

    return named


def folders(spark: SparkSession, root: str, key: str) -> DataFrame:
    """(folder): names of the key's folders under a root, listed by one task and dealt out to many."""
    def names(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with os.scandir(root) as there:
            found = [e.name for e in there if e.name.startswith(f"{key}=")]
        for at in range(0, len(found), BATCH_ROWS):
            yield pa.record_batch({"folder": pa.array(found[at:at + BATCH_ROWS], pa.string())})

    listed = spark.range(0, 1, 1, 1).mapInArrow(names, "folder string")
    return listed.repartition(tasks_of(listed), "folder")


def read_folders(named: DataFrame, root: str, key: str, schema: str) -> DataFrame:
    """The Parquet rows, of a schema that ends with the key, in the folders under a root of these names (folder) or keys; one that isn't there has none."""
    keys = key in named.columns
    columns = [c.split()[0] for c in schema.split(",")][:-1]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                folder = folder_name(key, folder) if keys else folder
                try:
                    files = sorted(n for n in os.listdir(f"{root}/{folder}") if n[0] not in "._")
                except FileNotFoundError:
                    continue
                value = value_of(folder)
                for name in files:
                    with pq.ParquetFile(f"{root}/{folder}/{name}") as f:
                        for piece in f.iter_batches(BATCH_ROWS, columns=columns, use_threads=False):
                            held.append(pa.table([*(piece.column(c) for c in columns), pa.repeat(pa.scalar(value, pa.string()), piece.num_rows)], [*columns, key]))
                            rows += piece.num_rows
                            if rows >= BATCH_ROWS:
                                yield from pa.concat_tables(held).combine_chunks().to_batches()
                                held, rows = [], 0
        if rows:
            yield from pa.concat_tables(held).combine_chunks().to_batches()

    return named.select(key if keys else "folder").mapInArrow(read, schema)
