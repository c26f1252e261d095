"""Work done once for each distinct word of a whole corpus, and given back to the documents.

Documents are read in blocks. A block numbers its distinct words and keeps its documents as word numbers; words go to
buckets by a hash. One shuffle brings together the blocks' words of each bucket, where every distinct word gets its
value, and a second one brings the values back to the blocks. No text is shuffled, nothing is collected or broadcast. A
word is at most once in a block, so that even the most frequent one is no more often in its bucket than there are blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

#: Characters of text of one block, about; a longer document is a block of its own. It bounds a task's memory.
BLOCK_CHARS = 5_000_000
#: Characters of the documents of one row of a block, about, and words that are packed for their blocks at once.
ROW_CHARS, PACKED_WORDS = 1_000_000, 250_000

#: Documents of a block (key is the block), or words of a bucket of a block (key is -1 - bucket).
_ROW = "key long, block long, doc_ids array<long>, n_bytes array<long>, sizes binary, codes binary, words binary"
_NAMES = ["key", "block", "doc_ids", "n_bytes", "sizes", "codes", "words"]
_VALUES = "key long, places binary, sizes binary, flat binary"


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, compressed: first all low bytes, then all next ones and so on."""
    return pa.compress(np.ascontiguousarray(numbers, np.int32).view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True) + len(numbers).to_bytes(4, "little")


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[-4:], "little")
    flat = np.frombuffer(pa.decompress(data[:-4], decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, n).T).view(np.int32).reshape(n)


def _blocks(new_index: Callable, buckets: int, block_chars: int, row_chars: int):
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task that is run again reads the same rows in the same order, and so gives its blocks the same numbers
        block = TaskContext.get().partitionId() << 32
        longs = pa.list_(pa.int64())

        def row(key: int, ids: list, n_bytes: list, sizes: np.ndarray, codes: np.ndarray, words: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([key], pa.int64()), pa.array([block], pa.int64()), pa.array([ids], longs), pa.array([n_bytes], longs),
                 *(pa.array([x], pa.binary()) for x in (packed(sizes), packed(codes), words))], _NAMES)

        def documents(ids: list, n_bytes: list, matches: list) -> pa.RecordBatch:
            return row(block, ids, n_bytes, np.array([len(m) // 4 for m in matches]), np.frombuffer(b"".join(matches), np.int32), b"")

        def words(index) -> Iterator[pa.RecordBatch]:
            every = list(index.places)
            bucket = np.array([zlib.crc32(w.encode()) % buckets for w in every], np.int64)
            order = np.argsort(bucket, kind="stable")
            for places in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                if len(places):
                    some = [every[p] for p in places.tolist()]
                    yield row(-1 - int(bucket[places[0]]), [], [], np.array(list(map(len, some))), np.diff(places, prepend=0),
                              pa.compress("".join(some).encode(), codec="zstd", asbytes=True) + sum(len(w.encode()) for w in some).to_bytes(8, "little"))

        index, chars, now, ids, n_bytes, matches = new_index(), 0, 0, [], [], []
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i), n_bytes.append(len(text.encode())), matches.append(index.text(text))
                now += len(text)
                if now >= row_chars or len(ids) >= row_chars // 20:
                    yield documents(ids, n_bytes, matches)
                    chars, now, ids, n_bytes, matches = chars + now, 0, [], [], []
                if chars >= block_chars:
                    yield from words(index)
                    block, index, chars = block + 1, new_index(), 0
        if ids:
            yield documents(ids, n_bytes, matches)
        yield from words(index)

    return mapped


def _distinct(key: tuple, rows: pa.Table) -> pa.Table:
    """(word, blocks, places) for each distinct word of a bucket: all places that it has in blocks."""
    number: dict[str, int] = {}
    numbers, blocks, places = [], [], []
    if key[0].as_py() < 0:
        for block, sizes, codes, words in zip(*(rows[c].to_pylist() for c in ("block", "sizes", "codes", "words"))):
            text = pa.decompress(words[:-8], decompressed_size=int.from_bytes(words[-8:], "little"), codec="zstd", asbytes=True).decode()
            ends = np.cumsum(unpacked(sizes), dtype=np.int64).tolist()
            numbers.append(np.array([number.setdefault(text[a:b], len(number)) for a, b in zip([0, *ends], ends)], np.int64))
            blocks.append(np.full(len(ends), block))
            places.append(np.cumsum(unpacked(codes), dtype=np.int32))
    if not numbers:
        return pa.table({"word": pa.array([], pa.string()), "blocks": pa.array([], pa.list_(pa.int64())), "places": pa.array([], pa.list_(pa.int32()))})
    of = np.concatenate(numbers)
    order = np.argsort(of, kind="stable")
    edges = pa.array(np.concatenate(([0], np.cumsum(np.bincount(of)))).astype(np.int32))
    return pa.table({"word": pa.array(list(number), pa.string()), "blocks": pa.ListArray.from_arrays(edges, pa.array(np.concatenate(blocks)[order])),
                     "places": pa.ListArray.from_arrays(edges, pa.array(np.concatenate(places)[order]))})


def _packed(blocks: pa.ListArray, places: pa.ListArray, value: pa.ListArray) -> pa.RecordBatch:
    """The values of some words, put together by block."""
    of = np.repeat(np.arange(len(blocks)), np.diff(blocks.offsets.to_numpy()))
    block, place = blocks.flatten().to_numpy(), places.flatten().to_numpy()
    order = np.lexsort((place, block))
    starts, flat = value.offsets.to_numpy()[:-1].astype(np.int64), value.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(value.offsets.to_numpy())
    out = []
    for mine in np.split(order, np.flatnonzero(np.diff(block[order])) + 1) if len(order) else []:
        words = of[mine]
        n = sizes[words].astype(np.int64)
        at = np.repeat(starts[words] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out.append((int(block[mine[0]]), packed(np.diff(place[mine], prepend=0)), packed(n), packed(flat[at])))
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 4, kinds)], ["key", "places", "sizes", "flat"])


def _packed_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    some, held = [], 0

    def rows() -> pa.RecordBatch:
        table = pa.Table.from_batches(some).combine_chunks()
        return _packed(*(table[c].chunk(0) for c in ("blocks", "places", "value")))

    for batch in batches:
        if batch.num_rows:
            some.append(batch)
            held += len(batch.column(0).flatten())
            if held >= PACKED_WORDS:
                yield rows()
                some, held = [], 0
    if some:
        yield rows()


def in_task(value: Callable[[list[str]], pa.ListArray]):
    """For ``over_distinct_words``: the values come from a Python function of some words, in the task that gathers them."""

    def values_of(blocks: DataFrame) -> DataFrame:
        def valued(key: tuple, rows: pa.Table) -> pa.Table:
            words = _distinct(key, rows).combine_chunks()
            parts = [words.slice(at, 20_000).combine_chunks() for at in range(0, len(words), 20_000)]
            return pa.Table.from_batches([_packed(p["blocks"].chunk(0), p["places"].chunk(0), value(p["word"].to_pylist())) for p in parts], _arrow_values)

        return blocks.groupBy("key").applyInArrow(valued, _VALUES)

    return values_of


_arrow_values = pa.schema([("key", pa.int64()), ("places", pa.binary()), ("sizes", pa.binary()), ("flat", pa.binary())])


def in_spark(value: Callable[[Column], Column]):
    """For ``over_distinct_words``: the values are a column expression of the word, array<int>."""

    def values_of(blocks: DataFrame) -> DataFrame:
        words = blocks.groupBy("key").applyInArrow(_distinct, "word string, blocks array<long>, places array<int>")
        return words.select("blocks", "places", value(F.col("word")).alias("value")).mapInArrow(_packed_values, _VALUES)

    return values_of


class Values:
    """The values of a block's words: that of word number i is flat[starts[i]: starts[i] + sizes[i]]."""

    def __init__(self, found: pa.Table):
        parts = [[unpacked(x) for x in found[c].to_pylist()] for c in ("places", "sizes", "flat")]
        places = np.concatenate([np.cumsum(p, dtype=np.int64) for p in parts[0]] or [np.zeros(0, np.int64)])
        sizes = np.concatenate([*parts[1], np.zeros(0, np.int32)]).astype(np.int64)
        self.flat = np.concatenate([*parts[2], np.zeros(0, np.int32)])
        self.starts, self.sizes = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        self.starts[places], self.sizes[places] = np.cumsum(sizes) - sizes, sizes

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of the words one after another, the size of each)."""
        n = self.sizes[words]
        return self.flat[np.repeat(self.starts[words] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n


class Documents:
    """The documents of one row of a block: their ids, lengths in bytes, all their words' numbers and where each one's end."""

    def __init__(self, rows: pa.Table, row: int):
        self.ids, self.n_bytes = rows["doc_ids"][row].values, rows["n_bytes"][row].values
        self.words = unpacked(rows["codes"][row].as_py())
        self.edges = np.concatenate(([0], np.cumsum(unpacked(rows["sizes"][row].as_py()), dtype=np.int64)))


def over_distinct_words(docs: DataFrame, new_index: Callable, values_of: Callable[[DataFrame], DataFrame],
                        assemble: Callable[[Documents, Values], pa.Table], schema: str, buckets: int | None = None,
                        block_chars: int = BLOCK_CHARS, row_chars: int = ROW_CHARS) -> DataFrame:
    """Rows of ``schema`` for the documents (doc_id long, text string, never null), put together from their words' values.

    ``new_index()`` is the index of a block: ``text(text)`` gives the numbers of a text's words as bytes of int32 and
    ``places`` the words in the order of their numbers. ``values_of`` is ``in_spark`` or ``in_task`` of what gives a
    distinct word's value, some whole numbers. ``assemble`` gets the documents of one row and the values of its block.
    There are as many buckets as shuffle partitions, so that a bucket's size is set as that of partitions is.
    """
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one exchange: both uses below read the same shuffle files (a reused exchange), so texts are split once
    blocks = docs.mapInArrow(_blocks(new_index, buckets, block_chars, row_chars), _ROW).repartition("key")
    values = values_of(blocks)

    def together(rows: pa.Table, found: pa.Table) -> pa.Table:
        values = Values(found)
        return pa.concat_tables([assemble(Documents(rows, row), values) for row in range(rows.num_rows) if len(rows["doc_ids"][row].values)] or [nothing])

    nothing = pa.Table.from_batches([], _arrow(docs.sparkSession, schema))
    return blocks.groupBy("key").cogroup(values.groupBy("key")).applyInArrow(together, schema)


def _arrow(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))
