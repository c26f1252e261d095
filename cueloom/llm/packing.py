"""Packing of token pieces into fixed windows by non-negative least squares over the length histogram."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from .staging import stage
from .vocab import default_path, json_tokenizer, rank_encoding, usual

WINDOW = 2048
END_ID = 1
#: Words whose ids a task keeps; further ones are encoded each time: it bounds memory and changes no result.
KEPT_WORDS = 100_000


class _WordIds(dict):
    """Ids of a word with the space before it, as little-endian 32-bit bytes, encoded on first use."""

    def __init__(self, ranks: str):
        super().__init__()
        self.encode = rank_encoding(ranks).encode_ordinary

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.encode(" " + word)).tobytes()
        if len(self) < KEPT_WORDS:
            self[word] = ids
        return ids


@lru_cache(2)
def _specials(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in json_tokenizer(path).get_added_tokens_decoder().values())


def encode(text: str, path: str, ranks: str | None, words_of: _WordIds | None = None) -> bytes:
    """Ids of a whole text as the tokenizers library gives them, little-endian unsigned 32-bit.

    ``ranks`` is a rank file of the same vocabulary, ``words_of`` the words of it that are known already. Where single spaces part the words, no match of the split pattern
    goes beyond a word and the space before it, so that words can be encoded one by one and kept. A text with a special
    string, or with characters outside the blocks of ``vocab``, goes to the tokenizers library whole.
    """
    if ranks is None or not usual(text) or any(s in text for s in _specials(path)):
        return np.array(json_tokenizer(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    encoding = rank_encoding(ranks)
    if not text or "  " in text or text[0] == " " or text[-1] == " ":
        return array("I", encoding.encode_ordinary(text)).tobytes()
    first, *words = text.split(" ")
    words_of = _WordIds(ranks) if words_of is None else words_of
    return array("I", encoding.encode_ordinary(first)).tobytes() + b"".join(map(words_of.__getitem__, words))


def token_pieces(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text",
                 window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens): each document's ids and ``end_id``, cut after every full window.

    ids is binary, little-endian unsigned 32-bit. A null or empty text is one piece with the end id alone; a null id
    stays null; repeated rows are repeated; other columns are ignored. ``ranks`` may name a rank file of the same
    vocabulary as ``tokenizer``, which is faster.
    """
    path = tokenizer or default_path("byte_bpe_50k.json")
    ranks = ranks or (None if tokenizer else default_path("byte_bpe_50k.tiktoken"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long"

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        known = _WordIds(ranks) if ranks else None  # for this task only: workers are used again
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                doc, start, length, ids, total = [], [], [], [], []
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    got = encode(text, path, ranks, known) + end
                    n = len(got) // 4
                    for s in range(0, n, window):
                        piece = got[4 * s: 4 * (s + window)]
                        doc.append(i), start.append(s), length.append(len(piece) // 4), ids.append(piece), total.append(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.array(ids, pa.binary()), pa.array(total, pa.int64())], ["doc_id", "start", "length", "ids", "doc_tokens"])

    return rows.mapInArrow(mapped, schema)


def combinations(present: list[int], window: int, spread: int = 6) -> list[tuple[int, ...]]:
    """Shallow combinations of the present lengths that fill the window exactly: one, two or three pieces."""
    there = set(present)
    found = {(window,)} & {(n,) for n in there}
    for a in present:
        if window - a in there and a >= window - a:
            found.add((a, window - a))
        for part in range(1, spread):
            b = (window - a) * part // spread
            c = window - a - b
            if b in there and c in there:
                found.add(tuple(sorted((a, b, c), reverse=True)))
    return sorted(found, reverse=True)


def least_squares(counts: dict[int, int], combos: list[tuple[int, ...]], sweeps: int = 40) -> list[float]:
    """Repeats x >= 0 that minimise the squared distance of the combinations' lengths from the histogram.

    Coordinate descent: each step sets one repeat to its own minimum, or to zero.
    """
    left = {k: float(v) for k, v in counts.items()}
    columns = [[(n, c.count(n)) for n in set(c)] for c in combos]
    norms = [float(sum(m * m for _, m in col)) for col in columns]
    x = [0.0] * len(combos)
    for _ in range(sweeps):
        moved = 0.0
        for j, col in enumerate(columns):
            step = max(-x[j], sum(m * left[n] for n, m in col) / norms[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for n, m in col:
                    left[n] -= m * step
        if moved < 0.25:
            break
    return x


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ([(length, times in a sequence)], sequences) that use every piece of the histogram exactly once.

    Least-squares repeats are rounded and held to what is left; residual lengths are packed greedily, the largest
    first and then the largest that still fits, each pattern repeated while its lengths last.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    combos = combinations(sorted(left), window)
    patterns = []
    for combo, x in sorted(zip(combos, least_squares(left, combos)), key=lambda p: -p[1]):
        parts = [(n, combo.count(n)) for n in sorted(set(combo), reverse=True)]
        times = min(round(x), min(left[n] // m for n, m in parts))
        if times > 0:
            patterns.append((parts, times))
            for n, m in parts:
                left[n] -= m * times
    lengths = sorted((n for n, c in left.items() if c), reverse=True)
    while lengths:
        space, parts = window, []
        for n in lengths:
            if n <= space:
                m = min(space // n, left[n])
                parts.append((n, m))
                space -= n * m
        times = min(left[n] // m for n, m in parts)
        patterns.append((parts, times))
        for n, m in parts:
            left[n] -= m * times
        lengths = [n for n in lengths if left[n]]
    return patterns


def assign_sequences(pieces: DataFrame, window: int = WINDOW, rows_per_group: int = 20_000) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length at most ``window``, any other columns).

    The histogram has at most ``window`` rows, so the plan is made on the driver; what it sends back is bounded by
    the window too, never by the documents. Pieces of one length are told apart by their rank among that length:
    ranked inside groups of (length, hash), which no frequent length can make large, plus the group's offset. The hash is
    of a number that each staged row has of its own, so that neither null ids nor repeated rows gather in a group, and a
    task that runs again gives the same places. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    columns = pieces.columns
    pieces = stage(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    slots, base, used = [], 0, dict.fromkeys(counts, 0)
    for parts, times in plan(counts, window):
        offset = 0
        for n, m in parts:
            slots.append((n, used[n], used[n] + m * times, m, base, offset))
            used[n] += m * times
            offset += n * m
        base += times
    slot = spark.createDataFrame(slots, "slot_length long, lo long, hi long, each long, base long, first long")
    groups = max(1, math.ceil(total / rows_per_group))
    keyed = pieces.withColumn("_g", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    before = (keyed.groupBy("length", "_g").count()
              .withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)))
              .select("length", "_g", F.coalesce("_before", F.lit(0)).alias("_before")))
    ranked = (keyed.withColumn("_r", F.row_number().over(Window.partitionBy("length", "_g").orderBy("_row")))
              .join(before, ["length", "_g"]).withColumn("_rank", F.col("_before") + F.col("_r") - 1))
    # at most a few rows for each of the window's lengths
    placed = ranked.join(F.broadcast(slot), (F.col("length") == F.col("slot_length")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi")))
    at = F.col("_rank") - F.col("lo")
    return placed.select(
        *[F.col(c) for c in columns],
        (F.col("base") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("first") + F.pmod(at, F.col("each")) * F.col("length")).cast("long").alias("offset"))


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents with their place: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    return assign_sequences(token_pieces(docs, tokenizer))


def packed_digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """As ``pack``, with the CRC-32 of each piece's ids in place of the ids."""
    pieces = token_pieces(docs, tokenizer)
    return assign_sequences(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))


def op4(spark, sf_dir: str) -> DataFrame:
    """Query: packs the whole ``documents`` table."""
    return packed_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
