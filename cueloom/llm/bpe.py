"""Byte-level BPE as higher-order functions over the distinct words of a whole corpus."""

from __future__ import annotations

import hashlib
import random
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as compute
from pyspark.sql import Column, DataFrame, functions as F

from .distinct import Documents, Values, in_spark, over_distinct_words
from .vocab import default_path, pieces_of, ranks, usual, usual_pieces

#: The fold looks at all pairs for every merge, so that its time grows with the square of a word. Longer matches of the
#: split pattern (junk without spaces) are folded in parts of so many bytes, whose seams are then mended.
FOLD_BYTES = 128
#: Marks the number of a part that goes on with the match of the part before it.
_GOES_ON = 1 << 30
_GROUPS, _CELLS = 1 << 15, 1 << 18
#: An id that no pair holds; it stands before and after every word.
_EDGE = 65_535
#: Values from here on are no ranks.
_NONE = 1 << 17
_RAISED = 1 << 60


@lru_cache(2)
def merge_tables(path: str) -> tuple[int, list[int], list[int]]:
    """(factor, shift, cells): a perfect hash of the pairs of ids that merge; see ``merged_ids`` for the lookup.

    A pair of ids merges when their bytes joined are in the vocabulary; the merged id is the pair's rank too. A pair's
    key is left * 65536 + right; a cell holds key * 131072 + rank. Bits of key * factor name a group and a place; the
    pairs of a group share a shift of their places under which all of them get cells of their own.
    """
    vocabulary = ranks(path)
    pairs = {}
    for token, rank in vocabulary.items():
        for cut in range(1, len(token)):
            left, right = vocabulary.get(token[:cut]), vocabulary.get(token[cut:])
            if left is not None and right is not None:
                pairs[(left << 16) + right] = rank
    rng = random.Random(0)
    while True:
        factor = rng.randrange(1 << 28, 1 << 30) | 1
        if len({(key * factor) >> 12 & (1 << 33) - 1 for key in pairs}) == len(pairs):
            break
    groups: dict[int, list[tuple[int, int]]] = {}
    for key in pairs:
        groups.setdefault(key * factor >> 12 & _GROUPS - 1, []).append((key * factor >> 27 & _CELLS - 1, key))
    shift, cells = [0] * _GROUPS, [-1] * _CELLS
    for group, members in sorted(groups.items(), key=lambda kv: -len(kv[1])):
        while True:
            by = rng.randrange(_CELLS)
            places = [(place + by) & (_CELLS - 1) for place, _ in members]
            if all(cells[c] < 0 for c in places):
                break
        shift[group] = by
        for c, (_, key) in zip(places, members):
            cells[c] = (key << 17) + pairs[key]
    return factor, shift, [c if c >= 0 else (_EDGE << 33) + (_EDGE << 17) for c in cells]


def _literal(values: list[int]) -> Column:
    """A literal array: the string is parsed once, when the plan is made."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def merged_ids(word: Column, path: str) -> Column:
    """Ids of one word, given as the ids (long) of its single bytes: folds merges, lowest rank and then leftmost first.

    The state alternates ids, raised by ``_RAISED``, and the values of neighbouring pairs: a pair's rank, or a number
    from ``_NONE`` on if it doesn't merge; an edge stands at either side. The least number of the state is thus the rank
    to merge. A merge puts the new id and the values of the two pairs that it is now in for five numbers.
    """
    factor, shift, cells = merge_tables(path)
    # the literal is bound once by a function of one element: in the plan, and in what it costs the driver, it counts once
    tables = F.array(F.struct(_literal(shift).alias("shift"), _literal(cells).alias("cells")))
    return F.get(F.transform(tables, lambda t: _fold(word, factor, t["shift"], t["cells"])), 0)


def _fold(word: Column, factor: int, shift: Column, cells: Column) -> Column:
    def value(key: Column) -> Column:
        """The cell's key and the pair's cancel out, which leaves the rank; other pairs leave a large number."""
        group = F.shiftright(key * factor, 12).bitwiseAND(_GROUPS - 1)
        place = (F.shiftright(key * factor, 27) + F.get(shift, group)).bitwiseAND(_CELLS - 1)
        return F.get(cells, place).bitwiseXOR(F.shiftleft(key, 17))

    def step(state: Column, _: Column) -> Column:
        def merged(at: Column) -> Column:
            new = F.get(state, at - 1)
            around = F.array((F.get(state, at - 4) - _RAISED) * 65_536 + new, new + _RAISED,
                             new * 65_536 + (F.get(state, at + 2) - _RAISED))
            return F.when(new >= _NONE, state).otherwise(F.concat(
                F.slice(state, 1, at - 3),
                F.transform(around, lambda x: F.when(x < _RAISED, value(x)).otherwise(x)),
                F.slice(state, at + 3, 3 * FOLD_BYTES)))

        lowest = F.array_position(state, F.array_min(state)).cast("int")
        return F.get(F.transform(F.array(lowest), merged), 0)

    edge = F.array(F.lit(_EDGE).cast("bigint"))
    pairs = F.zip_with(F.concat(edge, word), F.concat(word, edge), lambda left, right: F.array(
        left + _RAISED, value(left * 65_536 + right)))
    start = F.concat(F.flatten(pairs), F.transform(edge, lambda x: x + _RAISED))
    return F.aggregate(F.slice(word, 2, FOLD_BYTES), start, step, lambda state: F.transform(
        F.filter(F.slice(state, 2, 3 * FOLD_BYTES), lambda x: (x >= _RAISED) & (x < _RAISED + _EDGE)), lambda x: (x - _RAISED).cast("int")))


class _Index(dict):
    """Numbers of the distinct matches of the split pattern, and for every word with the space before it those of its matches.

    A match is known by a string with one character, U+0000 to U+00FF, for each of its bytes.
    """

    def __init__(self):
        super().__init__()
        self.places: dict[str, int] = {}

    def of(self, pieces: list[str]) -> bytes:
        places, out = self.places, []
        for piece in pieces:
            coded = piece if piece.isascii() else piece.encode().decode("latin-1")
            out.append(places.setdefault(coded[:FOLD_BYTES], len(places)))
            for at in range(FOLD_BYTES, len(coded), FOLD_BYTES):
                out.append(places.setdefault(coded[at: at + FOLD_BYTES], len(places)) | _GOES_ON)
        return array("i", out).tobytes()

    def __missing__(self, word: str) -> bytes:
        if word.isalpha() and word.isascii() and len(word) < FOLD_BYTES:
            found = self.places.setdefault(" " + word, len(self.places)).to_bytes(4, "little")
        else:
            found = self.of(usual_pieces(" " + word))
        self[word] = found
        return found

    def text(self, text: str) -> bytes:
        """Numbers of all matches of a text. Where single spaces part the words, no match goes beyond a word."""
        if not text or "  " in text or text[0] == " " or text[-1] == " " or not usual(text):
            return self.of(pieces_of(text))
        first, *words = text.split(" ")
        return self.of(pieces_of(first)) + b"".join(map(self.__getitem__, words))


def _single(path: str) -> list[int]:
    vocabulary = ranks(path)
    return [vocabulary[bytes([b])] for b in range(256)]


def _folded(path: str) -> Callable[[Column], Column]:
    single = _literal(_single(path))
    return lambda word: merged_ids(F.transform(F.split(word, ""), lambda c: F.get(single, F.ascii(c))), path)


class Seams:
    """Mends the ids where the parts of one long match meet.

    Ids are an encoding if and only if every two neighbours are the encoding of their own joined bytes. So a seam is
    done if the two ids at it pass that test; else as many ids around it as are needed are merged anew.
    """

    def __init__(self, path: str):
        self.rank = ranks(path)
        self.bytes = {r: t for t, r in self.rank.items()}
        self.known: dict[tuple[int, int], bool] = {}

    def merged(self, text: bytes) -> list[int]:
        parts = [text[i: i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best, at = min((self.rank.get(a + b, _NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == _NONE:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        found = self.known.get((left, right))
        if found is None:
            found = self.known[left, right] = self.merged(self.bytes[left] + self.bytes[right]) == [left, right]
        return found

    def extend(self, left: list[int], right: list[int]) -> None:
        """Puts the ids of the next part behind those so far."""
        around = 1
        if not left or not right or self.fits(left[-1], right[0]):
            left += right
            return
        while True:
            middle = self.merged(b"".join(map(self.bytes.__getitem__, left[-around:] + right[:around])))
            before, after = left[-around - 1: -around], right[around: around + 1]
            if (not before or self.fits(before[0], middle[0])) and (not after or self.fits(middle[-1], after[0])):
                left[-around:] = middle
                left += right[around:]
                return
            around *= 2


def _assembled(path: str, finish: Callable[[pa.Table], pa.Table] | None = None):
    def assemble(docs: Documents, values: Values) -> pa.Table:
        goes_on = (docs.words & _GOES_ON) != 0
        ids, n = values.of(docs.words & (_GOES_ON - 1))
        after = np.concatenate(([0], np.cumsum(n)))
        ends = after[docs.edges]
        if goes_on.any():
            ids, ends = _mended(ids, ends, after, goes_on, Seams(path))
        encoded = pa.table({"doc_id": docs.ids, "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))})
        return finish(encoded) if finish else encoded

    return assemble


def _mended(ids: np.ndarray, ends: np.ndarray, after: np.ndarray, goes_on: np.ndarray, seams: Seams) -> tuple[np.ndarray, np.ndarray]:
    """The ids and where the documents end in them, after the parts of every long match are joined."""
    out, at, gone = [], 0, np.zeros(len(ids) + 1, np.int64)
    parts = np.flatnonzero(goes_on)
    lasts = parts[np.append(np.diff(parts) > 1, True)]
    firsts = parts[np.append(True, np.diff(parts) > 1)] - 1
    for first, last in zip(firsts.tolist(), lasts.tolist()):
        begin, end = int(after[first]), int(after[last + 1])
        whole: list[int] = []
        for k in range(first, last + 1):
            seams.extend(whole, ids[after[k]: after[k + 1]].tolist())
        out += [ids[at:begin], np.array(whole, np.int32)]
        gone[end] += end - begin - len(whole)
        at = end
    out.append(ids[at:])
    return np.concatenate(out), ends - np.cumsum(gone)[ends]


def encode(docs: DataFrame, rank_file: str | None = None, id_col: str = "doc_id", text_col: str = "text",
           **blocks: int) -> DataFrame:
    """(doc_id, ids array<int>) for every row of ``docs``, as the tiktoken library encodes without special tokens.

    Each match of the split pattern that occurs anywhere in ``docs`` has its merges folded once, by Spark; documents'
    ids are put together from their matches' ids (see ``distinct``). A null or empty text has no ids, a null id stays
    null, repeated rows are repeated, other columns are ignored, an empty table gives an empty result.
    ``blocks`` may set the sizes of ``over_distinct_words``.
    """
    path = rank_file or default_path("byte_bpe_multi_50k.tiktoken")
    return _encoded(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), path, None, "doc_id long, ids array<int>", **blocks)


def _encoded(docs: DataFrame, path: str, finish: Callable[[pa.Table], pa.Table] | None, schema: str, **blocks: int) -> DataFrame:
    """The encoded documents, or what ``finish`` makes of some of them at a time, in the task that encodes them."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return over_distinct_words(rows, _Index, in_spark(_folded(path)), _assembled(path, finish), schema, **blocks)


@lru_cache(2)
def _pieces(path: str) -> pa.Array:
    by_rank = {r: t for t, r in ranks(path).items()}
    return pa.array([by_rank.get(i, b"") for i in range(max(by_rank) + 1)], pa.large_binary())


def joined_pieces(ids: pa.ListArray, pieces: pa.Array) -> pa.Array:
    """The binary pieces of each list of ids, concatenated: taken one after another they lie so in memory already."""
    edges = ids.offsets.to_numpy()
    taken = pieces.take(ids.values.slice(edges[0], edges[-1] - edges[0]))
    offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset: taken.offset + len(taken) + 1]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(offsets[edges - edges[0]].tobytes()), taken.buffers()[2]])


def decode(ids: Column | str, rank_file: str | None = None) -> Column:
    """The bytes of an array of ids: its binary pieces, concatenated. A null array gives null."""
    path = rank_file or default_path("byte_bpe_multi_50k.tiktoken")

    @F.arrow_udf("binary")
    def decoded(lists: pa.Array) -> pa.Array:
        whole = joined_pieces(lists, _pieces(path)).cast(pa.binary())
        return compute.if_else(lists.is_valid(), whole, pa.scalar(None, pa.binary()))

    return decoded(ids)


def _digests(path: str):
    def finish(encoded: pa.Table) -> pa.Table:
        """Digests of each document's ids and of its ids' bytes."""
        ids, pieces = encoded["ids"].chunk(0), _pieces(path)
        numbers = pa.array([f"{i},".encode() for i in range(len(pieces))], pa.large_binary())
        sha = lambda texts: pa.array([hashlib.sha256(t).hexdigest() for t in texts])
        return pa.table({"doc_id": encoded["doc_id"], "n_tokens": pa.array(np.diff(ids.offsets.to_numpy()).astype(np.int64)),
                         "ids_sha256": sha(t[:-1] for t in joined_pieces(ids, numbers).to_pylist()),
                         "decoded_sha256": sha(joined_pieces(ids, pieces).to_pylist())})

    return finish


def op5(spark, sf_dir: str) -> DataFrame:
    """Query: encodes the whole ``documents`` table, decodes the ids and gives digests of both."""
    return _encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), path := default_path("byte_bpe_multi_50k.tiktoken"), _digests(path),
                    "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
