"""SentencePiece encoding and decoding for merge-type vocabularies with byte pieces."""

from __future__ import annotations

import codecs
import hashlib
from array import array
from collections.abc import Callable
from functools import lru_cache, partial
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .bpe import joined_pieces
from .distinct import Documents, Values, in_task, over_distinct_words
from .vocab import default_path

_SPACE = "▁"


class Vocabulary:
    """The pieces of a model: their scores, their ids, and the ids of the 256 bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.order, self.bytes = {}, {}, {}
        self.surfaces: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            surface = b""
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                surface = bytes([int(piece[3:5], 16)])
            elif model.is_unknown(i):
                surface = " ⁇ ".encode()
            elif not (model.is_control(i) or model.is_unused(i)):
                self.ids[piece], self.order[piece] = i, -model.get_score(i)
                surface = piece.replace(_SPACE, " ").encode()
            self.surfaces.append(surface)
        if len(self.bytes) != 256:
            raise ValueError(f"{path}: a vocabulary with all byte pieces is needed")
        byte = np.isin(np.arange(len(self.surfaces)), list(self.bytes.values()))
        #: Whether an id is of a control piece, or unknown; whether it is of a piece that begins with a space.
        self.rare = ~byte & ~np.isin(np.arange(len(self.surfaces)), list(self.ids.values()))
        self.spaced = ~byte & ~self.rare & np.array([s[:1] == b" " for s in self.surfaces])
        #: Whether a space only ever begins a piece, so that no merge goes over the place before one.
        self.spaces_begin = not any(a != _SPACE and b == _SPACE for piece in self.ids for a, b in zip(piece, piece[1:]))

    def units(self, text: str) -> list[str]:
        """The parts of a text, after the model's own changes to spaces, that no merge joins; each begins with a space."""
        changed = _SPACE + text.replace(" ", _SPACE)
        if not self.spaces_begin:
            return [changed]
        found, at = [], 0
        while at < len(changed):
            letters = at
            while letters < len(changed) and changed[letters] == _SPACE:
                letters += 1
            end = changed.find(_SPACE, letters)
            end = len(changed) if end < 0 else end
            found.append(changed[at:end])
            at = end
        return found

    def merged(self, text: str) -> list[str]:
        """The pieces of a text: an agenda of adjacent pairs that form a piece, the best score and then the leftmost first.

        A pair on the agenda is stale if one of its two symbols has since been joined with another.
        """
        order = self.order
        symbols = list(text)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(order[pair], i, pair) for i, pair in enumerate(map("".join, zip(symbols, symbols[1:]))) if pair in order]
        heapify(agenda)
        while agenda:
            _, left, pair = heappop(agenda)
            right = after[left]
            if right >= n or not symbols[left] or symbols[left] + symbols[right] != pair:
                continue
            symbols[left], symbols[right] = pair, ""
            far = after[left] = after[right]
            if far < n:
                before[far] = left
                new = pair + symbols[far]
                if new in order:
                    heappush(agenda, (order[new], left, new))
            near = before[left]
            if near >= 0:
                new = symbols[near] + pair
                if new in order:
                    heappush(agenda, (order[new], near, new))
        return [s for s in symbols if s]

    def encoded(self, text: str) -> list[int]:
        """The ids of a unit; a character that is no piece becomes its bytes."""
        out = []
        for symbol in self.merged(text):
            found = self.ids.get(symbol)
            if found is None:
                out += [self.bytes[b] for b in symbol.encode()]
            else:
                out.append(found)
        return out

    def decoded(self, ids: list[int]) -> str:
        """The text of ids with control or unknown ones among them: these end a run of bytes."""
        out, run, begun = [], b"", False
        for i in ids:
            if self.rare[i]:
                out.append(_text(run))
                run = b""
                out.append(self.surfaces[i].decode())
            else:
                run += self.surfaces[i][1:] if not begun and self.spaced[i] else self.surfaces[i]
            begun = begun or bool(self.surfaces[i])
        return "".join(out) + _text(run)


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Index(dict):
    """Numbers of the distinct units of a block; of a word without spaces, its number."""

    def __init__(self, path: str):
        super().__init__()
        self.places: dict[str, int] = {}
        self.vocabulary = vocabulary(path)

    def __missing__(self, word: str) -> int:
        unit = _SPACE + word
        found = self[word] = self.places.setdefault(unit, len(self.places))
        return found

    def text(self, text: str) -> bytes:
        if not text:
            return b""
        if "  " in text or _SPACE in text or text[0] == " " or text[-1] == " " or not self.vocabulary.spaces_begin:
            return array("i", [self.places.setdefault(u, len(self.places)) for u in self.vocabulary.units(text)]).tobytes()
        return array("i", map(self.__getitem__, text.split(" "))).tobytes()


def _checked_ids(path: str):
    def value(units: list[str]) -> pa.ListArray:
        """The ids of some distinct units, by the agenda; the library has to give the same ones."""
        own = vocabulary(path)
        ids = [own.encoded(u) for u in units]
        library = own.library.encode([u[1:].replace(_SPACE, " ") for u in units], num_threads=1)
        for unit, mine, known in zip(units, ids, library):
            if mine != known and unit != _SPACE:  # the library gives nothing for an empty text
                raise ValueError(f"the agenda and the library differ on {unit[:100]!r}: {mine[:20]}, {known[:20]}")
        edges = np.concatenate(([0], np.cumsum([len(i) for i in ids])))
        return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(edges[-1]))))

    return value


def _assembled(finish: Callable[[pa.Table], pa.Table] | None):
    def assemble(docs: Documents, values: Values) -> pa.Table:
        ids, n = values.of(docs.words)
        ends = np.concatenate(([0], np.cumsum(n)))[docs.edges]
        encoded = pa.table({"doc_id": docs.ids, "ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))})
        return finish(encoded) if finish else encoded

    return assemble


def _encoded(docs: DataFrame, path: str, finish: Callable[[pa.Table], pa.Table] | None, schema: str, id_col: str, text_col: str, **blocks: int) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return over_distinct_words(rows, partial(_Index, path), in_task(_checked_ids(path)), _assembled(finish), schema, **blocks)


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", **blocks: int) -> DataFrame:
    """(doc_id, ids array<int>) for every row of ``docs``, as the sentencepiece library encodes, without begin or end ids.

    Each distinct unit of the corpus, a word with the spaces before it, is merged once and checked against the library,
    in the Arrow batch that holds it; the job stops if they differ. Documents are put together from their units' ids (see
    ``distinct``, also for ``blocks``). A null or empty text has no ids, a null id stays null, repeated rows are
    repeated, other columns are ignored, an empty table gives an empty result.
    """
    return _encoded(docs, model or default_path("piece_bpe_32k.model"), None, "doc_id long, ids array<int>", id_col, text_col, **blocks)


def _bytewise(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("cueloom-bytewise", _bytewise)


@lru_cache(2)
def _surfaces(path: str) -> pa.Array:
    return pa.array(vocabulary(path).surfaces, pa.large_binary())


def _text(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode(errors="cueloom-bytewise")


def decoded_texts(ids: pa.ListArray, path: str) -> list[str]:
    """The text of each list of ids: its pieces' text and bytes, without the space that encoding puts first."""
    own = vocabulary(path)
    edges, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
    rare = np.concatenate(([0], np.cumsum(own.rare[flat])))[edges]
    out = []
    for text, begin, end, odd in zip(joined_pieces(ids, _surfaces(path)).to_pylist(), edges[:-1].tolist(), edges[1:].tolist(), (np.diff(rare) > 0).tolist()):
        if odd:
            out.append(own.decoded(flat[begin:end].tolist()))
        else:
            out.append(_text(text[1:] if begin < end and own.spaced[flat[begin]] else text))
    return out


def decode(ids: Column | str, model: str | None = None) -> Column:
    """The text of an array of ids, as the library decodes it: bytes that form no character become U+FFFD. A null array gives null."""
    path = model or default_path("piece_bpe_32k.model")

    @F.arrow_udf("string")
    def decoded(lists: pa.Array) -> pa.Array:
        filled = pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), pa.array(np.cumsum(lists.value_lengths().fill_null(0).to_numpy()).astype(np.int32))]), lists.flatten())
        return pa.array([t if valid else None for t, valid in zip(decoded_texts(filled, path), lists.is_valid().to_pylist())], pa.string())

    return decoded(ids)


def _digests(path: str):
    def finish(encoded: pa.Table) -> pa.Table:
        """Digests of each document's ids and of their text."""
        ids = encoded["ids"].chunk(0)
        numbers = pa.array([f"{i},".encode() for i in range(len(_surfaces(path)))], pa.large_binary())
        sha = lambda texts: pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
        return pa.table({"doc_id": encoded["doc_id"], "n_tokens": pa.array(np.diff(ids.offsets.to_numpy()).astype(np.int64)),
                         "ids_sha256": sha(t[:-1] for t in joined_pieces(ids, numbers).to_pylist()),
                         "decoded_sha256": sha(t.encode() for t in decoded_texts(ids, path))})

    return finish


def op12(spark, sf_dir: str) -> DataFrame:
    """Query: encodes the whole ``documents`` table, decodes the ids and gives digests of both."""
    path = default_path("piece_bpe_32k.model")
    return _encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, _digests(path),
                    "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", "doc_id", "text")
