"""Token counts by prefix dynamic programming."""

from __future__ import annotations

import re
from array import array
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .distinct import Documents, Values, in_task, over_distinct_words
from .vocab import default_path

LIMIT = 4096
_SPACE = "▁"


class Merges:
    """The merges of a sentencepiece BPE model: two neighbours join where their text is a piece, the best score first.

    Characters that are no piece fall back to their bytes; such a character joins with nothing.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size())
                 if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        #: Lengths of the pieces that end in the same two characters, the longest first.
        tails: dict[str, set[int]] = {}
        for piece in self.score:
            tails.setdefault(piece[-2:], set()).add(len(piece))
        self.lengths = {tail: sorted(found, reverse=True) for tail, found in tails.items()}
        self.wholes: dict[str, bool] = {}
        self.fits: dict[tuple[str, str], bool] = {}

    def segment(self, text: str) -> list[str]:
        """Merges one by one, the best score and then the leftmost first; only for texts of two pieces."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, left: str, right: str) -> bool:
        """Whether the encoding of the two pieces' text is just these two."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= 1_000_000:
                self.fits.clear()
            known = self.fits[left, right] = self.segment(left + right) == [left, right]
        return known

    def prefixes(self, unit: str) -> list[int]:
        """The exact token count of every prefix of a text, the empty one included.

        The encoding of a prefix ends in one piece, before which stands the encoding of a shorter prefix: the longest
        piece that may follow that one's last. Each prefix is settled from earlier ones, in time linear in the text.
        """
        counts, last = [0], [""]
        score, lengths, fits, none = self.score, self.lengths, self.fits, ()
        for end in range(1, len(unit) + 1):
            for size in (*lengths.get(unit[end - 2: end], none), 1) if end > 1 else (1,):
                begin = end - size
                if begin < 0:
                    continue
                piece, before = unit[begin:end], last[begin]
                if piece in score and (size == 1 or self.whole(piece)) and (
                        not before or (fits[before, piece] if (before, piece) in fits else self.follows(before, piece))):
                    counts.append(counts[begin] + 1), last.append(piece)
                    break
            else:
                counts.append(counts[end - 1] + len(unit[end - 1].encode())), last.append("")
        return counts

    def whole(self, piece: str) -> bool:
        """Whether the encoding of a piece's own text is that piece."""
        known = self.wholes.get(piece)
        if known is None:
            known = self.wholes[piece] = self.segment(piece) == [piece]
        return known


@lru_cache(2)
def merges(path: str) -> Merges:
    return Merges(path)


@lru_cache(2)
def _units(path: str):
    """Finds the units of a text, after the model's own changes to spaces: no piece of the model goes beyond a unit.

    Units end before spaces, and where letters and other characters meet, as far as no piece holds two such neighbours.
    """
    inside = {a + b for piece in merges(path).score for a, b in zip(piece, piece[1:])}
    letter = re.compile(r"[^\W\d_]")
    kinds = {("letter" if letter.match(a) else "space" if a == _SPACE else "other", "letter" if letter.match(b) else "space" if b == _SPACE else "other") for a, b in inside}
    if ("letter", "space") in kinds or ("other", "space") in kinds:
        return lambda text: [text]
    if ("letter", "other") in kinds or ("other", "letter") in kinds:
        return re.compile(f"{_SPACE}+[^{_SPACE}]*|[^{_SPACE}]+").findall
    return re.compile(rf"{_SPACE}*[^\W\d_]+|{_SPACE}*(?:[\W\d_](?<!{_SPACE}))+|{_SPACE}+").findall


class _Index(dict):
    """Numbers of the distinct units, and for every word with the space before it those of its units."""

    def __init__(self, path: str):
        super().__init__()
        self.places: dict[str, int] = {}
        self.units = _units(path)

    def of(self, units: list[str]) -> bytes:
        return array("i", [self.places.setdefault(u, len(self.places)) for u in units]).tobytes()

    def __missing__(self, word: str) -> bytes:
        found = self[word] = self.of(self.units(_SPACE + word))
        return found

    def text(self, text: str) -> bytes:
        if not text:
            return b""
        if "  " in text or _SPACE in text or text[0] == " " or text[-1] == " ":
            return self.of(self.units(_SPACE + text.replace(" ", _SPACE)))
        return b"".join(map(self.__getitem__, text.split(" ")))


def _prefix_values(path: str):
    def value(units: list[str]) -> pa.ListArray:
        """The token counts of each unit's prefixes, from one character on."""
        counts = [merges(path).prefixes(u)[1:] for u in units]
        edges = np.concatenate(([0], np.cumsum([len(c) for c in counts])))
        return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(np.fromiter(chain.from_iterable(counts), np.int32, int(edges[-1]))))

    return value


class Prefixes:
    """The prefix table of some documents: counts[i] is the token count up to the i-th character of all of them.

    The space that the model puts before a text is the first character of each document's part.
    """

    def __init__(self, docs: Documents, values: Values):
        within, n = values.of(docs.words)
        unit_ends = np.cumsum(n)
        totals = np.cumsum(within[unit_ends - 1], dtype=np.int64)  # at the end of each unit, over all documents
        before = np.concatenate(([0], totals))
        self.edges = np.concatenate(([0], unit_ends))[docs.edges]
        base = before[docs.edges]
        self.totals = np.diff(base)
        units = np.diff(docs.edges)
        self.counts = within + np.repeat(before[:-1] - np.repeat(base[:-1], units), n)

    def fitting(self, budget: int) -> np.ndarray:
        """Characters of each document's longest prefix within the budget."""
        place = np.arange(len(self.counts))
        fits = np.where(self.counts <= budget, place, -1)
        last = np.maximum.reduceat(np.append(fits, -1), self.edges[:-1])
        return np.where((np.diff(self.edges) > 0) & (last >= self.edges[:-1]), last - self.edges[:-1], 0)


def _counted(table: bool, budget: int):
    def assemble(docs: Documents, values: Values) -> pa.Table:
        prefixes = Prefixes(docs, values)
        columns = {"doc_id": docs.ids, "n_bytes": docs.n_bytes, "n_tokens": pa.array(prefixes.totals),
                   "fitting_chars": pa.array(prefixes.fitting(budget))}
        if table:
            keep = np.ones(len(prefixes.counts), bool)
            keep[prefixes.edges[:-1][np.diff(prefixes.edges) > 0]] = False  # the space before each text
            edges = np.concatenate(([0], np.cumsum(keep)))[prefixes.edges]
            columns["counts"] = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(prefixes.counts[keep].astype(np.int32)))
        return pa.table(columns)

    return assemble


def prefix_counts(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", table: bool = True,
                  budget: int = LIMIT, **blocks: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, fitting_chars, counts) for every row of ``docs``.

    counts[k] is the exact token count of the prefix of k + 1 characters, inside words as well; it is absent if ``table``
    is false. n_tokens is its last number, and fitting_chars the characters of the longest prefix of at most ``budget``
    tokens, both read from the same table. The counts of each distinct unit's prefixes are found once for all documents
    (see ``distinct``, also for ``blocks``) and added up. A null or empty text has no tokens, a null id stays null,
    repeated rows are repeated, other columns are ignored, an empty table gives an empty result.
    """
    path = model or default_path("piece_bpe_32k.model")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = "doc_id long, n_bytes long, n_tokens long, fitting_chars long" + (", counts array<int>" if table else "")
    return over_distinct_words(rows, partial(_Index, path), in_task(_prefix_values(path)), _counted(table, budget), schema, **blocks)


def fitting_chars(budget: int | Column, counts: Column | str = "counts") -> Column:
    """Characters of the longest prefix within a token budget, from the table alone; a longer prefix may have fewer tokens."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    return F.coalesce(F.array_max(F.transform(counts, lambda count, at: F.when(count <= budget, at + 1))), F.lit(0))


def op6(spark, sf_dir: str) -> DataFrame:
    """Query: token counts of the whole ``documents`` table, and how much of each text is within the limit."""
    counted = prefix_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), table=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "fitting_chars")
