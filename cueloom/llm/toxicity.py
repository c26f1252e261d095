"""Toxicity by noisy-channel deobfuscation: Viterbi decoding under a character model, then a lexicon of log-odds."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .labels import held_out, training_rows

#: Labelled rows that the lexicon and the curve are fitted on, at most.
SAMPLE = 20_000
#: Entries of the lexicon, at most: those whose log-odds are furthest above zero in standard errors.
ENTRIES = 50_000
#: Least standard errors above zero of an entry.
LEAST_Z = 3.5
#: Strongest distinct words of a document that count.
STRONGEST = 8
THRESHOLD = 0.5
#: Words whose weight, and whose traits, a task keeps; others are looked at each time: it bounds memory and changes no result.
KEPT_WORDS, KEPT_TRAITS = 250_000, 50_000

#: What a character may stand for besides itself.
STANDS_FOR = {"0": "o", "1": "il", "!": "il", "|": "il", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "+": "t", "8": "b", "9": "g"}
#: Costs in nats beside the character model's: a letter for a sign that stands for it, a vowel or another letter for a star, a digit or
#: sign that stays, a separator that goes, one that ends a word (a space, or another), and a letter that goes from a pair
#: of the same, or goes from or stays in a longer row of them.
SUBSTITUTION, VOWEL, CONSONANT, UNCHANGED, SEPARATOR, SPACE, STOP, OF_TWO, OF_MANY, MANY = 1.0, 1.0, 3.0, 4.0, 0.5, 1.5, 4.0, 2.0, 0.3, 1.0
SEPARATORS = " .-_*"
_SIGN = r"[^\W_]|[@$!|+]"
_SPACED = re.compile(rf"(?<![^\W_])(?:{_SIGN})(?:[ .\-_*]{{1,3}}(?:{_SIGN})){{3,}}(?![^\W_])")
_LETTER = re.compile(r"[^\W\d_]")
_SIGNED = re.compile(r"[@$!|+]")
_INSIDE = re.compile(r"[^\W\d_][\W_]*[0134578]+[\W_]*[^\W\d_]")
_DIGIT = re.compile(r"[0134578]")
_ODD = re.compile(r"([^\W\d_])\1\1|[^\W\d_][.\-_*]+[^\W\d_]")
_DOUBLED = re.compile(r"([^\W\d_])\1")
#: Characters that are one letter together.
TOGETHER = {"|\\|": "n"}
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_KINDS = 28


def _kind(char: str) -> int:
    return ord(char) - 96 if "a" <= char <= "z" else 27 if char.isalpha() else 0


_KIND = np.array([_kind(chr(i).lower()[:1]) for i in range(0x3000)], np.uint8)


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of character trigrams, summed over the task's texts: letters, a class for others and one for the rest."""
    total = np.zeros(_KINDS ** 3, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
                kinds = np.where(points < 0x3000, _KIND[np.minimum(points, 0x2FFF)], 27).astype(np.uint16)
                total += np.bincount(kinds[:-2] * 784 + kinds[1:-1] * 28 + kinds[2:], minlength=_KINDS ** 3)
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["code", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """-log P(third | first two) of the characters of all texts, less its mean, [28, 28, 28]; its size does not depend on the input.

    As the mean is taken off, a reading costs no less for being shorter.
    """
    counts = np.full(_KINDS ** 3, 0.5)
    sums = docs.select(F.col("text").cast("string")).mapInArrow(_trigrams, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    for row in sums.collect():
        counts[row["code"]] += row["n"]
    cube = counts.reshape(_KINDS, _KINDS, _KINDS)
    cost = -np.log(cube / cube.sum(axis=2, keepdims=True))
    return cost - (cost * cube).sum() / cube.sum()


def _choices(word: str) -> Iterator[list[tuple[str, float]]]:
    """For each character of a word, the letters that it may be and their costs; "" is none, " " the end of a word."""
    rows = [m.end() - m.start() for m in _ROW.finditer(word) for _ in range(m.end() - m.start())]
    before = ""
    for at, (char, row) in enumerate(zip(word, rows)):
        again = char == before
        if char == "*" and row < 4 and word[:at].rstrip("*")[-1:].isalnum() and word[at:].lstrip("*")[:1].isalnum():  # inside a word
            yield [*((letter, VOWEL if letter in "aeiou" else CONSONANT) for letter in "abcdefghijklmnopqrstuvwxyz"), ("", SEPARATOR)]
        elif char in SEPARATORS:
            yield [("", SEPARATOR), (" ", SPACE if char == " " else STOP)]
        else:
            found = [(char, 0.0)] if char.isalpha() else [*((letter, SUBSTITUTION) for letter in STANDS_FOR.get(char, "")), (char, UNCHANGED)]
            if row > 2:
                found = [(letter, extra + MANY * again) for letter, extra in found]
            if again and (char.isalpha() or row > 2):
                found.append(("", OF_MANY if row > 2 else OF_TWO))
            yield found
        before = char


_ROW = re.compile(r"(.)\1*", re.S)


def decode(word: str, cost) -> str:
    """The likeliest plain words behind an obfuscated one, by Viterbi's algorithm; cost is the model's, as an array or nested lists.

    Each character is kept, replaced by a letter that it may stand for, or dropped if it is a separator or a repetition;
    a separator may also end a word. A state is the last two kinds of characters, so that a step looks at a bounded number
    of states whatever the word's length. Of equal readings the first by state is taken.
    """
    word = word.lower()
    for several, letter in TOGETHER.items():
        word = word.replace(several, letter)
    states: dict[tuple[int, int], tuple[float, object]] = {(0, 0): (0.0, None)}
    for options in _choices(word):
        after: dict[tuple[int, int], tuple[float, object]] = {}
        for (a, b), (so_far, path) in states.items():
            costs = cost[a][b]
            for letter, extra in options:
                kind = _kind(letter) if letter else -1
                if not letter or letter == " " and b == 0:
                    key, total, way = (a, b), so_far + extra, path
                else:
                    # a digit or sign that stays has no cost of its own in the model
                    key, total, way = (b, kind), so_far + extra + (costs[kind] if kind or letter == " " else 0.0), (path, letter)
                if key not in after or total < after[key][0]:
                    after[key] = (total, way)
        states = after
    _, path = min(((so_far + (cost[a][b][0] if b else 0.0), path) for (a, b), (so_far, path) in states.items()), key=lambda x: x[0])
    letters = []
    while path:
        path, letter = path
        letters.append(letter)
    return "".join(reversed(letters)).strip()


def undoubled(word: str, cost) -> str:
    """As ``decode`` for a word of letters without rows of three or more: each pair of equal ones is one where that is likelier.

    Whether a letter of a pair goes changes the costs of three characters only, so that each pair is settled by itself.
    """
    kinds = [0, *map(_kind, word), 0]
    out, at = [], 0
    for m in _DOUBLED.finditer(word):
        x, c, y = kinds[m.start()], kinds[m.start() + 1], kinds[m.end() + 1]
        if cost[x][c][c] + cost[c][c][y] > OF_TWO + cost[x][c][y]:
            out.append(word[at: m.end() - 1])
            at = m.end()
    return "".join(out) + word[at:]


def joined(text: str, cost: np.ndarray) -> str:
    """The text with words spelt apart joined; a row of numbers stays."""
    return _SPACED.sub(lambda m: decode(m[0], cost) if len(_LETTER.findall(m[0])) > 1 else m[0], text)


def is_odd(word: str) -> bool:
    """Whether a word may be obfuscated: it has letters and a sign or digit that may stand for one, repetitions or separators.

    Digits count between letters, or beside three letters or more: 3rd, 10th and mp3 are what they are.
    """
    if _ODD.search(word) or _INSIDE.search(word):
        return True
    letters = len(_LETTER.findall(word))
    return bool(letters and _SIGNED.search(word) or letters > 2 and _DIGIT.search(word))


def restore(text: str, cost: np.ndarray) -> str:
    """The text with words spelt apart joined and every odd word decoded; the others are as they were."""
    text = joined(text, cost)
    return " ".join(decode(w, cost) if is_odd(w) else w for w in text.split())


def traits(word: str) -> list[str]:
    """What a plain word is known by: itself and its beginnings."""
    word = _EDGES.sub("", word)
    return [word, *(f"{word[:n]}-" for n in (4, 5, 6) if len(word) > n)] if len(word) > 2 else []


def readings(low: str, cost: np.ndarray) -> list[str]:
    """Traits of a word as written and, if it is odd or has a doubled letter, as decoded."""
    found = traits(low)
    if is_odd(low):
        found += [t for word in decode(low, cost).split() for t in traits(word) if t not in found]
    elif found and _DOUBLED.search(found[0]):
        plain = undoubled(found[0], cost)
        if plain != found[0]:
            found += [t for t in traits(plain) if t not in found]
    return found


class _Traits(dict):
    """Traits of each word as written and as decoded."""

    def __init__(self, cost: np.ndarray):
        super().__init__()
        self.cost = cost.tolist()

    def __missing__(self, word: str) -> list[str]:
        found = readings(word.lower(), self.cost)
        if len(self) < KEPT_TRAITS:
            self[word] = found
        return found


def _counted(cost: np.ndarray):
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts = _Traits(cost), {}
        known = table.cost
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = joined(text, known)
                for trait in {t for w in set(text.split()) for t in table[w]}:
                    counts.setdefault(trait, [0, 0])[label] += 1
        some = [(t, c[0], c[1]) for t, c in counts.items()]
        for at in range(0, len(some), 50_000):
            names, clean, toxic = zip(*some[at: at + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(clean, pa.int64()), pa.array(toxic, pa.int64())], ["trait", "clean", "toxic"])

    return mapped


@dataclass
class Model:
    """cost: the character model; weights: log-odds of traits; curve: bias, sum of weights, log of the word count."""

    cost: np.ndarray
    weights: dict[str, float]
    curve: tuple[float, float, float]


class _Weights(dict):
    """The largest log-odds of each word's traits, 0 if it has none."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.weights, self.cost = model, model.weights, model.cost.tolist()

    def strongest(self, plain: str) -> float:
        """The largest log-odds among ``traits`` of a word of letters."""
        weight = self.weights.get(plain, 0.0)
        for n in range(4, min(7, len(plain))):
            weight = max(weight, self.weights.get(f"{plain[:n]}-", 0.0))
        return weight

    def __missing__(self, word: str) -> float:
        low = word.lower()
        plain = low.strip(".,;:?\"'()")
        if plain.isalpha() and not _DOUBLED.search(plain):  # most words: neither odd nor doubled
            weight = self.strongest(plain) if len(plain) > 2 else 0.0
        else:
            weight = max((self.weights.get(t, 0.0) for t in readings(low, self.cost)), default=0.0)
        if len(self) < KEPT_WORDS:
            self[word] = weight
        return weight


def evidence(text: str, table: _Weights) -> tuple[float, float]:
    """(sum of the strongest distinct words' log-odds, log of the number of words) of one text."""
    text = joined(text, table.cost)
    words = text.split()
    found = sorted(filter(None, map(table.__getitem__, set(words))), reverse=True)[:STRONGEST]
    return sum(found), math.log1p(len(words))


def _evidence(model: Model):
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Weights(model)
        for batch in batches:
            found = np.array([evidence(t or "", table) for t in batch.column(0).to_pylist()], np.float64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found[:, 0]), pa.array(found[:, 1])], ["label", "strength", "size"])

    return mapped


def _curve(rows: list, rounds: int = 30) -> tuple[float, float, float]:
    """Logistic regression by Newton's method with a small ridge."""
    if not rows:
        return (-2.0, 1.0, 0.0)
    x = np.array([[1.0, r["strength"], r["size"]] for r in rows])
    y = np.array([r["label"] for r in rows], float)
    w = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + 1.0 * w * [0, 1, 1]
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 1.0, 1.0])
        w = w - np.linalg.solve(hessian, gradient)
    return tuple(w.tolist())


def train(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled rows of ``docs`` outside the held-out fold.

    The character model counts every text of ``corpus`` (``docs``). Three quarters of the sample give the lexicon, the
    rest the curve from its evidence to a probability. Without labelled rows every score is the curve's default.
    """
    cost = language_model(docs if corpus is None else corpus)
    rows = training_rows(docs, labels, "toxic", sample)
    first, rest = rows.where("part < 750"), rows.where("part >= 750")
    sums = (first.select("text", "label").mapInArrow(_counted(cost), "trait string, clean long, toxic long")
            .groupBy("trait").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    sizes = {r["label"]: r["count"] for r in first.groupBy("label").count().collect()}
    clean, toxic = sizes.get(0, 0) + 1.0, sizes.get(1, 0) + 1.0
    odds = F.log((F.col("toxic") + 0.5) / toxic) - F.log((F.col("clean") + 0.5) / clean)
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = (sums.where("toxic > 0").select("trait", odds.alias("odds"), (odds / error).alias("z")).where(F.col("z") > LEAST_Z)
            .orderBy(F.desc("z"), "trait").limit(ENTRIES).collect())
    model = Model(cost, {r["trait"]: r["odds"] for r in best}, (-2.0, 1.0, 0.0))
    model.curve = _curve(rest.select("text", "label").mapInArrow(_evidence(model), "label int, strength double, size double").collect())
    return model


def score(docs: DataFrame, model: Model, column: str = "toxicity") -> DataFrame:
    """Adds a column of toxicity, 0 to 1, to every row, in place of any of that name; a null text counts as empty, other columns stay."""
    docs = docs.drop(column)
    bias, slope, length = model.curve
    names = list(docs.columns)
    out = docs.withColumn(column, F.lit(0.0)).schema

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Weights(model)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            found = np.array([evidence(t or "", table) for t in texts], np.float64).reshape(-1, 2)
            scores = 1 / (1 + np.exp(-np.clip(bias + slope * found[:, 0] + length * found[:, 1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*names, column])

    return docs.mapInArrow(mapped, out)


def op7(spark, sf_dir: str) -> DataFrame:
    """Query: toxicity of the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"),
                         (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
