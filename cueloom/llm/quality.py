"""Quality by nearest neighbours among labelled latent-semantic vectors."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .labels import held_out, training_rows

#: Labelled rows whose vectors are broadcast, at most: 6,000 vectors of 32 single-precision numbers are 0.8 MB.
SAMPLE = 6_000
DIMENSIONS = 32
NEIGHBOURS = 25
#: A neighbour's vote is its cosine to this power.
SHARPNESS = 8
THRESHOLD = 0.3
#: Words of one stretch of text whose repetition is measured.
STRETCH = 100

_CLASSES = 10
_CLASS = np.full(256, 9, np.uint8)
for _chars, _class in ((range(97, 123), 0), (range(128, 256), 0), (range(65, 91), 1), (range(48, 58), 2), (b" \t", 3),
                       (b"\n\r", 4), (b".,;:", 5), (b"!?", 6), (b"%#$&*@~^+", 7), (b"|/\\_=<>{}[]", 8)):
    for _char in _chars:
        _CLASS[_char] = _class
_TABLE = _CLASS.tobytes()
TERMS = _CLASSES ** 3 + 5


def terms(text: str) -> np.ndarray:
    """The weights of one text's terms: trigrams of character classes, and five shares of repetition."""
    out = np.zeros(TERMS, np.float32)
    classes = np.frombuffer(text.encode().translate(_TABLE), np.uint8)
    if len(classes) < 3:
        return out
    counts = np.zeros(_CLASSES ** 3, np.int64)
    for at in range(0, len(classes), 1 << 20):
        c = classes[at: at + (1 << 20) + 2].astype(np.uint16)
        if len(c) > 2:
            counts += np.bincount(c[:-2] * 100 + c[1:-1] * 10 + c[2:], minlength=len(counts))
    out[: len(counts)] = np.sqrt(counts / counts.sum())
    words = text.split()
    n = max(1, len(words))
    distinct = [len(set(words[at: at + STRETCH])) / len(words[at: at + STRETCH]) for at in range(0, len(words), STRETCH)] or [1.0]
    lines = [line for line in text.split("\n") if line]
    out[-5:] = np.sqrt([
        sum(map(eq, words, words[1:])) / n,
        1 - sum(distinct) / len(distinct),
        1 - min(distinct),
        1 - len(set(lines)) / max(1, len(lines)),
        Counter(words).most_common(1)[0][1] / n if words else 0.0])
    return out


def _matrix(texts: list) -> np.ndarray:
    return np.stack([terms(t or "") for t in texts]) if texts else np.zeros((0, TERMS), np.float32)


@dataclass
class Model:
    """idf and basis turn terms into latent vectors; vectors and labels are those of the sample; base is their mean label."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    base: float


def _latent(x: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    y = (x * idf) @ basis
    return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)


def _collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = _matrix(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), batch.column(1)], ["terms", "label"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Latent vectors of at most ``sample`` labelled rows outside the held-out fold, by truncated SVD of their terms."""
    rows = (training_rows(docs, labels, "quality", sample).select("text", "label")
            .mapInArrow(_collected, "terms binary, label int").collect())
    if not rows:
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, DIMENSIONS), np.float32),
                     np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, np.float32), 0.5)
    x = np.stack([np.frombuffer(r["terms"], np.float32) for r in rows])
    y = np.array([r["label"] for r in rows], np.float32)
    order = np.lexsort((y, *x[:, -5:].T))  # the rows' order is not fixed; the model's is
    x, y = x[order], y[order]
    idf = np.log1p(len(x) / (1 + (x > 0).sum(axis=0))).astype(np.float32)
    idf[-5:] = 1.0
    rng = np.random.default_rng(0)
    weighted = x * idf
    q = rng.standard_normal((TERMS, DIMENSIONS + 8)).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(weighted.T @ (weighted @ q))
    _, _, vt = np.linalg.svd(weighted @ q, full_matrices=False)
    basis = (q @ vt.T)[:, :DIMENSIONS].astype(np.float32)
    return Model(idf, basis, _latent(x, idf, basis).astype(np.float32), y, float(y.mean()))


def vote(latent: np.ndarray, model: Model, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Mean label of each row's nearest sample vectors by exact cosine, weighted by its power; the base where none is near."""
    k = min(neighbours, len(model.labels))
    out = np.full(len(latent), model.base)
    for at in range(0, len(latent) if k else 0, 512):
        cosine = latent[at: at + 512] @ model.vectors.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** SHARPNESS
        total = weight.sum(axis=1)
        mean = (weight * model.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
        out[at: at + 512] = np.where(total > 1e-9, mean, model.base)
    return np.clip(out, 0.0, 1.0)


def score(docs: DataFrame, model: Model, column: str = "quality") -> DataFrame:
    """Adds a column of quality, 0 to 1, to every row, in place of any of that name; a null text counts as empty, other columns stay."""
    docs = docs.drop(column)
    names = list(docs.columns)
    out = docs.withColumn(column, F.lit(0.0)).schema

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                x = _matrix(batch.column(batch.schema.get_field_index("text")).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(vote(_latent(x, model.idf, model.basis), model))], [*names, column])

    return docs.mapInArrow(mapped, out)


def op8(spark, sf_dir: str) -> DataFrame:
    """Query: quality of the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality").alias("score"),
                         (F.col("quality") >= THRESHOLD).cast("int").alias("predicted"))
