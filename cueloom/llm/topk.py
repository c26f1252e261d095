"""Exact top-k by inner product: pivot tables bound every candidate, which are evaluated in bound order until exact."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from .staging import stage

TOP = 5
PIVOTS = 32
#: Rows of the sample from which the pivots are chosen, at most.
PIVOT_SAMPLE = 2_000
#: Candidates of a block and queries that meet one at a time, about. A block is sent once for each so many queries.
CANDIDATES, QUERIES = 32_768, 32_768
#: Candidates that a query evaluates between two looks at the stopping rule.
BATCH = 256


def quantised(vector: str = "embedding"):
    """floor(256 * x) of each component in double precision, as longs."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long"))


def _whole(vector: str = "embedding"):
    """Whether a vector is not null, not empty, and holds neither nulls nor non-finite numbers."""
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def choose_pivots(rows: DataFrame, pivots: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> dict[int, np.ndarray]:
    """By vector length, the pivots: farthest-first over the ``sample`` rows with the smallest hashes; bounded."""
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("q").collect()
    by_size: dict[int, list] = {}
    for row in some:
        by_size.setdefault(len(row["q"]), []).append(row["q"])
    out = {}
    for d, vectors in by_size.items():
        x = np.array(vectors, np.float64).reshape(len(vectors), d)
        chosen, far = [0], ((x - x[0]) ** 2).sum(axis=1)
        while len(chosen) < min(pivots, len(x)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        out[d] = x[chosen]
    return out


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (x ** 2).sum(axis=1)[:, None] + (pivots ** 2).sum(axis=1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def best_of(queries: np.ndarray, query_ids: np.ndarray, query_table: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, row_table: np.ndarray,
            top: int, floor: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the query, vec_ids, scores): each query's ``top`` rows but those with its id, exact, ties to the smaller id.

    The tables hold distances to the pivots. A row is at least max |d(query, pivot) - d(row, pivot)| away, so that its
    inner product is at most (|query|^2 + |row|^2 - that^2) / 2. Rows are taken by falling bound; a query stops when the
    next bound is below its last kept score, or below ``floor``, a score that it has ``top`` rows for elsewhere.
    """
    squares = (rows ** 2).sum(axis=1)
    for at in range(len(queries)):
        bound = _bound(queries[at], query_table[at], squares, row_table, row_table)
        bound[row_ids == query_ids[at]] = -np.inf
        order = np.argsort(-bound, kind="stable")
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        least = -np.inf if floor is None else floor[at]
        for begin in range(0, len(order), BATCH):
            part = order[begin: begin + BATCH]
            if bound[part[0]] < least or len(ids) >= top and bound[part[0]] < scores[top - 1]:
                break
            part = part[bound[part] > -np.inf]
            new = np.rint(rows[part] @ queries[at]).astype(np.int64)
            ids, scores = np.concatenate((ids, row_ids[part])), np.concatenate((scores, new))
            keep = np.lexsort((ids, -scores))[:top]
            ids, scores = ids[keep], scores[keep]
        yield at, ids, scores


def _bound(query: np.ndarray, near: np.ndarray, squares: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products with rows, or groups of rows, of such squared norms at most and such distances
    to the pivots; distances are rounded, hence the slack."""
    least = np.maximum(np.maximum(low - near, near - high), 0).max(axis=1)
    own = float((query ** 2).sum())
    return (own + squares - least ** 2) / 2 + 1e-6 * (1 + own + squares)


def _pivot_table(pivots: dict[int, np.ndarray]):
    """Adds to (vec_id, q, asks) the distances to the pivots, the number of the nearest one and the squared norm."""
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                rows = batch.column(1).to_pylist()
                table, near, squares = [None] * len(rows), [0] * len(rows), [0.0] * len(rows)
                for d in {len(r) for r in rows}:
                    places = [i for i, r in enumerate(rows) if len(r) == d]
                    x = np.array([rows[i] for i in places], np.float64).reshape(len(places), d)
                    away = _distances(x, pivots[d]) if d in pivots else np.zeros((len(places), 1))
                    for i, a, n in zip(places, away, (x ** 2).sum(axis=1)):
                        table[i], near[i], squares[i] = a, int(a.argmin()), float(n)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(table, pa.list_(pa.float64())), pa.array(near, pa.int32()), pa.array(squares)],
                                                 [*batch.schema.names, "table", "near", "squares"])

    return mapped


def _matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().astype(np.float64).reshape(n, -1)


def _meet(top: int):
    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {"qid": [], "query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(rows):
            ids, names = queries["vec_id"].to_numpy(), queries["qid"].to_numpy()
            for at, found, scores in best_of(_matrix(queries["q"], len(queries)), ids, _matrix(queries["table"], len(queries)), _matrix(rows["q"], len(rows)),
                                             rows["vec_id"].to_numpy(), _matrix(rows["table"], len(rows)), top, queries["floor"].to_numpy()):
                out["qid"] += [names[at]] * len(found)
                out["query_id"] += [ids[at]] * len(found)
                out["vec_id"] += found.tolist()
                out["score"] += scores.tolist()
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return search


def _reachable(cells: dict[int, tuple]):
    """A query for each other block that may hold a row as good as the last one that it has found in its own block."""
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                rows, of, to = batch.select(["q", "table", "d", "block", "floor"]).to_pylist(), [], []
                for i, r in enumerate(rows):
                    first, parts, squares, low, high = cells[r["d"]]
                    bound = _bound(np.array(r["q"], np.float64), np.array(r["table"]), squares, low, high)
                    going = np.concatenate([np.arange(first[c], first[c] + parts[c]) for c in np.flatnonzero(bound >= r["floor"])] or [np.zeros(0, np.int64)])
                    going = going[going != r["block"]]
                    of += [i] * len(going)
                    to += going.tolist()
                taken = batch.take(pa.array(of, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in ("qid", "vec_id", "q", "table", "d", "floor")), pa.array(to, pa.int32())],
                                                 ["qid", "vec_id", "q", "table", "d", "floor", "block"])

    return mapped


def top_k(rows: DataFrame, is_query, top: int = TOP, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` holds, the ``top`` highest integer inner products.

    Candidates are all rows but those with the query's id; vectors that are null or empty or hold null or non-finite
    numbers take no part, nor do rows with a null id; only vectors of equal length are compared. Repeated rows are
    candidates each, and queries each. Ties go to the smaller id. Scores must fit a double's integers.

    The pivot table is computed once and written. Rows go to cells by their nearest pivot, and large cells are cut into
    blocks. A query first meets its own block; then only the blocks of cells that the extremes of their distances to the
    pivots don't rule out, given the score that it has to beat. A block is sent once for every ``queries`` queries that
    meet it. What the driver collects is the pivots and a row for each cell, of which there are as many as pivots for a
    vector length.
    """
    base = (rows.where(F.col("vec_id").isNotNull() & _whole())
            .select(F.col("vec_id").cast("long").alias("vec_id"), quantised().alias("q"), F.coalesce(is_query, F.lit(False)).alias("asks")))
    pivots = choose_pivots(base)
    tabled = base.mapInArrow(_pivot_table(pivots), "vec_id long, q array<long>, asks boolean, table array<double>, near int, squares double").withColumn("d", F.size("q"))
    extremes = [f(F.get("table", F.lit(k))).alias(f"{name}{k}") for k in range(PIVOTS) for name, f in (("low", F.min), ("high", F.max))]
    cells: dict[int, list] = {}
    first, of_cell = 0, []
    for r in tabled.groupBy("d", "near").agg(F.count("*").alias("n"), F.max("squares").alias("squares"), *extremes).orderBy("d", "near").collect():
        parts = max(1, math.ceil(r["n"] / candidates))
        low, high = ([r[f"{name}{k}"] for k in range(PIVOTS) if r[f"{name}{k}"] is not None] for name in ("low", "high"))
        cells.setdefault(r["d"], []).append((first, parts, r["squares"], low, high))
        of_cell.append((r["d"], r["near"], first, parts))
        first += parts
    known = {d: tuple(np.array(c) for c in zip(*found)) for d, found in cells.items()}
    places = rows.sparkSession.createDataFrame(of_cell, "d int, near int, first int, parts int")
    placed = stage(tabled.join(F.broadcast(places), ["d", "near"]).withColumn("qid", F.monotonically_increasing_id())
                   .select("qid", "vec_id", "q", "asks", "table", "d", (F.col("first") + F.pmod(F.xxhash64("vec_id", "qid"), F.col("parts"))).cast("int").alias("block")), "blocks")
    theirs, asked = placed.select("vec_id", "q", "table", "block"), placed.where("asks").select("qid", "vec_id", "q", "table", "d", "block")
    out = "qid long, query_id long, vec_id long, score long"
    own = stage(asked.withColumn("floor", F.lit(float("-inf"))).groupBy("block").cogroup(theirs.groupBy("block")).applyInArrow(_meet(top), out), "own")
    floors = own.groupBy("qid").agg(F.when(F.count("*") >= top, F.min("score")).cast("double").alias("floor"))
    going = (asked.join(floors, "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
             .mapInArrow(_reachable(known), "qid long, vec_id long, q array<long>, table array<double>, d int, floor double, block int"))
    groups = going.groupBy("block").agg(F.ceil(F.count("*") / queries).cast("int").alias("groups"))
    sent = going.join(groups, "block").withColumn("g", F.pmod(F.xxhash64("qid"), F.col("groups")).cast("int")).drop("groups")
    copies = theirs.join(groups, "block").withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    others = sent.groupBy("block", "g").cogroup(copies.groupBy("block", "g")).applyInArrow(_meet(top), out)
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    return (own.unionByName(others).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
            .select("query_id", "rank", "vec_id", "score"))


def op10(spark, sf_dir: str) -> DataFrame:
    """Query: the 5 best of all rows for every row of ``embeddings`` whose id is divisible by 50."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
