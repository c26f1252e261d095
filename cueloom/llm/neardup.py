"""Embedding near-duplicates: PCA-ordered comparison of tiles, stopped early by suffix norms."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import BROADCAST_ROWS, connected_components, named_by_least
from .staging import stage

THRESHOLD = 0.98
#: Distinct vectors of one tile at about most; a cell of work compares two tiles.
TILE = 1500
#: Leading dimensions that are summed at a time before the bound is looked at.
STEP = 8


def usable(vector: str = "embedding"):
    """Whether a vector is not null, not empty, holds no null and only finite numbers, and is not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the outer products of unit vectors, by dimension; one row a task and dimension."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        vectors = batch.column(0).to_pylist()
        for d in {len(v) for v in vectors}:
            x = np.array([v for v in vectors if len(v) == d], np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            sums[d] = sums.get(d, 0) + x.T @ x
    for d, m in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([m.ravel().tolist()])], ["d", "m"])


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By dimension, the axes of all unit vectors by falling variance about the origin; bounded by the dimension."""
    total: dict[int, np.ndarray] = {}
    sums = (vectors.mapInArrow(_moments, "d int, m array<double>").select("d", F.posexplode("m").alias("at", "v"))
            .groupBy("d", "at").agg(F.sum("v").alias("v")))
    for row in sums.collect():
        d = row["d"]
        total.setdefault(d, np.zeros(d * d))[row["at"]] = row["v"]
    return {d: np.linalg.eigh(m.reshape(d, d))[1][:, ::-1] for d, m in total.items()}


def near_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (of a, of b) whose cosine may reach the threshold; the rows are unit vectors on PCA axes.

    Leading dimensions are accumulated first. What the others can add is at most the product of the suffixes' norms;
    pairs that cannot reach the threshold even so are left out, and the rest go on with the next dimensions.
    """
    d = a.shape[1]
    slack = threshold - 1e-9
    suffix = lambda x: np.sqrt(np.maximum(np.cumsum((x ** 2)[:, ::-1], axis=1)[:, ::-1], 0))
    sa, sb = suffix(a), suffix(b)
    for at in range(0, len(a), 256):
        part = a[at: at + 256]
        k = min(STEP, d)
        bound = part[:, :k] @ b[:, :k].T
        if k < d:
            bound += sa[at: at + 256, k, None] * sb[None, :, k]
        i, j = np.nonzero(bound >= slack)
        dots = None
        for begin in range(0, len(i), 200_000):  # survivors, a bounded number at a time
            x, y = i[begin: begin + 200_000], j[begin: begin + 200_000]
            dots = np.einsum("nk,nk->n", part[x, :k], b[y, :k])
            for at_k in range(k, d, STEP):
                end = min(at_k + STEP, d)
                dots = dots + np.einsum("nk,nk->n", part[x, at_k:end], b[y, at_k:end])
                if end < d:
                    keep = dots + sa[at + x, end] * sb[y, end] >= slack
                    x, y, dots = x[keep], y[keep], dots[keep]
            keep = dots >= slack
            if keep.any():
                yield at + x[keep], y[keep]


def _cell(axes: dict[int, np.ndarray], threshold: float):
    def compare(table: pa.Table) -> pa.Table:
        """Counts of links by vector, weighted by copies, and a forest of links of one cell."""
        pdf = table.select(["uid", "copies", "embedding", "side"]).to_pydict()
        d = len(pdf["embedding"][0])
        raw = np.array(pdf["embedding"], np.float64)
        uid, copies, side = np.array(pdf["uid"]), np.array(pdf["copies"]), np.array(pdf["side"])
        norms = np.linalg.norm(raw, axis=1)
        turned = (raw / norms[:, None]) @ axes[d]
        same = not (side == 1).any()
        left = np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        links = np.zeros(len(uid), np.int64)
        root = np.arange(len(uid))
        edges = []
        for i, j in near_pairs(turned[left], turned[right], threshold):
            i, j = left[i], right[j]
            if same:
                keep = i < j
                i, j = i[keep], j[keep]
            # the contract's own test: the given numbers, in double precision
            exact = np.concatenate([np.einsum("nk,nk->n", raw[i[s: s + 100_000]], raw[j[s: s + 100_000]])
                                    / (norms[i[s: s + 100_000]] * norms[j[s: s + 100_000]]) for s in range(0, max(1, len(i)), 100_000)]) >= threshold
            i, j = i[exact], j[exact]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            open_ = root[i] != root[j]
            while open_.any():
                i, j = i[open_], j[open_]
                a, b = int(i[0]), int(j[0])
                edges.append((int(uid[a]), int(uid[b])))
                root[root == root[b]] = root[a]
                open_ = root[i] != root[j]
        some = np.flatnonzero(links)
        u = uid[some].tolist() + [a for a, _ in edges]
        v = [None] * len(some) + [b for _, b in edges]
        n = links[some].tolist() + [0] * len(edges)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "n": pa.array(n, pa.int64())})

    return compare


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``rows`` (vec_id, embedding, label).

    Vectors are compared when their labels are equal and not null, and their lengths too; null, empty and zero vectors and those with
    null or non-finite components link with nothing, nor do rows with a null vec_id or label. Equal vectors are compared once and counted
    as often as they occur. Two vectors of cosine ``threshold`` or more are no further apart on the first principal
    axis than the square root of 2 - 2 * threshold, so that a band of that width is compared with itself and the next
    one; a band with many vectors is cut into tiles, and each pair of tiles is a cell. Repeated rows count as others, and so
    do rows that share a vec_id but not the vector or label.
    """
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    valid = base.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable())
    distinct = stage(valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
                     .withColumn("uid", F.monotonically_increasing_id()), "vectors")
    axes = principal_axes(distinct.select("embedding"))
    width = math.sqrt(2 - 2 * threshold) + 1e-9
    firsts = {d: a[:, 0].tolist() for d, a in axes.items()}

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            band = []
            for v in batch.column("embedding").to_pylist():
                x = np.array(v)
                band.append(math.floor(float(x @ np.array(firsts[len(v)])) / float(np.linalg.norm(x)) / width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(band, pa.int32())], [*batch.schema.names, "band"])

    placed = distinct.mapInArrow(banded, distinct.withColumn("band", F.lit(0)).schema).withColumn("d", F.size("embedding"))
    placed = stage(placed, "bands")
    key = ["label", "d", "band"]
    tiles = placed.groupBy(*key).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    after = tiles.select("label", "d", (F.col("band") - 1).alias("band"), F.col("tiles").alias("next"))
    before = tiles.select("label", "d", (F.col("band") + 1).alias("band"), F.col("tiles").alias("previous"))
    sizes = stage(tiles.join(after, key, "left").join(before, key, "left"), "tiles")
    # a few bands a label; where labels are so many that their bands pass this, the join is left to a shuffle
    near = F.broadcast if sizes.count() <= BROADCAST_ROWS else lambda df: df
    dealt = placed.join(near(sizes), key).withColumn("t", F.pmod(F.xxhash64("uid"), F.col("tiles")).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    none = F.array().cast("array<struct<b:int,i:int,c:int,j:int,side:int>>")
    place = lambda b, i, c, j, side: F.struct(b.alias("b"), i.alias("i"), c.alias("c"), j.alias("j"), F.lit(side).alias("side"))
    band, t = F.col("band"), F.col("t")
    inside = F.transform(upto(F.col("tiles")), lambda o: F.when(o < t, place(band, o, band, t, 1)).otherwise(place(band, t, band, o, 0)))
    onward = F.when(F.col("next").isNull(), none).otherwise(F.transform(upto(F.col("next")), lambda o: place(band, t, band + 1, o, 0)))
    back = F.when(F.col("previous").isNull(), none).otherwise(F.transform(upto(F.col("previous")), lambda o: place(band - 1, o, band, t, 1)))
    cells = dealt.select("label", "d", "uid", "copies", "embedding", F.explode(F.concat(inside, onward, back)).alias("p"))
    found = stage(cells.select("label", "d", "uid", "copies", "embedding", "p.*")
                  .groupBy("label", "d", "b", "i", "c", "j").applyInArrow(_cell(axes, threshold), "u long, v long, n long"), "links")
    counts = found.where("v is null").groupBy("u").agg(F.sum("n").alias("others"))
    roots = connected_components(found.where("v is not null"))
    named = named_by_least(distinct.select("uid", "least").join(roots.select(F.col("node").alias("uid"), "root"), "uid", "left"))
    of = (distinct.join(counts, distinct["uid"] == counts["u"], "left").join(named, "uid")
          .select(F.col("label").alias("_l"), F.col("embedding").alias("_e"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                  "component_id"))
    linked = (valid.join(of, (valid["label"] == of["_l"]) & (valid["embedding"] == of["_e"])).select("vec_id", "n_links", "component_id"))
    alone = (base.where(~(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable()))
             .select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op9(spark, sf_dir: str) -> DataFrame:
    """Query: near-duplicates of the whole ``embeddings`` table."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
