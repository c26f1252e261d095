"""SimHash fingerprints and near-duplicate groups by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import connected_components, named_by_least
from .staging import stage

#: (first bit, width, radius) of each segment. Two fingerprints at distance 4 or less lie within these radii of one
#: another in at least one segment: beyond all of them they would differ in at least 2 + 2 + 1 bits.
SEGMENTS = ((0, 21, 1), (21, 21, 1), (42, 22, 0))
MAX_DISTANCE = 4
#: Entries of one bucket that one cell of work holds; larger buckets are cut into tiles of about this size.
TILE = 4096
#: Cells up to this size are compared together with others in one vectorised pass.
SMALL = 8


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit SimHash of one text, as a signed long."""
    import xxhash

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], dtype=np.uint64)
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends))[: len(words) - shingle + 1]
        stops = ends[shingle - 1:] - 1
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), stops.tolist())],
                             np.uint64, len(stops))
    return majority(hashes)


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def majority(hashes: np.ndarray) -> int:
    """A bit is set where over half of the hashes set it; in blocks, so that a very long text needs little memory."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at: at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; a null or blank text has fingerprint 0, a null id stays null."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return rows.mapInArrow(mapped, "doc_id long, fp long")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket entries of each fingerprint: its own in every table, and the probes of the Hamming ball of each segment.

    Of two values that differ in one bit, only the one without that bit probes for the other.
    """
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        keys, fps, table = [], [], []
        for k, (first, width, radius) in enumerate(SEGMENTS):
            value = (fp >> np.uint64(first)) & np.uint64((1 << width) - 1)
            tag = np.uint64(k << 32)
            keys.append(value | tag), fps.append(fp), table.append(np.ones(len(fp), bool))
            for bit in range(width if radius else 0):
                free = (value >> np.uint64(bit)) & np.uint64(1) == 0
                keys.append(value[free] | np.uint64(1 << bit) | tag)
                fps.append(fp[free]), table.append(np.zeros(int(free.sum()), bool))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(fps).view(np.int64)),
             pa.array(np.concatenate(table))], ["bucket", "fp", "own"])


def _forest(fps: np.ndarray, own: np.ndarray) -> tuple[list, list]:
    """Links that connect every pair within reach one of whose ends is a table entry: a forest, not all pairs."""
    left, right = [], []
    open_ = np.ones(len(fps), bool)
    order = np.argsort(~own, kind="stable")  # table entries first: only those are expanded
    for start in order[: int(own.sum())]:
        if not open_[start]:
            continue
        open_[start] = False
        stack = [start]
        while stack:
            at = stack.pop()
            rest = np.flatnonzero(open_)
            if not len(rest):
                return left, right
            near = rest[np.bitwise_count(fps[rest] ^ fps[at]) <= MAX_DISTANCE]
            open_[near] = False
            left += [fps[at]] * len(near)
            right += fps[near].tolist()
            stack += near[own[near]].tolist()
        # probes that were reached above may be within reach of another table entry too
        open_[~own] = True
    return left, right


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams over rows sorted by cell; compares inside each cell and emits its forest of links."""
    names = ["bucket", "i", "j", "fp", "own"]
    carry = None

    def linked(table: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        n = len(table["fp"])
        cut = np.flatnonzero((np.diff(table["bucket"]) != 0) | (np.diff(table["i"]) != 0) | (np.diff(table["j"]) != 0)) + 1
        begin, size = np.concatenate(([0], cut)), np.diff(np.concatenate(([0], cut, [n])))
        fp, own = table["fp"].view(np.uint64), table["own"]
        us, vs = [], []
        small = size[np.repeat(np.arange(len(size)), size)] <= SMALL
        where = np.repeat(begin, size)
        for step in range(1, SMALL):
            a = np.flatnonzero(small[: n - step] & (where[: n - step] == where[step:])) if step < n else np.array([], int)
            a = a[(own[a] | own[a + step]) & (np.bitwise_count(fp[a] ^ fp[a + step]) <= MAX_DISTANCE)]
            us.append(fp[a]), vs.append(fp[a + step])
        for b, s in zip(begin[size > SMALL].tolist(), size[size > SMALL].tolist()):
            cell, first = np.unique(fp[b: b + s], return_index=True)
            mine = np.zeros(len(cell), bool)
            mine[np.searchsorted(cell, fp[b: b + s][own[b: b + s]])] = True
            left, right = _forest(cell, mine)
            us.append(np.array(left, np.uint64)), vs.append(np.array(right, np.uint64))
        u, v = np.concatenate(us), np.concatenate(vs)
        keep = u != v
        return pa.RecordBatch.from_arrays([pa.array(u[keep].view(np.int64)), pa.array(v[keep].view(np.int64))], ["u", "v"])

    for batch in batches:
        now = {k: batch.column(x).to_numpy(zero_copy_only=False) for x, k in enumerate(names)}
        if carry is not None:
            now = {k: np.concatenate((carry[k], now[k])) for k in names}
        n = len(now["fp"])
        if not n:
            continue
        last = (now["bucket"] == now["bucket"][-1]) & (now["i"] == now["i"][-1]) & (now["j"] == now["j"][-1])
        split = int(np.flatnonzero(last)[0])
        carry = {k: x[split:] for k, x in now.items()}
        if split:
            yield linked({k: x[:split] for k, x in now.items()})
    if carry is not None:
        yield linked(carry)


def links(distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """(u, v): links between distinct fingerprints at ``MAX_DISTANCE`` or less that connect all that are so linked.

    A bucket with more than ``tile`` entries is cut into tiles by a hash of the fingerprint; every pair of tiles is a
    cell of its own, so that no task holds an unbounded bucket.
    """
    entries = distinct.select("fp").mapInArrow(_entries, "bucket long, fp long, own boolean")
    large = (entries.groupBy("bucket").count().where(F.col("count") > tile)
             .select("bucket", F.ceil(F.col("count") / tile).cast("int").alias("tiles")))
    dealt = entries.join(large, "bucket", "left").withColumn(
        "t", F.pmod(F.xxhash64("fp"), F.coalesce("tiles", F.lit(1))).cast("int"))
    cells = dealt.select(
        "bucket", "fp", "own",
        F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1))).alias("o"), "t")
    cells = cells.select("bucket", F.least("o", "t").alias("i"), F.greatest("o", "t").alias("j"), "fp", "own")
    return (cells.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
            .mapInArrow(_cells, "u long, v long"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Fingerprints at ``MAX_DISTANCE`` or fewer differing bits link; component_id is the smallest id reachable, the
    row's own included. Equal fingerprints always link, so rows are first reduced to distinct fingerprints. Null and
    blank texts share fingerprint 0. A null id takes part but never names a component, unless all its ids are null.
    Repeated rows are kept, extra columns are ignored, an empty table gives an empty result.
    """
    fps = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(links(distinct)).withColumnsRenamed({"node": "fp"})
    component = named_by_least(distinct.join(roots, "fp", "left").withColumnRenamed("fp", "uid")).withColumnRenamed("uid", "fp")
    return fps.join(component, "fp").select("doc_id", "fp", "component_id")


def op3(spark, sf_dir: str) -> DataFrame:
    """Query: SimHash groups of the whole ``documents`` table."""
    groups = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
