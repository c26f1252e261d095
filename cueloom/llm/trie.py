"""The prefix trie of conversations, by vertical bitmaps: one bitset of conversations for every (position, turn)."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .staging import stage

#: Turn numbers of one part of a conversation; a longer conversation is several parts, each a row of its own.
PART_BITS = 12
#: Conversations (or parts) and turns of a shard, at most; a single longer part is a shard of its own.
SHARD_PATHS, SHARD_TURNS = 4_096, 100_000
#: Parents that are broadcast, at most: fewer have over one in so many of all nodes as children.
BIG_PARENTS = 100_000
#: First turns that a conversation may borrow from another one, at most.
MOST_BORROWED = 3
#: Conversation ids of one row of an end list.
END_BITS = 12

_WORD = r"[^\x20\x09-\x0D]+"
_KEY = ("a", "b")


# ---- paths: conversations as lists of (position, turn) keys


def parts_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, turns): each conversation's turns (turn, digest, words) in order, at most 4,096 turn numbers a part.

    Texts are reduced to digests and word counts where they are read, so that none is shuffled.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(said)).alias("digest"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"))
    part = F.coalesce(F.shiftright("turn", PART_BITS), F.lit(-(1 << 62)))
    return (turns.groupBy("conv_id", part.alias("part"))
            .agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "words"))).alias("turns")))


def paths_of(parts: DataFrame, lender: Column | None = None, borrowed: Column | None = None) -> DataFrame:
    """(conv_id, before, depth, only, last, steps): a row for each part; steps hold the 128-bit key of (position, turn) and the turn's words.

    With ``lender`` and ``borrowed``, expressions of conv_id, a conversation begins with the first ``borrowed`` turns (0
    to 3) of the lender (all if it has fewer, none if it is absent) and goes on with its own after as many.
    """
    order = Window.partitionBy("conv_id").orderBy("part")
    here = parts.select("conv_id", "part", F.size("turns").cast("long").alias("n"), F.slice("turns", 1, MOST_BORROWED).alias("heads"))
    here = here.withColumns({"before": F.sum("n").over(order) - F.col("n"), "last": F.lead("part").over(order).isNull()})
    skip = F.lit(0) if borrowed is None else borrowed
    if lender is None:
        lent = here.withColumn("lent", F.slice("heads", 1, 0))
    else:
        begins = (here.where(f"before < {MOST_BORROWED}").join(here.select(lender.alias("lender")).distinct(), F.col("conv_id") == F.col("lender"), "left_semi")
                  .groupBy(F.col("conv_id").alias("lender")).agg(F.sort_array(F.collect_list(F.struct("before", "heads"))).alias("h"))
                  .select("lender", F.slice(F.flatten(F.col("h.heads")), 1, MOST_BORROWED).alias("all")))
        lent = (here.withColumn("lender", lender).join(begins, "lender", "left")
                .withColumn("lent", F.coalesce(F.slice("all", F.lit(1), skip), F.slice("heads", 1, 0))))
    lent = lent.select("conv_id", "part", "before", "last", "lent", skip.cast("long").alias("skip"))
    first = F.col("before") == 0
    depth = F.when(first, F.lit(0)).otherwise(F.greatest("before", "skip") - F.col("skip") + F.size("lent"))
    own = F.slice("turns", (F.greatest(F.col("skip") - F.col("before"), F.lit(0)) + 1).cast("int"), F.size("turns"))
    turns = F.concat(F.when(first, F.col("lent")).otherwise(F.slice("lent", 1, 0)), own)

    def step(turn: Column, at: Column) -> Column:
        key = [F.xxhash64(F.lit(seed), turn["digest"], F.col("depth") + at + 1).alias(name) for seed, name in enumerate(_KEY, 1)]
        return F.struct(*key, turn["words"].alias("words"))

    return (parts.join(lent, ["conv_id", "part"]).withColumn("depth", depth.cast("long"))
            .select("conv_id", "before", "depth", (first & F.col("last")).alias("only"), "last", F.transform(turns, step).alias("steps")))


def _placed(paths: DataFrame) -> DataFrame:
    """The paths with what stands before each: the key of the prefix and its words, and the words of the whole conversation.

    A prefix's key is the exclusive or of its turns' keys, so that parts of a long conversation are put together from
    one number each; only these numbers are gathered by conversation.
    """
    def xor(name: str) -> Column:
        return F.aggregate("steps", F.lit(0).cast("long"), lambda found, s: found.bitwiseXOR(s[name]))

    words = F.aggregate("steps", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    none = F.lit(0).cast("long")
    whole = paths.where("only").select("*", none.alias("a0"), none.alias("b0"), none.alias("words0"), words.alias("total"))
    cut = paths.where("not only")
    order = Window.partitionBy("conv_id").orderBy("before")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.select("conv_id", "before", xor("a").alias("xa"), xor("b").alias("xb"), words.alias("w")).select(
        "conv_id", "before", F.coalesce(F.bit_xor("xa").over(earlier), none).alias("a0"), F.coalesce(F.bit_xor("xb").over(earlier), none).alias("b0"),
        F.coalesce(F.sum("w").over(earlier), none).alias("words0"), F.sum("w").over(Window.partitionBy("conv_id")).alias("total"))
    return whole.unionByName(cut.join(sums, ["conv_id", "before"]))


# ---- one shard


class Shard:
    """Some paths and, for every (position, turn), the bitset of those that have it; bit i is the i-th path by conversation."""

    def __init__(self, rows: list[tuple]):
        rows.sort(key=lambda r: (r[0], r[1]))
        self.rows = rows
        self.postings: dict[tuple[int, int], int] = {}
        self.stops: dict[int, int] = {}
        self.starts: dict[tuple, int] = {}
        for i, (_, before, depth, a, b, words, keys, _, _) in enumerate(rows):
            bit = 1 << i
            for key in keys:
                self.postings[key] = self.postings.get(key, 0) | bit
            self.stops[depth + len(keys)] = self.stops.get(depth + len(keys), 0) | bit
            start = (a, b, depth, words, before == 0)
            self.starts[start] = self.starts.get(start, 0) | bit

    def nodes(self) -> Iterator[tuple]:
        """(a, b, depth, parent a, parent b, words, words from the root on, members, members that end there), depth first.

        A child is the parent's bitset intersected with a posting of the next position: that of the first member's next
        turn, then that of the first one left, until none is. The node in which a part starts has its members from the part
        before; only what ends there is told, without members.
        """
        for (a, b, depth, path_words, begins), members in self.starts.items():
            todo = [(a, b, depth, None, None, 0, path_words, members)]
            while todo:
                a, b, depth, up_a, up_b, words, path_words, members = node = todo.pop()
                ended = members & self.stops.get(depth, 0)
                if up_a is not None or begins:
                    yield *node, ended
                elif ended:
                    yield *node[:-1], 0, ended
                rest = members ^ ended
                while rest:
                    first = (rest & -rest).bit_length() - 1
                    row = self.rows[first]
                    at = depth - row[2]
                    key = row[6][at]
                    child = rest & self.postings[key]
                    rest ^= child
                    todo.append((a ^ key[0], b ^ key[1], depth + 1, a, b, row[7][at], path_words + row[7][at], child))

    def ids(self, bits: int) -> list[int]:
        """The conversations of a bitset, ascending."""
        found = []
        while bits:
            low = bits & -bits
            found.append(self.rows[low.bit_length() - 1][0])
            bits ^= low
        return found


def _counted(shard: Shard) -> Iterator[tuple]:
    last = sum(1 << i for i, row in enumerate(shard.rows) if row[8][0])
    for a, b, depth, up_a, up_b, words, path_words, members, ended in shard.nodes():
        least = shard.rows[(members & -members).bit_length() - 1][0] if members else None
        yield a, b, depth, up_a, up_b, words, path_words, members.bit_count(), least, shard.ids(ended & last)


def _summed(shard: Shard) -> Iterator[tuple]:
    """(a, b, leaves, saved): sums over members, from the bit slices of their numbers.

    A member counts the words of its turns that an earlier conversation has in the same node: of the turns from the
    node's own on to the last before those that it owns. It counts a leaf if the last node it owns is one.
    """
    slices: list[int] = []
    leaves, owned_from = 0, {}
    for i, row in enumerate(shard.rows):
        _, leaf, own_from, shared_words = row[8]
        while shared_words >> len(slices):
            slices.append(0)
        for j in range(shared_words.bit_length()):
            slices[j] |= (shared_words >> j & 1) << i
        leaves |= int(leaf) << i
        owned_from[own_from] = owned_from.get(own_from, 0) | 1 << i
    levels = sorted(owned_from)
    after = [0]
    for level in reversed(levels):
        after.append(after[-1] | owned_from[level])
    after.reverse()  # after[k]: members that own from levels[k] on or deeper
    for a, b, depth, _, _, words, path_words, members, _ in shard.nodes():
        shared = members & after[bisect_right(levels, depth)]
        saved = sum((shared & s).bit_count() << j for j, s in enumerate(slices)) - shared.bit_count() * (path_words - words) if shared else 0
        yield a, b, (members & leaves).bit_count(), saved


_COUNTED = "a long, b long, depth long, up_a long, up_b long, words long, path_words long, n long, conv_id long, ends array<long>"
_SUMMED = "a long, b long, leaves long, saved long"


def _shards(paths: DataFrame, measure: Callable[[Shard], Iterator[tuple]], schema: str, *extra: str) -> DataFrame:
    """What ``measure`` gives of each shard; a shard is as many rows of a partition as fit its bounds."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    kinds = [pa.list_(pa.int64()) if "array" in f else pa.int64() for f in schema.split(",")]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in (whole.slice(at, 500) for whole in batches for at in range(0, whole.num_rows, 500)):
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "before", "depth", "a0", "b0", "words0")]
            more = zip(*(batch.column(c).to_pylist() for c in extra))
            for start, steps, found in zip(zip(*columns), batch.column("steps"), more):
                flat = steps.values
                yield *start, list(zip(flat.field("a").to_pylist(), flat.field("b").to_pylist())), flat.field("words").to_pylist(), found

    def measured(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        out = []
        for row in measure(Shard(rows)):
            out.append(row)
            if len(out) == 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, turns = [], 0
        for row in rows_of(batches):
            if rows and (len(rows) == SHARD_PATHS or turns + len(row[6]) > SHARD_TURNS):
                yield from measured(rows)
                rows, turns = [], 0
            rows.append(row)
            turns += len(row[6])
        if rows:
            yield from measured(rows)

    return paths.select("conv_id", "before", "depth", "a0", "b0", "words0", "steps", *extra).mapInArrow(mapped, schema)


# ---- the trie


def prefix_trie(conversations: DataFrame, lender: Column | None = None, borrowed: Column | None = None) -> DataFrame:
    """One row for each distinct prefix of turns (role, text) of the ``conversations`` (conv_id, turn, role, text), the root included.

    (node, parent, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): 32 hex
    digits that name the node and its parent; the smallest member; its parent's smallest member (null at the root);
    members; children; childless nodes of the subtree; over the subtree, members but one times the words of the last
    turn; hash of the ids that end there, ascending and comma-joined. A node's turn is the depth-th of its conv_id.

    Turns are ordered by turn (null first), ties by the digest of role and text, repeated rows are turns of their own,
    null roles and texts count as empty, other columns are ignored. Rows without conv_id belong to no conversation and
    are left out; a table without conversations gives no rows, not even a root. ``lender`` and ``borrowed``: see
    ``paths_of``. Two prefixes count as one if 128 bits of hash agree.

    Conversations are cut into shards in the order of their ids; in each, postings of (position, turn) are intersected
    from the root down. Nodes of all shards are added up by key, so that a prefix that most conversations share is one
    row a shard. Sums over subtrees need no pass by depth: they are sums over a node's members, of words that a member
    shares with a smaller conversation and of leaves that it owns. Turn numbers of a conversation are cut into parts of
    4,096, so that a very long one is spread over shards; only rows that share the turn number too are gathered.
    """
    paths = paths_of(parts_of(conversations), lender, borrowed)
    paths = _placed(stage(paths.repartitionByRange("conv_id", "before").sortWithinPartitions("conv_id", "before"), "paths"))
    found = stage(_shards(paths, _counted, _COUNTED, "last"), "shard-nodes")
    merged = found.groupBy(*_KEY).agg(F.max("depth").alias("depth"), F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b"), F.max("words").alias("words"),
                                      F.max("path_words").alias("path_words"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    merged = stage(merged, "merged-nodes")
    children = merged.where("up_a is not null").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = stage(merged.join(children, [*_KEY], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")

    owners = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("own_from"), F.min_by(F.col("path_words") - F.col("words"), "depth").alias("shared_words"),
        F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    shared = paths.join(owners, "conv_id", "left").select(
        *paths.columns, F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf"), F.coalesce("own_from", F.lit((1 << 63) - 1)).alias("own_from"),
        F.coalesce("shared_words", "total").alias("shared_words"))
    sums = _shards(shared, _summed, _SUMMED, "last", "leaf", "own_from", "shared_words").groupBy(*_KEY).agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    whole = _with_parents(nodes).join(sums, [*_KEY]).join(_end_hashes(found), [*_KEY], "left")
    name = {k: F.lower(F.concat(*(F.lpad(F.hex(f"{k}{c}"), 16, "0") for c in _KEY))) for k in ("", "up_")}
    return whole.select(name[""].alias("node"), name["up_"].alias("parent"), "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def _with_parents(nodes: DataFrame) -> DataFrame:
    """The nodes with the smallest member of each one's parent.

    Parents of more than one in 100,000 of all nodes are fewer than 100,000, and are broadcast; the others have no more
    children than that, and are joined by a shuffle.
    """
    most = max(1_000, nodes.count() // BIG_PARENTS)
    parent = nodes.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    big = parent.where(F.col("n_children") > most).drop("n_children")
    small = parent.where(F.col("n_children").between(1, most)).drop("n_children")
    met = nodes.join(F.broadcast(big), ["up_a", "up_b"], "left")
    far = met.where("parent_conv_id is null and up_a is not null").drop("parent_conv_id").join(small, ["up_a", "up_b"])
    return met.where("parent_conv_id is not null or up_a is null").unionByName(far)


def _end_hashes(found: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of the nodes in which conversations end.

    Ids are sorted in ranges of 4,096; a hash is carried over a node's ranges in order, which is one task's work for a
    node, since the hash can't be computed in parallel; it holds one range at a time.
    """
    ends = found.select(*_KEY, F.explode("ends").alias("id"))
    ranges = ends.groupBy(*_KEY, F.shiftright("id", END_BITS).alias("range")).agg(F.array_join(F.sort_array(F.collect_list("id")).cast("array<string>"), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        now, digest = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids"))):
                if (a, b) != now:
                    if now:
                        out.append((*now, digest.hexdigest()))
                    now, digest = (a, b), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))], [*_KEY, "ends_sha256"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([digest.hexdigest()])], [*_KEY, "ends_sha256"])

    return ranges.repartition(*_KEY).sortWithinPartitions(*_KEY, "range").mapInArrow(hashed, "a long, b long, ends_sha256 string")


def op11(spark, sf_dir: str) -> DataFrame:
    """Query: the trie of all ``conversations``, each rebuilt with up to 3 first turns of the first of its twenty."""
    conv = F.col("conv_id")
    borrowed = (F.crc32(conv.cast("string").cast("binary")) % 4).cast("int")
    trie = prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), conv - conv % 20, borrowed)
    return trie.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
