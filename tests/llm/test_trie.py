"""The conversation trie against a plain dictionary of prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cueloom.llm import trie

KIND = "conv_id long, turn long, role string, text string, depth string, node string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows, borrow=True):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            turns[conv].append(((turn is not None, turn or 0, digest), role, text))
    own = {c: [(role, text) for _, role, text in sorted(found, key=lambda t: t[0])] for c, found in turns.items()}
    rebuilt = {}
    for c, found in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if borrow else 0
        base = abs(c) // 20 * 20 * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(own.get(base, [])[:h] + found[h:])
    members, ends = defaultdict(set), defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ends[path].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        last = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = sum(saved[x] for x in children[node]) + (len(members[node]) - 1) * last
    return sorted((min(members[n]), len(n), min(members[n[:-1]]) if n else -1, len(members[n]), len(children[n]), leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n in members)


def found(df, borrow=True):
    conv = F.col("conv_id")
    lent = (conv - conv % 20, (F.crc32(conv.cast("string").cast("binary")) % 4).cast("int")) if borrow else (None, None)
    return sorted(tuple(-1 if v is None else v for v in r) for r in trie.prefix_trie(df, *lent).select(*COLUMNS).collect())


@pytest.fixture(scope="module")
def rows():
    """Shared first turns, exact copies, borrowed turns of short and absent lenders, ties, nulls, and turn numbers of several parts."""
    rng = random.Random(7)
    out = []
    for c in [*range(0, 90), *range(121, 130), *range(-45, -38)]:
        n = rng.choice((1, 1, 2, 3, 5, 8))
        for t in range(n):
            out.append((c, t if rng.random() > 0.05 else None, rng.choice(("user", "assistant")) if t else "system",
                        rng.choice(("a b", "c", "", "d e f", "  ", "g h i j")) if t else rng.choice(("hello there", "hello"))))
    out += [(200, t * 1500, "user", f"word {t // 3}") for t in range(12)] + [(201, t * 1500, "user", f"word {t // 3}") for t in range(12)]
    out += [(203, t * 1500 if t < 8 else 99_999, "user", f"word {t // 3}" if t < 8 else "other end") for t in range(10)]
    out += [(210, -5000, "user", "before"), (210, None, None, None), (210, 5000, "user", "x" * 50_000), (None, 1, "user", "nobody's"), (None, None, None, None)]
    out += [r for r in out if r[0] in (5, 6, 200)][:9]  # repeated rows
    return [(*r, "clash", "clash") for r in out]


@pytest.mark.parametrize("borrow", [True, False])
def test_trie(spark, rows, borrow):
    assert found(spark.createDataFrame(rows, KIND).repartition(3), borrow) == brute(rows, borrow)


def test_shards_of_any_size_add_up(rows):
    """Nodes of two shards add up to those of one that holds both."""
    paths = [(c, 0, 0, 0, 0, 0, keys, [1] * len(keys), (True,)) for c, keys in enumerate(([(1, 2), (3, 4)], [(1, 2)], [(1, 2), (3, 4)], [], [(5, 6), (7, 8), (9, 1)], [(1, 2), (7, 3)]))]

    def counted(*shards):
        sums = defaultdict(int)
        for some in shards:
            for a, b, depth, up_a, up_b, words, path_words, n, least, ends in trie._counted(trie.Shard(list(some))):
                sums[a, b, depth, up_a, up_b, words, path_words] += n
        return dict(sums)

    assert counted(paths) == counted(paths[:2], paths[2:]) == counted(*([p] for p in paths))
    assert counted(paths)[1, 2, 1, 0, 0, 1, 1] == 4


def test_a_shared_first_turn_of_many_children(spark, monkeypatch):
    """Parents beyond the bound are broadcast, the others shuffled, with equal results."""
    rows = [(c, t, "user", "same" if t == 0 else f"{c % 40} {t}") for c in range(120) for t in range(3)]
    want = brute(rows, False)
    df = spark.createDataFrame([(*r, "", "") for r in rows], KIND)
    assert found(df, False) == want
    monkeypatch.setattr(trie, "max", lambda *_: 3, raising=False)
    assert found(df, False) == want


def test_no_conversations(spark):
    assert trie.prefix_trie(spark.createDataFrame([], KIND)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x", "", "")], KIND)).count() == 0
