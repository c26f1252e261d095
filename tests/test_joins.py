"""Similarity and interval joins against brute force, and how few rows they make."""

import random

import pytest
from pyspark.sql import functions as F

from cueloom.functions.fuzzy import _shared_pairs, alike_pairs, rare_characters, rare_pairs, ratio
from cueloom.operators import captions as cp, joins as j, segments as sg


def texts(rng, n):
    base = ["the harbour lights go out", "she never wrote again", "call me when it rains", "été à la mer", "雨が降ってきた", "ok"]
    out = []
    for _ in range(n):
        t = rng.choice(base)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(t))
            t = t[:at] + rng.choice(("x", "", "zz", t[at])) + t[at + 1:] or "y"
        out.append(t)
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.8, 0.85, 1.0])
def test_rare_characters_miss_no_pair(threshold):
    """Any two texts that are alike share one; texts of any lengths and letters."""
    rng = random.Random(2)
    pool = texts(rng, 120) + ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    for rare in (rare_characters, rare_pairs):
        some = [t for t in pool if rare is rare_characters or threshold > 2 / 3 and _shared_pairs(len(t), threshold) >= 1]
        marks = [set(rare(t, threshold)) for t in some]
        for a, ma in zip(some, marks):
            for b, mb in zip(some, marks):
                assert ma & mb or ratio(a, b) < threshold, (a, b)


def test_alike_pairs(spark):
    rng = random.Random(3)
    rows = [(k, t) for k in (1, 2) for t in texts(rng, 80)] + [(1, ""), (1, None), (3, "alone")]
    df = spark.createDataFrame(rows, "k int, t string")
    left, right = df.select("k", F.col("t").alias("a")), df.where("k < 3").select("k", F.col("t").alias("b"))
    got = {(r.k, r.a, r.b): r.ratio for r in alike_pairs(left, right, ["k"], 0.8).collect()}
    distinct = {(k, t) for k, t in rows if t}
    want = {(k, a, b): ratio(a, b) for k, a in distinct for l, b in distinct if k == l and k < 3 and ratio(a, b) >= 0.8}
    assert got == pytest.approx(want) and len(want) > 100
    assert alike_pairs(left.limit(0), right, ["k"], 0.8).count() == 0
    with pytest.raises(ValueError):
        alike_pairs(left, right, ["k"], 0.0)


def test_few_pairs_are_compared():
    """Texts that have little to do with each other seldom meet."""
    rng = random.Random(4)
    pool = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randrange(15, 40))) for _ in range(300)]
    marks = [set(rare_pairs(t, 0.85)) for t in pool]
    lengths = [len(t) for t in pool]
    met = sum(bool(marks[a] & marks[b]) and 2 * min(lengths[a], lengths[b]) >= 0.85 * (lengths[a] + lengths[b]) for a in range(300) for b in range(a))
    assert met < 0.25 * 300 * 299 / 2


def test_fuzzy_anti_join(spark):
    rng = random.Random(5)
    rows = [(v, f, t) for v in (1, 2) for f, t in enumerate(texts(rng, 60) + ["", None, "OK"])]
    items = [(1, "The Harbour lights go out"), (1, "ok"), (2, "call me when it rains"), (2, ""), (2, None)]

    def bad(text, item):
        low, item = text.lower(), item.lower()
        return low == item or (abs(len(low) - len(item)) <= max(4, len(item) // 2) and ratio(low, item) >= 0.85)

    want = sorted((v, f) for v, f, t in rows if not any(t and i and k == v and bad(t, i) for k, i in items))
    out = j.fuzzy_anti_join(spark.createDataFrame(rows, "video_id int, frame_idx int, text string"), spark.createDataFrame(items, "video_id int, item string"))
    assert sorted((r.video_id, r.frame_idx) for r in out.collect()) == want and len(want) < len(rows)


def test_best_caption_is_that_of_all_pairs(spark):
    rng = random.Random(6)
    rows = [(v, f, t, round(rng.random(), 2)) for v in range(12) for f, t in enumerate(texts(rng, rng.choice((1, 2, 5, 30))))] + [(50, 0, "", 0.5), (50, 1, None, 0.5)]
    df = spark.createDataFrame(rows, "video_id int, frame_idx int, text string, score double")
    got = {r.video_id: (r.text, pytest.approx(r.score)) for r in cp.best_caption(df, ["video_id"]).collect()}
    for v in range(12):
        mine = [(t, s) for w, _, t, s in rows if w == v and t]
        first = {}
        for n, (t, _) in enumerate(mine):
            first.setdefault(t, n)
        scores = {t: [s for u, s in mine if u == t] for t in first}
        rank = lambda t: (len(scores[t]), sum(ratio(t, u) >= 0.8 for u, _ in mine), round(sum(ratio(t, u) for u, _ in mine), 9), sum(scores[t]) / len(scores[t]), len(t), -first[t])  # noqa: B023,E731
        best = max(first, key=rank)
        assert got[v] == (best, sum(scores[best]) / len(scores[best]))
    assert 50 not in got


# ---- intervals

def test_stabbing_spans_of_any_length(spark):
    rng = random.Random(7)
    spans = [(d, i, s, s + rng.choice((0.001, 0.3, 1, 2, 5, 60, 3600, 36_000, 0, -1))) for d in (1, 2) for i, s in enumerate(rng.uniform(-50, 40_000) for _ in range(80))]
    spans += [(1, 500, None, 3.0), (1, 501, 3.0, None), (1, 502, float("nan"), 4.0), (2, 503, 1.0, float("inf")), (2, 504, 4.0, 8.0), (2, 505, -8.0, -4.0)]
    points = [(d, rng.uniform(-60, 41_000)) for d in (1, 2, 3) for _ in range(200)] + [(1, None), (2, 4.0), (2, 8.0), (2, -4.0), (2, -8.0), (2, float("nan"))]
    df = spark.createDataFrame(spans, "doc_id int, idx long, start_s double, end_s double")
    got = sorted((r.doc_id, r.t, r.idx) for r in j.stabbed(spark.createDataFrame(points, "doc_id int, t double"), "t", df).collect())
    want = sorted((d, t, i) for d, t in points if t is not None for e, i, a, b in spans if d == e and a is not None and b is not None and a <= t < b)
    assert got == want and len(want) > 300
    assert j.stabbed(spark.createDataFrame(points, "doc_id int, t double"), "t", df.limit(0)).count() == 0


def test_a_long_span_is_few_rows(spark):
    spans = spark.createDataFrame([(1, 0, 5.0, 36_005.0)] + [(1, i, float(i), i + 1.0) for i in range(1, 200)], "doc_id int, idx long, start_s double, end_s double")
    points = spark.createDataFrame([(1, 100.5)], "doc_id int, t double")
    out = j.stabbed(points, "t", spans)
    assert sorted(r.idx for r in out.collect()) == [0, 100]
    level = j._level(F.col("start_s"), F.col("end_s"))
    cells = spans.select("idx", F.size(F.sequence(j._cell(F.col("start_s"), level), j._cell(F.col("end_s"), level))).alias("n")).collect()
    assert max(r.n for r in cells) <= 3


# ---- folds

def test_short_cues_with_nulls(spark):
    kind = "doc_id int, idx long, start_s double, end_s double, text string, translation string, speaker string"
    rows = [(1, 0, None, 1.0, "one", None, None), (1, 1, None, 1.2, None, "", ""), (1, 2, 1.3, None, "two", "", ""), (1, 3, None, None, None, None, None), (2, 0, None, None, None, None, None)]
    got = sg.merge_short(spark.createDataFrame(rows, kind)).orderBy("doc_id", "idx").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0.0, 1.3, "one two", "", ""), (2, 0, 0.0, 0.0, "", "", "")]


def test_captions_with_nulls(spark):
    rows = [(1, 0, 0.0, "here it is", None), (1, 1, 0.2, "here it is", 0.9), (1, 2, 0.4, None, None), (1, 3, None, "here it is", 0.9), (1, 4, 0.8, "and gone", float("nan"))]
    got = cp.merge_captions(spark.createDataFrame(rows, "video_id long, frame_idx long, stamp_s double, text string, score double"), fps=4).collect()
    assert [(r.start_s, r.end_s, r.text) for r in got] == [(0.0, 0.4, "here it is"), (0.8, 1.05, "and gone")]


def test_spots_and_clusters_are_the_first_that_fit(spark):
    rng = random.Random(8)
    boxes = [(1, f, n, rng.choice(("logo", "lago", "text")), rng.uniform(0, 80), rng.uniform(0, 60)) for f in range(40) for n in range(5)]
    heads, spots = [], []
    for _, f, n, t, x, y in boxes:
        at = next((i for i, (a, b) in enumerate(heads) if abs(x - a) <= 14 and abs(y - b) <= 10), len(heads))
        if at == len(heads):
            heads.append((x, y))
        spots.append(at)
    s = cp._Spots(1, 14.0, 10.0)
    assert [r[3] for b in boxes for r in s.take(dict(zip(("video_id", "frame_idx", "n", "text", "x", "y"), b)))] == spots and len(heads) > 8
    rows = [(1, i, rng.randrange(256), rng.randrange(256), rng.randrange(256), 1.0) for i in range(300)] + [(1, 900, None, 1, 1, 1.0), (2, 0, 1, 1, 1, None), (3, 0, 9, 9, 9, 2.0)]
    got = {r.video_id: tuple(r.rgb) for r in cp.dominant_color(spark.createDataFrame(rows, "video_id int, pos int, r int, g int, b int, weight double")).collect()}
    means = []
    for _, _, *c, w in rows[:300]:
        near = next((m for m in means if sum((a - b) ** 2 for a, b in zip(m, c)) ** 0.5 <= 60), None)
        if near is None:
            means.append([*map(float, c), w])
        else:
            near[:] = [*((a * near[3] + b * w) / (near[3] + w) for a, b in zip(near, c)), near[3] + w]
    assert got == {1: tuple(round(v) for v in max(means, key=lambda m: m[3])[:3]), 3: (9, 9, 9)}


@pytest.mark.parametrize("turned", [False, True])
def test_reads_of_one_moment_count_in_no_order(spark, turned):
    """The text is met at 7.0 first; what else is read at 7.0 is not after that, so that the cue ends where it did."""
    from cueloom.operators.joins import refine_boundaries

    cue = spark.createDataFrame([(1, 0, 2.0, 7.2, "rain", "", "")], "doc_id long, idx long, start_s double, end_s double, text string, translation string, speaker string")
    at_once = [(1, 7.0, "rain"), (1, 7.0, "other"), (1, 7.0, "")]
    fine = lambda *more: spark.createDataFrame([*(at_once[::-1] if turned else at_once), *more], "doc_id long, stamp_s double, text string").coalesce(1)
    assert refine_boundaries(cue, fine(), 0.5).first()["end_s"] == 7.2
    assert refine_boundaries(cue, fine((1, 7.1, "other")), 0.5).first()["end_s"] == 7.1
