"""Folds in pieces give what a fold of each key in one task gives, wherever the rows are cut."""

import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from cueloom.operators import captions as cp, folds


@contextmanager
def many_tasks(spark, n):
    """So many partitions after a shuffle, small ones too."""
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def reads(seed, videos=3, frames=400, blanks=0.2):
    rng = random.Random(seed)
    lines = ["the harbour lights go out", "she never wrote again", "nobody saw the ferry leave"]
    out, now, left = [], "", 0
    for v in range(videos):
        for f in range(frames if v else frames * 4):  # one video has most of the rows
            if left == 0:
                now, left = (rng.choice(lines), rng.randrange(2, 9)) if rng.random() > blanks else ("", rng.randrange(1, 5))
            left -= 1
            text = now if rng.random() > 0.2 or not now else now[:-1] + rng.choice("xyz")
            out.append((v, f, f / 5, "" if rng.random() < 0.05 else text, round(rng.uniform(0.5, 1), 3)))
    return out


def one_by_one(rows, votes, flicker):
    out = []
    for v in sorted({r[0] for r in rows}):
        state, found = cp._Captions(0.8, 0.2, 0.2, votes if flicker else 1, flicker), []
        for _, _, stamp, text, score in sorted(r for r in rows if r[0] == v):
            found += state.take({"stamp_s": stamp, "text": text, "score": score})
        out += [(v, n, *c) for n, c in enumerate(found + state.end())]
    return out


@pytest.mark.parametrize("votes,flicker,remembered,blanks", [(1, False, 50_000, 0.2), (3, True, 50_000, 0.3), (3, True, 15, 0.2), (5, True, 50_000, 0.3), (1, True, 5, 0.0)])
def test_captions_in_pieces(spark, monkeypatch, votes, flicker, remembered, blanks):
    monkeypatch.setattr(folds, "REMEMBERED", remembered)
    rows = reads(votes + remembered, blanks=blanks)
    with many_tasks(spark, 23):
        df = spark.createDataFrame(rows, "video_id long, frame_idx long, stamp_s double, text string, score double").repartition(7)
        got = sorted(tuple(r) for r in cp.merge_captions(df, fps=5, votes=votes, flicker=flicker).collect())
    assert got == one_by_one(rows, votes, flicker) and len(got) > 100


def test_a_large_video_is_spread_over_tasks(spark):
    """Rows of one video are dealt over many tasks, and few go on to the second pass."""
    rows = [r for r in reads(1, videos=1, frames=1500)]
    df = spark.createDataFrame(rows, "video_id long, frame_idx long, stamp_s double, text string, score double")
    with many_tasks(spark, 16):
        spread = df.repartitionByRange("video_id", "frame_idx").groupBy(F.spark_partition_id()).count().collect()
        plan = cp.merge_captions(df, fps=5)._jdf.queryExecution().executedPlan().toString()
    assert len(spread) > 8 and max(r["count"] for r in spread) < 0.2 * len(rows)
    assert "rangepartitioning(video_id" in plan


def test_spaced_stamps_in_pieces(spark):
    rng = random.Random(9)
    stamps = sorted({(v, round(rng.uniform(0, 300), 2)) for v in (1, 2) for _ in range(900)} | {(1, 1000.0), (1, 1000.5)})
    want = []
    for v in (1, 2):
        last = None
        for w, t in stamps:
            if w == v and (last is None or t >= last + 0.5 - min(0.005, 0.0125)):
                want.append((v, t))
                last = t
    with many_tasks(spark, 13):
        out = cp.downsample_min_gap(spark.createDataFrame([*stamps, (1, None)], "video_id long, stamp_s double").repartition(5), 2.0)
        got = sorted(tuple(r) for r in out.collect())
    assert got == want
    assert cp.downsample_min_gap(spark.createDataFrame([], "video_id long, stamp_s double"), 2.0).count() == 0
