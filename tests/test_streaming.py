"""Streams give what the batch operators give, whatever the triggers."""

import random

import pytest
from pyspark.sql import functions as F

from cueloom.operators.captions import merge_captions
from cueloom.operators.smoothing import Smoothing
from cueloom.operators.timing import check_timing
from cueloom.plans.relations import v_cues
from cueloom.sources import sinks, subtitles
from cueloom.streaming import run
from cueloom.streaming.captions import stream_merge_captions, stream_subtitle_qc

READS = "video_id long, frame_idx long, stamp_s double, text string, score double, at timestamp"


def videos(count=4, frames=60, seed=3):
    """Noisy reads: captions of some frames with odd letters, blanks and scraps between them."""
    rng = random.Random(seed)
    lines = ["the harbour lights go out", "she never wrote again", "nobody saw the ferry leave", "call me when it rains"]
    rows = []
    for v in range(count):
        now, left = "", 0
        for f in range(frames):
            if left == 0:
                now, left = rng.choice(lines + [""]), rng.randrange(3, 12)
            left -= 1
            text = now
            if now and rng.random() < 0.25:
                at = rng.randrange(len(now))
                text = now[:at] + rng.choice("xyz") + now[at + 1:]
            if rng.random() < 0.08:
                text = rng.choice(("C.15", "", "||", rng.choice(lines)))
            rows.append((v, f, f / 5, text, round(rng.uniform(0.6, 0.99), 3)))
    return rows


def with_time(spark, rows):
    return spark.createDataFrame(rows, READS.replace(", at timestamp", "")).withColumn("at", F.timestamp_seconds(F.col("stamp_s") + 100))


def captions(df, video="video_id"):
    return sorted((r[video], round(r.start_s, 6), round(r.end_s, 6), r.text) for r in df.collect())


class Landing:
    """A stream of what lands in a folder, a trigger at a time."""

    def __init__(self, spark, tmp_path, name, **settings):
        self.spark, self.source, self.name = spark, str(tmp_path / "in"), name
        spark.createDataFrame([], READS).write.parquet(self.source)
        stream = stream_merge_captions(spark.readStream.schema(READS).parquet(self.source), fps=5, **settings)
        with run.state_on_disk(spark):
            self.query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()

    def land(self, df):
        df.coalesce(1).write.mode("append").parquet(self.source)
        self.query.processAllAvailable()
        return captions(self.spark.sql(f"select * from {self.name}"))


def marker(spark, second):
    return spark.createDataFrame([(-1, None, None, None, None, second)], READS.replace("at timestamp", "at long")).withColumn("at", F.timestamp_seconds("at"))


@pytest.mark.parametrize("votes,flicker", [(1, False), (3, True)])
def test_captions_of_reads_out_of_order(spark, tmp_path, votes, flicker):
    """Within the delay reads may come in any order, in any triggers; smoothing looks ahead; last captions come out."""
    rows = videos()
    rng = random.Random(1)
    dealt = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 2.9))  # up to 2.9 s late
    name = f"caps_{votes}"
    landing = Landing(spark, tmp_path, name, delay="3 seconds", idle="1 minute", votes=votes, flicker=flicker)
    try:
        cut = [0, 70, 100, 180, len(dealt)]
        seen = [landing.land(with_time(spark, dealt[a:b])) for a, b in zip(cut, cut[1:])]
        got = landing.land(marker(spark, 10_000))
    finally:
        landing.query.stop()
    want = captions(merge_captions(with_time(spark, rows).drop("at"), fps=5, votes=votes, flicker=flicker), "doc_id")
    assert got == want and len(want) > 15
    assert 0 < len(seen[1]) < len(seen[-1]) < len(got)  # captions come out as they end, and the last ones by a timer


def test_a_late_read_is_dropped_and_an_idle_video_flushed(spark, tmp_path):
    rows = [(1, f, float(f), "first line", 0.9) for f in range(5)] + [(2, f, float(f), "other video", 0.9) for f in range(5)]
    landing = Landing(spark, tmp_path, "late", delay="2 seconds", idle="20 seconds")
    try:
        assert landing.land(with_time(spark, rows)) == []
        assert landing.land(with_time(spark, [(2, f, float(f), "other video", 0.9) for f in range(5, 40)])) == [(1, 0.0, 4.2, "first line")]  # the first video was idle
        late = with_time(spark, [(2, 2, 2.5, "too late", 0.99), (1, 50, 41.0, "back again", 0.9), (1, 51, 42.0, "back again", 0.9)])
        landing.land(late)
        got = landing.land(marker(spark, 500))
    finally:
        landing.query.stop()
    assert got == [(1, 0.0, 4.2, "first line"), (1, 41.0, 42.2, "back again"), (2, 0.0, 39.2, "other video")]


def test_smoothing_of_few_reads(spark):
    """Fewer reads than votes stay as they are; a memory that was stored goes on as it was."""
    import json

    reads = [(0.0, "a", 0.9), (1.0, "b", 0.8)]
    one = Smoothing(3, True, 0.8)
    assert [x for r in reads for x in one.take(r)] + one.end() == reads
    rows = [(f / 5, text, score) for v, f, _, text, score in videos(1, 80)]
    whole, out = Smoothing(3, True, 0.8), []
    for r in rows:
        out += whole.take(r)
    out += whole.end()
    again, memory = [], None
    for r in rows:
        s = Smoothing(3, True, 0.8, memory)
        again += s.take(r)
        memory = json.loads(json.dumps(s.memory))
    assert again + Smoothing(3, True, 0.8, memory).end() == out
    from cueloom.operators.captions import drop_flicker, stabilize_reads

    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], READS.replace(", at timestamp", ""))
    want = drop_flicker(stabilize_reads(df, 3, 0.8), 0.8).orderBy("frame_idx").collect()
    assert [(r.stamp_s, r.text, r.score) for r in want] == out and [r[1:] for r in rows] != [r[1:] for r in out]


def test_quality_check_of_files(spark, sf_dir, tmp_path):
    """Three triggers of mixed formats, a restart from the checkpoint in between, each file once."""
    cues = v_cues(spark, sf_dir).where("doc_id < 9")
    named = cues.withColumn("doc_id", F.concat(F.col("doc_id").cast("string"), F.element_at(F.array(F.lit(".srt"), F.lit(".vtt"), F.lit(".ass")), (F.col("doc_id") % 3 + 1).cast("int"))))
    texts = {r.doc_id: r.value for r in sinks.to_text(named).collect()}
    folder = tmp_path / "files"
    folder.mkdir()
    seen = {}

    def run_once():
        q = stream_subtitle_qc(subtitles.subtitle_file_stream(spark, str(folder)), lambda issues, batch: seen.setdefault(batch, issues.collect()))
        q = q.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()

    names = sorted(texts)
    for some in (names[:3], names[3:5], names[5:]):  # each run begins from the checkpoint of the one before
        for name in some:
            (folder / f"{name}.part").write_text(texts[name])
            (folder / f"{name}.part").rename(folder / name)
        run_once()
    run_once()  # nothing new
    assert len(seen) == 3 and {n.rsplit(".", 1)[1] for n in names} == {"srt", "vtt", "ass"}
    got = sorted((r.doc_id.rsplit("/", 1)[1], r.idx, r.kind) for rows in seen.values() for r in rows)
    files = spark.createDataFrame(list(texts.items()), "doc_id string, value string")
    assert got == sorted((r.doc_id, r.idx, r.kind) for r in check_timing(subtitles.read_subtitles(files)[0]).collect()) and len(got) > 50


def test_times_of_files_are_held_to_limits_as_decimals(spark):
    """Lengths of just 0.5 and 8 s and gaps of just 15 s are no issues, wherever in the file they stand."""
    from cueloom.operators.timing import check_timing
    from cueloom.sources.subtitles import read_subtitles

    clock = lambda ms: f"{ms // 3600000:02d}:{ms // 60000 % 60:02d}:{ms // 1000 % 60:02d},{ms % 1000:03d}"
    bounds, at = [], 1
    for k in range(300):
        bounds.append((at, at + (500, 8000)[k % 2]))
        at = bounds[-1][1] + 15000
    text = "\n".join(f"{n}\n{clock(a)} --> {clock(b)}\nhi\n" for n, (a, b) in enumerate(bounds, 1))
    shifted = "\n".join(f"{n}\n{clock(a + 372)} --> {clock(b + 372)}\nhi\n" for n, (a, b) in enumerate(bounds, 1))
    cues = read_subtitles(spark.createDataFrame([("a.srt", text), ("b.srt", shifted)], "doc_id string, value string"))[0]
    assert check_timing(cues).count() > 0 and check_timing(cues, digits=6).count() == 0


def test_videos_without_ended_captions_cost_no_frame_and_few_calls():
    """A first read takes one call each to append, to look up, to set a timer and to store; nothing is given out."""
    import pandas as pd

    from cueloom.streaming import captions

    class Handle:
        calls: list[str] = []

        def getListState(self, *_):
            return self

        getValueState = getListState

        def __getattr__(self, name):
            return lambda *_: self.calls.append(name)

    processor = captions._Captions(1_000, threshold=0.8, least=0.2, step=0.1, votes=1, flicker=False)
    processor.init(Handle())
    rows = pd.DataFrame([(1, 5, 0.1, "a", 0.5)], columns=["frame_idx", "at_ms", "stamp_s", "text", "score"])
    assert list(processor.handleInputRows((1,), iter([rows]), None)) == []
    assert sorted(Handle.calls) == ["appendList", "get", "registerTimer", "update"]
