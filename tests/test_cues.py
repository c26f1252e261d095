"""Golden cases of cue operators, formats and timing."""

import pytest
from pyspark.sql import functions as F

from cueloom.functions import text as tx, timecode as tc
from cueloom.operators import captions as cp, cues as c, joins as j, segments as sg, timing as t
from cueloom.sources import sinks, subtitles as sub

CUE = "doc_id long, idx long, start_s double, end_s double, text string, translation string, speaker string"


def cues(spark, *rows):
    return spark.createDataFrame([(1, i, float(s), float(e), *(list(r) + ["", "", ""])[:3]) for i, (s, e, *r) in enumerate(rows)], CUE)


def one(spark, **columns):
    return spark.range(1).select(*[v.alias(k) for k, v in columns.items()]).first()


@pytest.mark.parametrize("text,seconds", [("00:00:01,500", 1.5), ("01:02:03.250", 3723.25), ("0:00:02.05", 2.05), ("12.5", 12.5), ("x", None), ("", None), ("00:75:00,000", None), ("-3", None)])
def test_parse_timecode(spark, text, seconds):
    assert one(spark, t=tc.parse_timecode(F.lit(text))).t == seconds


def test_format_timecode(spark):
    r = one(spark, a=tc.format_srt(F.lit(3723.25)), b=tc.format_vtt(F.lit(3723.25)), c=tc.format_ass(F.lit(3723.25)), d=tc.format_srt(F.lit(-5.0)), e=tc.format_srt(F.lit(0.0005)))
    assert (r.a, r.b, r.c, r.d, r.e) == ("01:02:03,250", "01:02:03.250", "1:02:03.25", "00:00:00,000", "00:00:00,000")


def test_srt_with_a_broken_block(spark):
    text = "\ufeff7\n00:01:10,250 --> 00:01:12,000\nThe <i>kettle</i> sings\n\n8\n00:01:15,000 --> 00:01:19,125\nupper line\nlower line\n\njust a remark\n"
    found, rejects = sub.read_srt(spark.createDataFrame([("tea.srt", text)], "doc_id string, value string"))
    assert [(r.start_s, r.end_s, r.text) for r in found.orderBy("idx").collect()] == [(70.25, 72.0, "The kettle sings"), (75.0, 79.125, "upper line\nlower line")]
    assert [r.unit_no for r in rejects.collect()] == [3]


def test_vtt_and_ass(spark):
    vtt = "WEBVTT\n\nNOTE a remark\n\n00:02.500 --> 00:04.000 align:start\ngreen door\n\n01:00:00.000 --> 01:00:01.250\nred roof"
    ass = "[Script Info]\nTitle: t\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\nDialogue: 0,0:10:00.50,0:10:03.75,Default,Ada,0,0,0,,{\\pos(3,4)}well, then\\Ngo on\nComment: 0,0:11:00.00,0:11:02.50,Default,,0,0,0,,unseen"
    files = spark.createDataFrame([("p.vtt", vtt), ("q.ass", ass), ("r.txt", "first row\n\nsecond row")], "doc_id string, value string")
    found, rejects = sub.read_subtitles(files)
    rows = {k: [(r.start_s, r.end_s, r.text, r.speaker) for r in found.where(F.col("doc_id") == k).orderBy("idx").collect()] for k in ("p.vtt", "q.ass", "r.txt")}
    assert rows == {"p.vtt": [(2.5, 4, "green door", ""), (3600, 3601.25, "red roof", "")], "q.ass": [(600.5, 603.75, "well, then\ngo on", "Ada")], "r.txt": [(0, 3, "first row", ""), (3, 6, "second row", "")]}
    assert [r.doc_id for r in rejects.collect()] == ["r.txt"]


def test_round_trip(spark):
    x = cues(spark, (1, 2.5, "a"), (3, 4.25, "b\nc"))
    back = sub.read_srt(sinks.to_srt(x))[0].orderBy("idx").collect()
    assert [(r.start_s, r.end_s, r.text) for r in back] == [(1, 2.5, "a"), (3, 4.25, "b\nc")]


def test_overlap_gap_and_ratio(spark):
    kinds = lambda x: sorted(r.kind for r in t.check_timing(x).collect())
    assert kinds(cues(spark, (10, 14, "p"), (13.5, 16, "q"))) == ["overlap"]
    assert kinds(cues(spark, (5, 8, ""), (50, 53, "q"))) == ["empty", "gap"]
    assert kinds(cues(spark, (7, 11, "tiny", "y" * 44))) == ["ratio"]
    assert kinds(cues(spark, (1, 4, "rain on tin"), (4.25, 7, "dry by noon"))) == []
    fixed = t.remove_overlaps(cues(spark, (10, 14, "p"), (13.5, 16, "q"))).orderBy("idx").collect()
    assert [r.fixed for r in fixed] == [True, False] and fixed[0].end_s == pytest.approx(13.46)


def test_edits(spark):
    x = cues(spark, (4, 7, "boats leave at dawn", "erste"), (7.5, 9, "gulls follow", "zweite"), (12, 15, "nets dry"))
    merged = c.merge_cues(x, spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, idx long")).orderBy("idx").collect()
    assert [(r.idx, r.start_s, r.end_s, r.text) for r in merged] == [(0, 4, 9, "boats leave at dawn gulls follow"), (1, 12, 15, "nets dry")]
    halves, rejects = c.split_cues(x, spark.createDataFrame([(1, 0, 5.5), (1, 2, 14.99)], "doc_id long, idx long, t double"))
    assert [(r.text, r.end_s) for r in halves.orderBy("idx").collect()][:2] == [("boats leave", 5.5), ("at dawn", 7.0)]
    assert rejects.count() == 1


def test_cut_in_a_cue_without_length_is_a_reject(spark):
    halves, rejects = c.split_cues(cues(spark, (4, 4, "boats leave"), (5, 7, "gulls follow")), spark.createDataFrame([(1, 0, 4.0), (1, 1, 6.0)], "doc_id long, idx long, t double"))
    assert [(r.idx, r.start_s, r.end_s, r.text) for r in halves.orderBy("idx").collect()] == [(0, 4, 4, "boats leave"), (1, 5, 6, "gulls"), (2, 6, 7, "follow")]
    assert [(r.idx, r.t) for r in rejects.collect()] == [(0, 4.0)]


def test_merge_exact_repeats(spark):
    got = t.merge_exact_repeats(cues(spark, (20, 21, "echo"), (21.15, 22, "echo"), (22.5, 23, "echo"))).orderBy("idx").collect()
    assert [(r.start_s, r.end_s) for r in got] == [(20, 22), (22.5, 23)]


def test_voice_timeline(spark):
    x = cues(spark, (1, 3, "a"), (3.5, 6, "b"), (9, 10, "c"))
    voices = spark.createDataFrame([(1, 0, 4.0), (1, 1, 1.5), (1, 2, 2.25)], "doc_id long, idx long, voice_s double")
    timings, lengths = t.voice_timeline(x, voices, spark.createDataFrame([(1, 10.5)], "doc_id long, total_s double"))
    # spans are 4 (the voice), 5.5 (up to the next cue) and 2.25 (the voice), end to end, and half a second is left over
    assert [(r.new_start, r.new_end) for r in timings.orderBy("idx").collect()] == [(1, 5), (5, 10.5), (10.5, 12.75)]
    assert lengths.first().total_s == pytest.approx(13.25)


def test_cue_at(spark):
    x = cues(spark, (0, 1, "a"), (2, 3, "b"))
    probes = spark.createDataFrame([(1, 0.5), (1, 1.5), (1, 2.5)], "doc_id long, t double")
    assert [r.idx for r in j.cue_at(x, probes).orderBy("t").collect()] == [0, -1, 1]


def test_no_cross_join_in_interval_joins(spark):
    x = cues(spark, (0, 1, "a"), (2, 3, "b"))
    plan = j.align_translations(x, x)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_merge_short(spark):
    rows = [(0, 2, "one"), (2.1, 2.4, "up"), (2.6, 3.0, "and"), (3.6, 4.0, "away"), (4.1, 12, "long")]
    got = [(r.idx, r.start_s, r.end_s, r.text) for r in sg.merge_short(cues(spark, *rows)).orderBy("idx").collect()]
    # "away" begins 0.6 s after "and", too late to join; "long" isn't short
    assert got == [(0, 0, 3.0, "one up and"), (1, 3.6, 4.0, "away"), (2, 4.1, 12, "long")]
    many = [(k * 1.3, k * 1.3 + (0.3 if k % 3 else 1.1), f"w{k}") for k in range(3000)]
    assert 0 < sg.merge_short(cues(spark, *many)).count() < 3000


def brute_pack(parts, limit, joint):
    out = []
    for part in parts:
        if out and len(out[-1]) + len(joint) + len(part) <= limit:
            out[-1] += joint + part
        else:
            out.append(part)
    return out


def test_packing_of_long_and_unspaced_lines(spark):
    import random

    rng = random.Random(4)
    lines = [" ".join("x" * rng.randint(1, 30) for _ in range(n)) for n in (1, 2, 50, 400, 4000)] + ["y" * 130, "短い。" * 40, "a,b;c!d?" * 30, ""]
    got = spark.createDataFrame(list(enumerate(lines)), "k int, text string").select(
        "k", tx.split_by_length(F.col("text"), 60).alias("parts"), tx.wrap_lines(F.col("text"), 42, 3).alias("kept"), tx.wrap_lines(F.col("text"), 42, 3, "truncate").alias("cut")).orderBy("k").collect()
    for r, line in zip(got, lines):
        if " " in line:
            assert r.parts == brute_pack(line.split(" "), 60, " ")
            wrapped = brute_pack(line.split(" "), 42, " ") if len(line) > 42 else [line]
            assert r.cut == "\n".join(wrapped[:3]) and r.kept == "\n".join(wrapped[:3]) + "".join(f" {w}" for w in wrapped[3:])
        else:
            assert "".join(r.parts) == line and all(len(p) <= 60 for p in r.parts) and r.kept.replace("\n", "") == line


def test_resegment(spark):
    words = "several words that go on beyond what two lines of a subtitle can ever hold at a time so they are cut"
    got = sg.resegment(cues(spark, (0, 10, words), (10.1, 10.4, "yes")), 20, 2).orderBy("idx").collect()
    assert " ".join(r.text.replace("\n", " ") for r in got) == words + " yes" and got[0].start_s == 0 and got[-1].end_s == 10.4
    assert all(len(r.text.split("\n")[0]) <= 20 and len(r.text) <= 40 for r in got[:-1]) and [r.start_s for r in got[1:]] == pytest.approx([r.end_s for r in got[:-1]])
    cut = sg.resegment(cues(spark, (0, 9, "abcdefghi " * 3 + "x" * 30)), 12, 2, on_overflow="truncate").collect()
    assert all(len(r.text.split("\n")) <= 2 for r in cut)


def test_long_unspaced_text(spark):
    text = "山路很长，雾还没有散。我们慢慢走，不用着急！到了山顶再休息。"
    parts = one(spark, p=tx.split_by_length(F.lit(text), 12)).p
    assert "".join(parts) == text and max(map(len, parts)) <= 12


def test_punctuation(spark):
    assert one(spark, p=tx.normalize_punctuation(F.lit("tic-tac，toc ;  done 。really？yes"))).p == "tic-tac, toc; done. really? yes"


def reads(spark, *rows):
    return spark.createDataFrame([(1, i, float(s), t_, float(sc)) for i, (s, t_, sc) in enumerate(rows)], "video_id long, frame_idx long, stamp_s double, text string, score double")


def test_captions_from_stamps(spark):
    got = cp.merge_captions(reads(spark, (3, "", 0), (3.4, "hello", .8), (3.8, "hello", .7), (4.2, "", 0)), fps=2.5).collect()
    assert [(r.start_s, r.end_s, r.text) for r in got] == [(3.4, 4.2, "hello")]


def test_captions_drift_and_vote(spark):
    """A caption that grows word by word is one; the text with most reads is its text; another text ends it."""
    said = ["quiet", "quiet river", "quiet river bends", "quiet river bends", "quiet rivor bends", "quiet river bends", "harbour lights", "harbour lights", ""]
    got = cp.merge_captions(reads(spark, *[(k * 0.5, t_, .9) for k, t_ in enumerate(said)]), fps=2, flicker=False).orderBy("idx").collect()
    assert [(r.start_s, r.end_s, r.text) for r in got] == [(0, 3, "quiet river bends"), (3, 4, "harbour lights")]


def test_support_of_texts_is_the_sum_over_reads():
    import random

    from cueloom.functions.fuzzy import ratio

    rng = random.Random(2)
    said = [("".join(rng.choice("abc") for _ in range(rng.randint(2, 6))), rng.random()) for _ in range(60)]
    support = cp.Support(0.7)
    for text, score in said:
        support.add(text, score)
    texts = list(dict.fromkeys(t_ for t_, _ in said))
    rank = lambda t_: (sum(x == t_ for x, _ in said), sum(ratio(t_, x) >= 0.7 for x, _ in said), round(sum(ratio(t_, x) for x, _ in said), 9),
                       sum(sc for x, sc in said if x == t_) / sum(x == t_ for x, _ in said), len(t_))
    assert support.best() == max(texts, key=rank)
    assert cp.Support(0.7, support.dump()).best() == support.best() and len(support.dump()) == len(texts)


def test_best_caption(spark):
    r = reads(spark, (0, "low tide", .5), (1, "low tlde", .9), (2, "low tide", .6), (3, "", .9))
    got = cp.best_caption(r, ["video_id"]).first()
    assert got.text == "low tide" and got.score == pytest.approx(.55)


def test_consensus_and_flicker(spark):
    r = reads(spark, (0, "orange crate", .92), (1, "orenge crate", .6), (2, "orange crate", .97))
    assert {x.text for x in cp.stabilize_reads(r, 3, 0.7).collect()} == {"orange crate"}
    odd = reads(spark, (0, "under the bridge", .8), (1, "##!!??//::;;", .9), (2, "under the bridge", .85))
    assert [x.text for x in cp.drop_flicker(odd).orderBy("frame_idx").collect()] == ["under the bridge"] * 3


BOX = "struct<n:int,text:string,score:double,rect:struct<x1:double,y1:double,x2:double,y2:double>>"


def test_boxes_of_a_frame(spark):
    df = spark.createDataFrame([([(1, "below", .6, (20., 80., 120., 110.)), (2, "above", 1., (20., 20., 120., 50.)), (3, "within", .9, (24., 22., 60., 46.))],)], f"b array<{BOX}>")
    r = df.select(cp.join_rows(cp.drop_overlaps(F.col("b"))).alias("r")).first().r
    assert r.text == "above below" and r.score == pytest.approx(.8)
    split = spark.createDataFrame([([(1, "rowing bo", 1., (200., 0., 330., 30.)), (2, "boat race", 1., (310., 1., 470., 31.))],)], f"b array<{BOX}>")
    assert split.select(cp.join_rows(F.col("b")).alias("r")).first().r.text == "rowing boat race"


def test_reading_order(spark):
    df = spark.createDataFrame([([(1, "d", 1., (300., 52., 400., 80.)), (2, "a", 1., (10., 8., 90., 40.)), (3, "c", 1., (20., 50., 90., 82.)), (4, "b", 1., (100., 5., 190., 36.))],)], f"b array<{BOX}>")
    assert [x.b.text for x in df.select(cp.reading_order(F.col("b")).alias("o")).first().o] == ["a", "b", "c", "d"]


def test_static_texts(spark):
    """A logo stays on its place in most frames; captions come and go."""
    boxes = [(1, f, 1, "CHANNEL 9" if f % 7 else "CHANNEL g", 500. + f % 3, 20. + f % 2) for f in range(20)] + [(1, f, 2, f"caption {f // 4}", 200., 300.) for f in range(20)]
    got = cp.static_texts(spark.createDataFrame(boxes, "video_id long, frame_idx long, n int, text string, x double, y double"), spark.createDataFrame([(1, 20)], "video_id long, frames long"))
    assert sorted(r.text for r in got.collect()) == ["channel 9", "channel g"]


def test_refine_boundaries(spark):
    x = cues(spark, (2, 4, "tin roof"), (4, 6, "slow rain"))
    fine = [(1, s, "tin roof" if 1.7 <= s < 3.8 else "slow rain" if 3.8 <= s < 5.7 else "") for s in (1.5, 1.6, 1.7, 1.8, 1.9, 2.0, 3.6, 3.7, 3.8, 3.9, 4.0, 5.5, 5.6, 5.7, 5.8)]
    got = j.refine_boundaries(x, spark.createDataFrame([(d, float(s), t_) for d, s, t_ in fine], "doc_id long, stamp_s double, text string"), 0.5).orderBy("idx").collect()
    assert [(r.start_s, r.end_s) for r in got] == [(1.7, 3.8), (3.8, 5.7)]


def test_dominant_color(spark):
    rows = [(1, 0, 250, 240, 20, 3.0), (1, 1, 10, 10, 10, 4.0), (1, 2, 240, 250, 30, 3.0), (1, 3, 245, 245, 25, 2.0)]
    got = cp.dominant_color(spark.createDataFrame(rows, "video_id long, pos int, r int, g int, b int, weight double")).first().rgb
    assert (got.r, got.g, got.b) == (245, 245, 25)


def test_costly_rows_of_one_file_are_spread(spark, tmp_path, sf_dir):
    from cueloom.operators.spread import tasks_of
    from cueloom.plans import registry

    spark.read.parquet(f"{sf_dir}/part.parquet").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    got = registry.QUERIES["estimate_pitch"](spark, str(tmp_path))
    assert got.rdd.getNumPartitions() == tasks_of(got) >= 8 * spark.sparkContext.defaultParallelism
    assert got.count() == spark.read.parquet(f"{sf_dir}/part.parquet").count()


def test_captions_from_detections(spark):
    rect = (10., 10., 200., 40.)
    rows = [(1, f, f / 10, 1, "paper lantern" if f < 10 else "", .95, rect) for f in range(12)] + [(1, f, f / 10, 2, "noise", .2, (300., 10., 350., 40.)) for f in range(12)]
    kind = "video_id long, frame_idx long, stamp_s double, n int, text string, score double, rect struct<x1:double,y1:double,x2:double,y2:double>"
    got = cp.captions_from_detections(spark.createDataFrame([r for r in rows if r[4]], kind), fps=10).collect()
    assert [(r.text, r.start_s) for r in got] == [("paper lantern", 0.0)] and got[0].end_s == pytest.approx(1.0)


def test_estimate_pitch(spark):
    from math import pi, sin

    from cueloom.operators.audit import estimate_pitch

    waves = [[int(9000 * sin(2 * pi * hz * k / 16000)) for k in range(8000)] for hz in (110, 220)] + [[0] * 8000]
    got = [r.p for r in spark.createDataFrame([(i, w) for i, w in enumerate(waves)], "k int, w array<int>").select("k", estimate_pitch("w", F.lit(16000)).alias("p")).orderBy("k").collect()]
    assert got[0] == pytest.approx(110, rel=.03) and got[1] == pytest.approx(220, rel=.03) and got[2] == 0


def test_save_and_read_again(spark, tmp_path):
    x = cues(spark, (1, 2.5, "slate"), (3, 4.25, "two\nlines"))
    sinks.save_subtitles(x, str(tmp_path / "out"))
    values = [f.read_text() for f in (tmp_path / "out").rglob("*") if f.is_file() and not f.name.startswith((".", "_"))]
    back = sub.read_srt(spark.createDataFrame([("a", "\n".join(values))], "doc_id string, value string"))[0].orderBy("idx").collect()
    assert [(r.start_s, r.end_s, r.text) for r in back] == [(1, 2.5, "slate"), (3, 4.25, "two\nlines")]


def test_colours_and_regions(spark):
    rgb = lambda r, g, b: F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b"))
    names = one(spark, a=tx.color_name(rgb(230, 225, 228)), b=tx.color_name(rgb(30, 30, 60)), c=tx.color_name(rgb(200, 40, 60)), d=tx.color_name(F.lit(None).cast("struct<r:int,g:int,b:int>")), e=tx.color_name(rgb(100, 100, 110)))
    assert tuple(names) == ("trang", "den", "do", "chua ro", "xam")
    from cueloom.functions import geometry as geo

    region = F.struct(F.lit(100).alias("x"), F.lit(800).alias("y"), F.lit(1000).alias("w"), F.lit(200).alias("h"))
    size = lambda *v: [F.lit(x) for x in v]
    r = one(spark, a=geo.scale_region(region, *size(1920, 1080, 960, 540)), b=geo.scale_region(F.lit(None).cast("struct<x:int,y:int,w:int,h:int>"), *size(0, 0, 1000, 500)), c=geo.scale_region(region, *size(1920, 1080, 0, 540)))
    assert tuple(r.a) == (50, 400, 500, 100) and tuple(r.b) == (50, 350, 900, 140) and r.c is None


LEGACY = {"utf-8": "naïve — 雨", "utf-8-sig": "naïve — 雨", "utf-16": "naïve — 雨", "gb18030": "下雨了，把窗户关上吧。晚上还要上课", "big5": "下雨了，把窗戶關上吧。晚上還要上課",
          "shift_jis": "雨が降ってきたので、窓を閉めてください", "cp949": "비가 오니까 창문을 닫아 주세요", "cp1252": "Le café fermé à huit heures, déjà"}


@pytest.mark.parametrize("encoding", LEGACY)
def test_encodings(spark, tmp_path, encoding):
    from cueloom.sources.decoding import read_encoded_files

    (tmp_path / "a.srt").write_bytes(LEGACY[encoding].encode(encoding))
    assert read_encoded_files(spark, str(tmp_path)).first().value == LEGACY[encoding]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_static_texts_folds_its_boxes_once(spark):
    boxes = spark.createDataFrame([(1, f, 0, "Live", 5.0, 5.0) for f in range(10)], "video_id long, frame_idx long, n int, text string, x double, y double")
    frames = spark.createDataFrame([(1, 10)], "video_id long, frames long")
    got = cp.static_texts(boxes, frames)
    assert _plan(got).split("== Initial Plan ==")[0].count("MapInArrow") == 1
    assert [tuple(r) for r in got.collect()] == [(1, "live")]


def test_a_spot_is_seen_once_a_frame(spark):
    """Two boxes of a frame at one spot are one sight of it: 7 frames aren't 8."""
    kinds = "video_id long, frame_idx long, n int, text string, x double, y double"
    frames = spark.createDataFrame([(1, 10)], "video_id long, frames long")
    rows = [(1, f, n, "Live", 5.0 + n, 5.0) for f in range(7) for n in range(2)]
    assert cp.static_texts(spark.createDataFrame(rows, kinds), frames).count() == 0
    assert cp.static_texts(spark.createDataFrame([*rows, (1, 7, 0, "Live", 5.0, 5.0)], kinds), frames).count() == 1


def test_best_caption_looks_for_alike_texts_only_on_ties(spark, monkeypatch):
    asked, found = [], cp.alike_pairs
    monkeypatch.setattr(cp, "alike_pairs", lambda left, right, *more: asked.append((left.count(), right.count())) or found(left, right, *more))
    rows = [(1, i, t, 0.5) for i, t in enumerate(["paper lantern", "paper lantern", "paper lxntern"])] + [(2, i, t, 0.5) for i, t in enumerate(["rain at noon", "call me", "call mx"])]
    rows += [(None, 1, "no video", 0.5)]
    got = cp.best_caption(spark.createDataFrame(rows, "video_id long, frame_idx long, text string, score double"), ["video_id"]).collect()
    assert asked == [(3, 3)]
    assert {tuple(r) for r in got} == {(1, "paper lantern", 0.5), (2, "call me", 0.5), (None, "no video", 0.5)}


def test_rows_of_frames_are_made_once(spark):
    """They go through a shuffle before they are dealt out by ranges, which reads them twice."""
    boxes = spark.createDataFrame([(1, 1, 0.1, 0, "a", 0.9, (0.0, 0.0, 9.0, 9.0))], "video_id long, frame_idx long, stamp_s double, n int, text string, score double, rect struct<x1:double,y1:double,x2:double,y2:double>")
    plan = _plan(cp.captions_from_detections(boxes))
    below = plan[plan.index("rangepartitioning"):]
    assert "hashpartitioning(video_id" in below[: below.index("aggregate(")] if "aggregate(" in below else False


def test_strip_and_times_hold_their_text_once(spark):
    from cueloom.functions.timecode import parse_timecode, strip

    nested = strip(strip(strip(strip(F.col("sometext")))))
    assert str(nested).count("sometext") == 1 and str(parse_timecode(F.col("sometext"))).count("sometext") == 1
    blanks = "".join(c for c in map(chr, range(0x3001)) if c in "\t\n\x0b\x0c\r \x85\xa0     　" or 0x2000 <= ord(c) <= 0x200a)
    texts = [f"{b}x{b}y{b}{b}" for b in blanks] + ["\x1cx​", "", blanks]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert rows.where(~strip(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0
