"""Names, caches on storage, audio headers, overlays and order statistics, against brute force and the standard library."""

import io
import os
import random
import struct
import unicodedata
import wave

import pytest
from pyspark.sql import functions as F

from cueloom.operators import audit
from cueloom.operators.captions import height_range
from cueloom.sources import sinks


# ---- names

def named_one_by_one(rows, existing):
    taken = {(f, s) for f, s in existing if s is not None} | {(f, r) for _, f, _, r in rows if r is not None}
    out = []
    for i, folder, stem, remembered in sorted(rows):
        if remembered is not None:
            out.append((i, folder, remembered))
            continue
        n, name = 0, stem
        while (folder, name) in taken:
            n += 1
            name = f"{stem}_{n}"
        taken.add((folder, name))
        out.append((i, folder, name))
    return sorted(out)


def given(spark, rows, existing):
    df = spark.createDataFrame(rows, "id long, folder string, name string, remembered string").repartition(3)
    return sorted(tuple(r) for r in sinks.output_names(df, spark.createDataFrame(existing, "folder string, stem string")).collect())


def test_names_that_clash(spark):
    rows = [(1, "f", "a", None), (2, "f", "a", None), (3, "f", "a_1", None), (4, "f", "b", "kept"), (5, "f", "b", None), (6, "f", "kept", None), (7, "g", "a", None)]
    existing = [("f", "a"), ("f", "a_2"), ("f", "a"), ("f", None)]
    want = [(1, "f", "a_1"), (2, "f", "a_3"), (3, "f", "a_1_1"), (4, "f", "kept"), (5, "f", "b"), (6, "f", "kept_1"), (7, "g", "a")]
    assert given(spark, rows, existing) == want == named_one_by_one(rows, existing)


@pytest.mark.parametrize("seed", range(4))
def test_names_against_one_by_one(spark, seed):
    rng = random.Random(seed)
    stem = lambda: rng.choice("abcdefgh") + "".join(rng.choice(("", "", "_1", "_2", "_10", "_01", "_0")) for _ in range(rng.randrange(3)))
    rows = [(i, rng.choice("xy"), stem() if seed else rng.choice("ab"), stem() if rng.random() < 0.1 else None) for i in range(250)]
    existing = [(rng.choice("xyz"), stem()) for _ in range(40)]
    assert given(spark, rows, existing) == named_one_by_one(rows, existing)


def test_names_are_composed_and_safe(spark):
    composed = lambda name: spark.createDataFrame([(name,)], "n string").select(sinks.safe_name(F.col("n")).alias("s")).first().s
    assert composed("Phở é") == unicodedata.normalize("NFC", "Phở é") and composed("con.txt") == "_con.txt"
    assert composed("  a:b\t c. ") == "a_b_c" or composed("  a:b\t c. ") == "a_b_ c"
    assert composed(None) == composed("") == composed(" .. ") == "project" and len(composed("x" * 200)) == 80
    assert sinks.output_names(spark.createDataFrame([], "id long, folder string, name string"), spark.createDataFrame([], "folder string, stem string")).count() == 0


# ---- the frame cache

def test_only_touched_folders_are_written(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    kind = "cache_key string, frame_idx long, version long, rows_json string, clash string"
    rows = lambda *r: spark.createDataFrame([(*x, "c") for x in r], kind)
    sinks.save_frame_cache(path, rows(("k1", 0, 1, "[]"), ("k1", 1, 1, "old"), ("k2", 0, 1, "[]"), ("k3", 5, 1, "[]")), str(tmp_path / "s1"))
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    before = files()
    sinks.save_frame_cache(path, rows(("k1", 1, 1, "new"), ("k1", 2, 3, "[]"), ("k1", 0, 0, "stale"), ("k4", 0, 1, "[]")), str(tmp_path / "s2"))
    after = files()
    same = {f for f in before if after.get(f) == before[f]}
    assert {f.split("cache_key=")[1][:2] for f in same} == {"k2", "k3"} and {f.split("cache_key=")[1][:2] for f in set(after) - same} == {"k1", "k4"}
    cache = audit.open_frame_cache(spark, path)
    assert sorted(tuple(r) for r in cache.select("cache_key", "frame_idx", "rows_json").collect()) == [
        ("k1", 0, "[]"), ("k1", 1, "new"), ("k1", 2, "[]"), ("k2", 0, "[]"), ("k3", 5, "[]"), ("k4", 0, "[]")]
    plan = audit.read_frame_cache(cache, "k2", 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cache_key" in plan and "k2" in plan.split("PartitionFilters")[1].split("]")[0]
    some = rows(("k1", 1, 9, "[]"), ("k3", 1, 9, "[]"))
    scanned = sinks._of_keys(cache, some)
    assert "PartitionFilters: [cache_key" in scanned._jdf.queryExecution().executedPlan().toString() and {os.path.basename(os.path.dirname(f)) for f in scanned.inputFiles()} >= {"cache_key=k1", "cache_key=k3"}
    monkeypatch.setattr(sinks, "LISTED_KEYS", 1)
    assert sorted(tuple(r) for r in sinks._of_keys(cache, some).select("cache_key", "frame_idx").collect()) == sorted(tuple(r) for r in scanned.select("cache_key", "frame_idx").collect())
    assert audit.read_frame_cache(cache, "k3", 10).count() == 1 and audit.read_frame_cache(cache, "k3", 5).count() == 0


CACHE = "cache_key string, frame_idx long, version long, rows_json string"
ODD = ["k", "a/b:c%41", "\u00fc {x}[y]^#'*?\\\"", " x ", "k=1", "007", "2024-01-01", "null", "tab\tline\nend"]


def _cached(cache):
    return sorted(tuple(r) for r in cache.select("cache_key", "frame_idx", "version", "rows_json").collect())


def _files(path):
    return sorted(os.path.join(os.path.relpath(d, path), f) for d, _, fs in os.walk(path) for f in fs)


def test_a_key_has_one_file_and_nothing_beside_it(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = lambda v: spark.createDataFrame([(k, i, v, f"{k} {v}") for k in ODD for i in range(v, v + 9)], CACHE)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # a key's rows come in several batches
    try:
        for v in (1, 2):
            sinks.save_frame_cache(path, rows(v), str(tmp_path / f"s{v}"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = sorted((k, i, 1 if i < 2 else 2, f"{k} {1 if i < 2 else 2}") for k in ODD for i in range(1, 11))
    assert _cached(audit.whole_frame_cache(spark, path)) == _cached(audit.open_frame_cache(spark, path)) == want
    assert len(_files(path)) == len(ODD) + 1 and len(os.listdir(path)) == len(ODD) + 1
    assert all(audit.read_frame_cache(audit.open_frame_cache(spark, path).withColumn("rows_json", F.lit("[]")), k, 99).count() == 10 for k in ODD)


def test_names_of_folders_are_those_of_spark(spark):
    from cueloom.sources import folders

    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    for c in [chr(i) for i in range(1, 400)] + ["%41", "%4", "a%zzb", "\U0001f600"]:
        assert folders.folder_name("k", c) == "k=" + escape.escapePathName(c) and folders.value_of(folders.folder_name("k", c)) == c
    assert folders.value_of(folders.folder_name("k", None)) is None and folders.folder_name("k", "") == folders.folder_name("k", None)


def test_caches_of_both_writers_are_upserted_by_both(spark, tmp_path, monkeypatch):
    from cueloom.sources import folders

    path, mounted = str(tmp_path / "cache"), folders.mounted
    rows = lambda *r: spark.createDataFrame(list(r), CACHE)
    want = {}
    for n, own in enumerate((False, True, True, False, True)):
        monkeypatch.setattr(folders, "mounted", mounted if own else lambda *_: None)
        monkeypatch.setattr(sinks, "CACHE_FRAMES", (2, 2, 3, 3, 2)[n])  # several files a key
        new = [(k, i, n, f"{n}") for k in ("a", "b/c") for i in range(n, n + 5)] + [("a", 0, -1, "stale"), (f"only {n}", 0, n, ""), (None, 0, 9, "no key"), ("", 0, 9, "no key")]
        sinks.save_frame_cache(path, rows(*new), str(tmp_path / f"s{n}"))
        for k, i, v, text in new:
            if k and v >= want.get((k, i), (-9,))[0]:
                want[k, i] = v, text
        for read in (audit.open_frame_cache, audit.whole_frame_cache):
            assert _cached(read(spark, path)) == sorted((k, i, *x) for (k, i), x in want.items())


def test_an_upsert_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    from cueloom.sources import folders

    path = str(tmp_path / "cache")
    rows = lambda v: spark.createDataFrame([(f"k{k}", 0, v, "[]") for k in range(20 * v)], CACHE)
    sinks.save_frame_cache(path, rows(1), str(tmp_path / "s1"))
    before, was = _files(path), _cached(audit.open_frame_cache(spark, path))

    class Full(folders.ParquetFile):
        def close(self):
            super().close()
            if self.path.split("/")[-2] == "cache_key=k31":
                raise OSError("no space")

        def __init__(self, path, first):
            super().__init__(path, first)
            self.path = path

    monkeypatch.setattr(folders, "ParquetFile", Full)
    with pytest.raises(Exception, match="no space"):
        sinks.save_frame_cache(path, rows(2), str(tmp_path / "s2"))
    assert [f for f in _files(path) if "/." not in f] == before and _cached(audit.open_frame_cache(spark, path)) == _cached(audit.whole_frame_cache(spark, path)) == was


def test_folders_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from cueloom.operators import spread

    rows = spark.range(60).select(F.col("id").cast("string").alias("k"), "id")
    monkeypatch.setattr(spread, "FILES_A_TASK", 1)
    by_key = spread.spread_files(rows, "k", rows, F.floor(F.col("id") / 7))
    assert by_key.rdd.getNumPartitions() == 60 and by_key.count() == 60
    monkeypatch.setattr(spread, "FILES_A_TASK", 500)
    assert spread.spread_files(rows, "k", rows).rdd.getNumPartitions() == 8 * spark.sparkContext.defaultParallelism
    seen = []
    monkeypatch.setattr(sinks, "spread_files", lambda df, *a: seen.append(a[0]) or spread.spread_files(df, *a))
    sinks.save_frame_cache(str(tmp_path / "cache"), spark.createDataFrame([("k1", 0, 1, "[]")], "cache_key string, frame_idx long, version long, rows_json string"), str(tmp_path / "s"))
    assert seen == ["cache_key"] and audit.open_frame_cache(spark, str(tmp_path / "cache")).count() == 1


def test_configurations_of_one_file_are_spread(spark):
    from cueloom.operators.spread import tasks_of

    value = '{"data_table": [["1", "00:00:01,000 --> 00:00:02,500", "A", " x ", "y"]]}'
    got = audit.read_config_cues(spark.createDataFrame([(i, "n", value) for i in range(50)], "id long, name string, value string").coalesce(1))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id#" in plan and f", {tasks_of(got)}), REPARTITION_BY_NUM" in plan and plan.count("hashpartitioning") == 1
    assert [tuple(r)[1:] for r in got.distinct().collect()][0] == (0, 1.0, 2.5, "x", "y", "A") and got.count() == 50


def test_subtitles_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from cueloom.operators import spread

    seen = []
    monkeypatch.setattr(sinks, "spread_files", lambda df, *a: seen.append(spread.spread_files(df, *a).rdd.getNumPartitions()) or spread.spread_files(df, *a))
    cue = spark.range(40).select(F.concat(F.col("id").cast("string"), F.lit(".srt")).alias("doc_id"), F.lit(0).cast("long").alias("idx"), F.lit(1.0).alias("start_s"), F.lit(2.0).alias("end_s"), F.lit("t").alias("text"), F.lit("").alias("translation"), F.lit("").alias("speaker"))
    sinks.save_subtitles(cue, str(tmp_path / "out"))
    assert seen == [8 * spark.sparkContext.defaultParallelism] and spark.read.text(str(tmp_path / "out"), wholetext=True).count() == 40


def _slates(spark, ids):
    rows = [(d, i, i + 1.0, i + 2.0, f"{d} {i}", "", "") for d in ids for i in range(3)]
    return spark.createDataFrame(rows, "doc_id string, idx long, start_s double, end_s double, text string, translation string, speaker string")


def test_saved_files_are_streamed_by_their_ids(spark, tmp_path, monkeypatch):
    """Both writers, odd names, a second save over the first; each batch's files are opened once."""
    from cueloom.sources import folders, subtitles
    from cueloom.streaming import captions, run

    ids, mounted, made = [k + e for k in ODD if "\n" not in k for e in (".srt", "+ %.VTT", ".ass", "")], folders.mounted, []
    for own in (True, False):
        path = str(tmp_path / f"saved {own}%20+")
        monkeypatch.setattr(folders, "mounted", mounted if own else lambda *_: None)
        sinks.save_subtitles(_slates(spark, ["stale"]), path)
        sinks.save_subtitles(_slates(spark, ids), path)
        seen, plans = {}, []

        def sink(issues, batch):
            plans.append(issues._jdf.queryExecution().optimizedPlan().toString())
            seen[batch] = issues.collect()

        with run.small_files(spark):
            files = subtitles.subtitle_file_stream(spark, path, len(ids) // 2, saved=True)
            got = []
            q = files.writeStream.foreachBatch(lambda rows, _: got.extend((r.doc_id, r.value) for r in rows.collect()))
            q.option("checkpointLocation", str(tmp_path / f"rows{own}")).trigger(availableNow=True).start().awaitTermination()
            q = captions.stream_subtitle_qc(files, sink, read_once=True)
            q.option("checkpointLocation", str(tmp_path / f"qc{own}")).trigger(availableNow=True).start().awaitTermination()
        assert spark.conf.get("spark.sql.files.openCostInBytes") in ("4194304", "4194304b", "4MB")
        assert sorted(got) == sorted(map(tuple, subtitles.read_saved(spark, path).collect())) and sorted(d for d, _ in got) == sorted(ids)
        assert len(seen) >= 2 and all("InMemoryRelation" in p and "Relation [value" not in p for p in plans)
        assert {r.doc_id for rows in seen.values() for r in rows} <= set(ids)
        made.append(sorted(got))
        if own:
            assert len(_files(path)) == len(ids) + 1 and len(os.listdir(tmp_path)) <= 3  # no checksums, nothing beside the folder
    assert made[0] == made[1]


def test_ids_that_are_empty_share_a_folder(spark, tmp_path, monkeypatch):
    from cueloom.sources import folders, subtitles

    sinks.save_subtitles(_slates(spark, ["", None, "a"]), str(tmp_path / "out"))
    got = subtitles.read_saved(spark, str(tmp_path / "out")).collect()
    assert sorted((r.doc_id or "") + r.value.split("\n")[2] for r in got) == sorted(["None 0", " 0", "aa 0"])


def test_all_formats_of_a_text_are_made_from_one_reading(spark):
    ids = ["a.srt", "b.vtt", "c.ass", "d.SSA", "e", None]
    cues = _slates(spark, ids).unionByName(_slates(spark, ["f.srt"]).withColumn("text", F.lit("")))
    made = sinks.to_text(cues)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + made._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") <= 2
    got = {r.doc_id: r.value for r in made.collect()}
    for kind, of in ((sinks.to_srt, ("a.srt", "e", None)), (sinks.to_vtt, ("b.vtt",)), (sinks.to_ass, ("c.ass", "d.SSA"))):
        want = {r.doc_id: r.value for r in kind(cues).collect()}
        assert all(got[d] == want[d] for d in of)
    assert set(got) == set(ids)


# ---- audio

def chunk(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def wav(*chunks):
    body = b"WAVE" + b"".join(chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def form(tag, channels, rate, bits, extra=b""):
    return chunk(b"fmt ", struct.pack("<HHIIHH", tag, channels, rate, rate * channels * (bits // 8), channels * (bits // 8), bits) + extra)


EXTRA = struct.pack("<HHI", 22, 16, 4) + struct.pack("<H", 1) + bytes.fromhex("000000001000800000aa00389b71")
WAVS = {
    "plain": wav(form(1, 2, 44100, 16), chunk(b"data", b"\1\2\3\4" * 50)),
    "list before data": wav(form(1, 1, 16000, 8), chunk(b"LIST", b"INFOodd"), chunk(b"data", b"\1" * 33)),
    "bext before fmt": wav(chunk(b"bext", b"x" * 603), chunk(b"fact", b"\0" * 4), form(1, 1, 8000, 24), chunk(b"data", b"\1\2\3" * 7)),
    "longer fmt": wav(form(1, 1, 8000, 16, b"\0\0"), chunk(b"data", b"\1\2" * 9), chunk(b"LIST", b"after")),
    "extensible": wav(form(65534, 2, 48000, 32, EXTRA), chunk(b"data", b"\0" * 80)),
    "many chunks": wav(*[chunk(b"junk", b"x" * k) for k in range(70)], form(1, 1, 8000, 16), chunk(b"data", b"\1\2" * 5)),
    "no data": wav(form(1, 1, 8000, 16)),
    "data first": wav(chunk(b"data", b"\1\2" * 9), form(1, 1, 8000, 16)),
    "float": wav(form(3, 1, 8000, 32), chunk(b"data", b"\0" * 8)),
    "extensible float": wav(form(65534, 1, 8000, 32, EXTRA.replace(struct.pack("<H", 1) + b"\0\0\0\0\x10", struct.pack("<H", 3) + b"\0\0\0\0\x10")), chunk(b"data", b"\0" * 8)),
    "empty": b"", "short": b"RIFF", "other": b"OggS" + b"\0" * 60, "cut": wav(form(1, 1, 8000, 16))[:30], "no channels": wav(form(1, 0, 8000, 16), chunk(b"data", b"12")),
}


def test_wav_heads_are_what_the_library_reads(spark):
    df = spark.createDataFrame([(k, bytearray(v), "clash") for k, v in WAVS.items()] + [("null", None, "clash")], "path string, content binary, rate string")
    got = {r.path: (r.frames, round(r.seconds, 9), r.label) for r in audit.read_wav_headers(df).collect()}
    readable = 0
    for name, data in WAVS.items():
        try:
            with wave.open(io.BytesIO(data)) as f:
                want = (f.getnframes(), round(f.getnframes() / f.getframerate(), 9), f"{f.getframerate()}Hz/{f.getnchannels()}ch/{8 * f.getsampwidth()}bit")
                readable += 1
        except (wave.Error, EOFError, ZeroDivisionError):
            want = (0, 0.0, "unreadable")
        assert got[name] == want, name
    assert got["null"][2] == "unreadable" and readable >= 6


@pytest.mark.parametrize("mix", [False, True])
def test_overlays_over_chunks(spark, mix):
    rng = random.Random(5)
    segments = [(t, i, rng.uniform(-1, 9), 8000, [rng.randrange(-30000, 30000) for _ in range(rng.choice((1, 50, 20_000)))]) for t in (1, 2) for i in range(6)] + [(3, 0, 0.0, 10, [])]
    totals = [(1, 5.0), (2, 0.0), (3, 1.0)]
    want = {}
    for track, _, start, rate, samples in sorted(segments):
        ends = -(-int(max(0.1, dict(totals)[track]) * rate * 1000) // 1000)
        at = round(start * rate)
        for k, v in enumerate(samples):
            if 0 <= at + k < ends:
                want[track, at + k] = max(-32768, min(32767, want.get((track, at + k), 0) + v)) if mix else v
    df = spark.createDataFrame(segments, "track_id long, seg int, start_s double, rate int, samples array<int>").repartition(3)
    out = audit.overlay_series(df, spark.createDataFrame(totals, "track_id long, total_s double"), mix)
    assert {(r.track_id, r.pos): r.v for r in out.collect()} == want and len(want) > 10_000
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()


# ---- order statistics

def test_middle_heights_without_lists(spark):
    rng = random.Random(1)
    rows = [(v, float(rng.choice((20, 24, 24, 31.5, 40)))) for v in range(6) for _ in range(rng.randrange(1, 30))] + [(1, None), (99, None)]
    out = height_range(spark.createDataFrame(rows, "video_id long, height double"))
    assert "collect" not in out._jdf.queryExecution().optimizedPlan().toString()
    from statistics import median

    for r in out.collect():
        own = sorted(h for v, h in rows if v == r.video_id and h is not None)
        assert (r.low, r.high, r.middle) == (pytest.approx(median(own) * 0.62, abs=0.051), pytest.approx(median(own) * 1.75, abs=0.051), own[len(own) // 2])
    assert out.where("video_id = 99").count() == 0


def test_decoding_holds_a_piece_of_a_batch_at_once():
    import tracemalloc

    import pyarrow as pa

    from cueloom.sources import decoding

    texts = [chr(65 + i % 26) * 20_000 for i in range(2_000)] + [None]
    content = pa.array([t and (t.encode() if i % 2 else b"\xff\xfe" + t.encode("utf-16-le")) for i, t in enumerate(texts)], pa.binary())
    tracemalloc.start()
    got = decoding.decode_text.func(content)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == texts and peak < 16e6
