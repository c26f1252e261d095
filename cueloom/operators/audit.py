"""Audits of configurations, caches, media metadata and audio."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window
from pyspark.sql.types import DoubleType, StringType

from ..functions.timecode import parse_timecode, strip
from .spread import spread

SECRET = r"(?i)api.?key|token|password|passwd|login|cookie|proxy"


# ---- configurations: (id, name, value), value being JSON

def list_configs(configs: DataFrame, unused: str = "not used") -> DataFrame:
    """Names, the newest first, without those marked as unused."""
    return configs.where(~F.lower("name").contains(unused.lower())).orderBy(F.desc("id")).select("id", "name")


def read_config_cues(configs: DataFrame) -> DataFrame:
    """Cues of each configuration's data_table rows [n, "a --> b", speaker, original, translation]."""
    configs = spread(configs.select("id", "value"), "id")  # reading JSON costs much more than its bytes
    rows = configs.select(F.col("id").alias("doc_id"), F.posexplode(F.from_json(F.get_json_object("value", "$.data_table"), "array<array<string>>")).alias("pos", "r"))
    halves = F.split(F.get("r", F.lit(1)), "-->", 2)
    text = lambda n: strip(F.coalesce(F.get("r", F.lit(n)), F.lit("")))
    cues = rows.where(F.size("r") >= 4).select(
        "doc_id", "pos", parse_timecode(F.get(halves, 0)).alias("start_s"), parse_timecode(F.get(halves, 1)).alias("end_s"),
        text(3).alias("text"), text(4).alias("translation"), text(2).alias("speaker")).where("text <> '' and end_s > start_s")
    w = Window.partitionBy("doc_id").orderBy("pos")
    return cues.select("doc_id", (F.row_number().over(w) - 1).cast("long").alias("idx"), "start_s", "end_s", "text", "translation", "speaker")


def config_pick_first(configs: DataFrame) -> DataFrame:
    return configs.agg(F.min("id").alias("id"), F.min_by("name", "id").alias("name"), F.min_by("value", "id").alias("value"))


def setting_index(configs: DataFrame) -> DataFrame:
    """(key, configs, samples): how many configurations have each key, and up to three values seen first."""
    pairs = configs.select("id", F.explode(F.from_json("value", "map<string,string>")).alias("key", "v"))
    shown = F.when(F.col("key").rlike(SECRET), "<redacted>").when(F.col("key") == "data_table", "<table>").otherwise(F.col("v"))
    seen = pairs.withColumn("v", shown)
    firsts = seen.groupBy("key", "v").agg(F.min("id").alias("first"))
    ranked = firsts.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("first", "v"))).where("n <= 3")
    samples = ranked.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "v"))), lambda x: x["v"]).alias("samples"))
    return seen.groupBy("key").agg(F.count_distinct("id").alias("configs")).join(samples, "key").select("key", "configs", F.array_join("samples", "|").alias("samples"))


def redact(value, most: int = 500):
    """JSON values without secrets, tables and long strings."""
    if isinstance(value, dict):
        return {k: "<redacted>" if re.search(SECRET, k) else
                {"rows": len(v), "columns": max(map(len, v), default=0)} if k == "data_table" and isinstance(v, list) and all(isinstance(r, list) for r in v) else redact(v, most)
                for k, v in value.items()}
    if isinstance(value, list):
        return [redact(v, most) for v in value]
    if isinstance(value, str) and len(value) > most:
        return {"type": "string", "length": len(value)}
    return value


@F.pandas_udf(StringType())
def redact_config(values: pd.Series) -> pd.Series:
    """Each JSON text without secrets; unreadable or null ones give null."""
    def one(text):
        try:
            return json.dumps(redact(json.loads(text)), ensure_ascii=False, sort_keys=True)
        except (TypeError, ValueError):
            return None

    return values.map(one)


def _setting(key: str, default, kind: str) -> Column:
    found = F.get_json_object("value", f"$.{key}")
    if kind == "boolean":
        return F.coalesce(F.when(found.isin("true", "false"), found == "true").when(found.try_cast("double").isNotNull(), found.try_cast("double") != 0)
                          .when(found.isNotNull(), found != ""), F.lit(default))
    if kind == "string":
        return F.coalesce(F.nullif(found, F.lit("")), F.lit(default))
    number = found.try_cast("double")
    number = F.when(number != 0, number)
    return F.coalesce(number.cast(kind) if kind == "int" else number, F.lit(default))


def map_global_config(configs: DataFrame) -> DataFrame:
    """One column a setting, from the keys of a global configuration, with defaults and bounds."""
    # fixed values: (setting, key, default, kind, least, most)
    numbers = [("max_workers", "thread_ocr_v2", 2, "int", 1, 8), ("ocr_batch_size", "frame_size_ocr_v2", 5, "int", 1, 64),
               ("ocr_confidence", "confidence_ocr_v2", 70.0, "double", None, None), ("translate_batch", "chunk_split_trans", 8, "int", 1, None),
               ("asr_max_chars", "max_chars_asr", 15, "int", 5, None), ("asr_max_duration", "max_duration_asr", 2.0, "double", 0.5, None),
               ("render_crf", "he_so_crf", 19, "int", 0, None), ("music_volume", "am_luong_nhac_nen", 17, "int", 0, 100),
               ("tts_short_threshold_ms", "check_sub_time_ngan", 300, "int", 0, None), ("timeline_workers", "so_luong_render", 2, "int", 1, 8),
               ("edit_volume", "volume_phat", 42, "int", 0, 100)]
    pauses = [("tts_pause_period_ms", "dau_cham", 0.3), ("tts_pause_comma_ms", "dau_phay", 0.2), ("tts_pause_newline_ms", "dau_xuong_dong", 0.4)]
    texts = [("render_preset", "he_so_preset", "fast"), ("render_fps", "he_so_fps", "30")]
    flags = [("use_gpu", "use_gpu"), ("limit_cpu", "chong_full_cpu"), ("fast_concat", "concat_fast"), ("format_capcut", "format_video_capcut"),
             ("smart_cut", "smart_cut"), ("play_on_edit", "auto_play"), ("enter_newline", "use_enter_xuong_hang")]
    out = ["id"]
    for name, key, default, kind, low, high in numbers:
        value = _setting(key, default, kind)
        value = value if low is None else F.greatest(F.lit(low), value)
        out.append((value if high is None else F.least(F.lit(high), value)).alias(name))
    for name, key, default in pauses:
        out.append(F.greatest(F.lit(0), (F.coalesce(F.get_json_object("value", f"$.{key}").try_cast("double"), F.lit(default)) * 1000).cast("int")).alias(name))
    out += [_setting(key, default, "string").alias(name) for name, key, default in texts]
    out += [_setting(key, False, "boolean").alias(name) for name, key in flags]
    return configs.select(*out)


def map_project_config(configs: DataFrame) -> DataFrame:
    """One column a setting, from the keys of a project's configuration."""
    text = lambda key, default: F.coalesce(F.get_json_object("value", f"$.{key}"), F.lit(default))
    return configs.select(
        "id", F.coalesce(F.get_json_object("value", "$.khoang_nghi_o_cuoi").try_cast("int"), F.lit(250)).alias("tts_end_pause_ms"),
        _setting("chong_tieng", False, "boolean").alias("tts_allow_overlap"), _setting("save_cache", False, "boolean").alias("tts_store_voice"),
        _setting("save_cache", True, "boolean").alias("tts_cache_enabled"), _setting("thuyet_minh", False, "boolean").alias("keep_original_audio"),
        _setting("use_video_origin", False, "boolean").alias("dub_use_original_video"), _setting("volume_video_goc_thuyet_minh", 20, "int").alias("original_audio_volume"),
        F.when(text("sub_long_tieng", "origin") == "translation", "translation").otherwise("original").alias("dub_source"),
        F.replace(text("chat_luong_video", "giu nguyen"), F.lit("|"), F.lit("x")).alias("render_scale"), text("font_family", "Arial").alias("font"),
        F.coalesce(F.regexp_replace(text("font_size", "48"), "px$", "").try_cast("double").cast("int"), F.lit(48)).alias("font_size"),
        _setting("font_sub", True, "boolean").alias("bold"), text("mau_sub", "#FFFFFF").alias("primary_color"), text("mau_vien_sub", "#000000").alias("outline_color"),
        text("mau_nen_sub", "#000000").alias("back_color"))


# ---- frame cache, media metadata

_BOXES = "array<struct<order:array<double>,text:string,score:double,rect:array<double>>>"


CACHE = "frame_idx long, version long, rows_json string, cache_key string"


def open_frame_cache(spark: SparkSession, path: str) -> DataFrame:
    """The frame cache that ``sinks.save_frame_cache`` keeps under a path; a filter on cache_key reads that key's folder only."""
    return spark.read.schema(CACHE).parquet(path)


def whole_frame_cache(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a frame cache, for readers of many keys: tasks list and read the folders, where they can."""
    from ..sources import folders

    root = folders.mounted(spark, path)
    return folders.read_folders(folders.folders(spark, root, "cache_key"), root, "cache_key", CACHE) if root else open_frame_cache(spark, path)


def read_frame_cache(cache: DataFrame, cache_key: str, total: int) -> DataFrame:
    """(frame_idx, boxes) of one key's frames below ``total`` whose rows_json can be read."""
    rows = cache.where((F.col("cache_key") == cache_key) & (F.col("frame_idx") < total)).withColumn("boxes", F.from_json("rows_json", _BOXES))
    return rows.where("boxes is not null").select("frame_idx", "boxes")


_PROBE = ("struct<format:struct<duration:string,size:string>,streams:array<struct<codec_type:string,codec_name:string,width:int,height:int,r_frame_rate:string,avg_frame_rate:string>>>")


def parse_media_probe(rows: DataFrame) -> DataFrame:
    """(path, duration_s, width, height, fps, has_video, has_audio, video_codec, audio_codec, size_bytes) of (path, value)."""
    p = rows.select("path", F.from_json("value", _PROBE).alias("p"))
    first = lambda kind: F.get(F.filter("p.streams", lambda s: s["codec_type"] == kind), 0)
    s = p.withColumns({"v": first("video"), "a": first("audio")})
    part = F.split("v.r_frame_rate", "/")
    over = F.coalesce(F.get(part, 1).try_cast("double"), F.lit(1.0))
    return s.select("path", F.coalesce(F.col("p.format.duration").try_cast("double"), F.lit(0.0)).alias("duration_s"), F.coalesce("v.width", F.lit(0)).alias("width"), F.coalesce("v.height", F.lit(0)).alias("height"),
                    F.coalesce(F.when(over != 0, F.get(part, 0).try_cast("double") / over), F.lit(0.0)).alias("fps"), F.col("v").isNotNull().alias("has_video"), F.col("a").isNotNull().alias("has_audio"),
                    F.coalesce("v.codec_name", F.lit("")).alias("video_codec"), F.coalesce("a.codec_name", F.lit("")).alias("audio_codec"), F.coalesce(F.col("p.format.size").try_cast("long"), F.lit(0)).alias("size_bytes"))


def parse_frame_log(lines: DataFrame, frames: DataFrame, gap: float) -> DataFrame:
    """(video_id, frame_idx, stamp_s) from log lines (video_id, line_no, line); i * gap where the count isn't (video_id, frames)."""
    stamps = lines.where(F.col("line").contains("showinfo") & F.col("line").rlike(r"pts_time:\s*[0-9.]+"))
    w = Window.partitionBy("video_id").orderBy("line_no")
    got = stamps.select("video_id", (F.row_number().over(w) - 1).alias("frame_idx"), F.regexp_extract("line", r"pts_time:\s*([0-9.]+)", 1).try_cast("double").alias("pts"))
    counts = frames.join(got.groupBy("video_id").agg(F.count("*").alias("m")), "video_id", "left")
    wanted = counts.where("frames > 0").select("video_id", (F.col("frames") == F.col("m")).alias("exact"), F.explode(F.sequence(F.lit(0), F.col("frames").cast("int") - 1)).alias("frame_idx"))
    return wanted.join(got, ["video_id", "frame_idx"], "left").select("video_id", "frame_idx", F.when(F.coalesce("exact", F.lit(False)), F.col("pts")).otherwise(F.col("frame_idx") * gap).alias("stamp_s"))


#: Chunks of a file that are looked at first; only files with more before their samples are walked again, to their end.
_CHUNKS = 32
_PCM, _EXTENSIBLE = 1, 65534


def read_wav_headers(files: DataFrame) -> DataFrame:
    """(path, rate, channels, bits, frames, seconds, label) of WAV files (path, content); unreadable ones have 0 frames.

    The RIFF chunks are walked from the first one on: ``fmt `` and then ``data`` may stand anywhere among others, chunks
    of odd size are padded. Plain and extensible PCM is read, whole bytes a sample; any other format, ``data`` without
    ``fmt `` before it, and files that are cut in their heads are unreadable. Only a few bytes of each chunk's head are
    looked at; null content is unreadable.
    """
    content = F.col("content")

    def number(first: Column, size: int) -> Column:
        """The unsigned little-endian number of some bytes, of which the first is byte ``first`` from 0."""
        return sum((F.conv(F.hex(F.substring(content, (first + k + 1).cast("int"), F.lit(1))), 16, 10).cast("long") * (1 << 8 * k) for k in range(size)), F.lit(0).cast("long"))

    def word(first: Column) -> Column:
        return F.hex(F.substring(content, (first + 1).cast("int"), F.lit(4)))

    kind = "struct<at:bigint,form:bigint,rate:bigint,channels:bigint,bits:bigint,bytes:bigint,done:boolean>"
    none = F.lit(None).cast("long")
    start = F.struct(F.lit(12).cast("long").alias("at"), *[none.alias(c) for c in ("form", "rate", "channels", "bits", "bytes")], F.lit(False).alias("done")).cast(kind)

    def step(s: Column, _: Column) -> Column:
        at, size = s["at"], number(s["at"] + 4, 4)
        cut = at + 8 > F.length(content)
        is_format = (word(at) == "666D7420") & (size >= 16) & (at + 24 <= F.length(content))
        form = number(at + 8, 2)
        form = F.when((form == _EXTENSIBLE) & (size >= 40), number(at + 32, 2)).otherwise(form)
        told = lambda name, found: F.when(is_format, found).otherwise(s[name]).alias(name)
        data = word(at) == "64617461"
        after = F.struct((at + 8 + size + size % 2).alias("at"), told("form", form), told("rate", number(at + 12, 4)), told("channels", number(at + 10, 2)), told("bits", number(at + 22, 2)),
                         F.when(data & s["form"].isNotNull(), size).alias("bytes"), data.alias("done")).cast(kind)
        stopped = F.struct(*[s[c].alias(c) for c in ("at", "form", "rate", "channels", "bits", "bytes")], F.lit(True).alias("done")).cast(kind)
        return F.when(s["done"], s).when(cut, stopped).otherwise(after)

    riff = (F.length("content") >= 12) & (word(F.lit(0)) == "52494646") & (word(F.lit(8)) == "57415645")
    begun = files.select("path", "content", F.when(riff, F.aggregate(F.sequence(F.lit(1), F.lit(_CHUNKS)), start, step)).alias("s"))
    more = F.aggregate(F.sequence(F.lit(1).cast("long"), F.floor(F.length("content") / 8) + 1), F.col("s"), step)
    walked = begun.select("path", F.when(F.col("s.done"), F.col("s")).when(F.col("s").isNotNull(), more).alias("s"))
    rows = walked.select("path", "s.rate", "s.channels", (F.floor((F.col("s.bits") + 7) / 8)).cast("long").alias("width"), "s.bytes", "s.form")
    ok = (F.col("form") == _PCM) & (F.col("rate") > 0) & (F.col("channels") > 0) & (F.col("width") > 0) & F.col("bytes").isNotNull()
    frames = F.floor(F.col("bytes") / (F.col("channels") * F.col("width")))
    bits = F.col("width") * 8
    return rows.select("path", "rate", "channels", bits.alias("bits"), F.when(ok, frames).otherwise(0).cast("long").alias("frames"), F.when(ok, frames / F.col("rate")).otherwise(0.0).alias("seconds"),
                       F.when(ok, F.concat(F.col("rate").cast("string"), F.lit("Hz/"), F.col("channels").cast("string"), F.lit("ch/"), bits.cast("string"), F.lit("bit"))).otherwise("unreadable").alias("label"))


def wav_summary(headers: DataFrame) -> DataFrame:
    return headers.groupBy("label").agg(F.count("*").alias("files"), F.min("seconds").alias("shortest_s"), F.max("seconds").alias("longest_s"))


def padded_length(seconds: Column, rate: Column, pause: Column) -> Column:
    """Seconds after a pause of 0 to 5 s, rounded to whole frames, is added."""
    return seconds + F.rint(F.greatest(F.lit(0.0), F.least(F.lit(5.0), pause)) * rate) / rate


def sample_stamps(duration: Column, count: int) -> Column:
    """``count`` times over a video without its ends; 60 s where the duration is unknown."""
    whole = F.when(duration > 0, duration).otherwise(60.0)
    skip = F.least(F.lit(2.0), whole * 0.05)
    usable = F.greatest(F.lit(0.0), whole - 2 * skip)
    return F.transform(F.sequence(F.lit(0), F.lit(max(count, 1) - 1)), lambda i: skip + usable * i / max(count - 1, 1))


def extension_counts(paths: DataFrame) -> DataFrame:
    """(label, files) of folder:.ext, lower case, [none] without one."""
    folder, name = F.regexp_extract("path", r"^(?:.*/)?([^/]+)/[^/]*$", 1), F.regexp_extract("path", r"([^/]*)$", 1)
    ext = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    label = F.concat(folder, F.lit(":"), F.when(ext == "", "[none]").otherwise(ext))
    return paths.groupBy(label.alias("label")).agg(F.count("*").alias("files"))


def schema_variants(schemas: DataFrame) -> DataFrame:
    """(signature, databases, example) of columns (database, table, column, type): equal schemas counted together."""
    signature = F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("table", "column", "type")))).cast("binary"), 256)
    return (schemas.groupBy("database").agg(signature.alias("signature")).groupBy("signature")
            .agg(F.count("*").alias("databases"), F.min("database").alias("example")))


def catalog_profile(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """(table, rows, columns) of named Parquet tables; the loop is over the names, the counts are Spark's."""
    out = None
    for name, path in sorted(tables.items()):
        df = spark.read.parquet(path)
        columns = ",".join(f"{f.name}" for f in df.schema.fields)
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows", F.lit(columns).alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out


# ---- speech and audio

def segment_bounds(words: Column, start: Column, end: Column) -> Column:
    """struct(start_s, end_s): of the first and last spoken word with both times, else the segment's own."""
    said = F.filter(words, lambda w: (strip(F.coalesce(w["word"], F.lit(""))) != "") & w["start_s"].isNotNull() & w["end_s"].isNotNull())
    first = F.greatest(F.lit(0.0), F.coalesce(F.get(said, 0)["start_s"], start))
    last = F.coalesce(F.try_element_at(said, F.lit(-1))["end_s"], end)
    return F.struct(first.alias("start_s"), F.greatest(last, first + 0.05).alias("end_s"))


def read_asr_segments(segments: DataFrame) -> DataFrame:
    """Cues of segments (doc_id, pos, text, start_s, end_s, words); blank ones are dropped."""
    rows = segments.withColumns({"text": strip(F.coalesce("text", F.lit(""))), "b": segment_bounds(F.col("words"), F.col("start_s"), F.col("end_s"))}).where("text <> ''")
    w = Window.partitionBy("doc_id").orderBy("pos")
    return rows.select("doc_id", (F.row_number().over(w) - 1).cast("long").alias("idx"), "b.start_s", "b.end_s", "text", F.lit("").alias("translation"), F.lit("").alias("speaker"))


def effective_fps(configured: Column, source: Column, fast: bool = False) -> Column:
    base = F.greatest(F.lit(0.5), configured)
    return F.when(source > 1, F.least(base, F.greatest(F.lit(0.5), source / 2))).otherwise(base) if fast else base


def pitch_of(samples, rate: int) -> float:
    """Hz of a voice by autocorrelation of its first 4 s, 0 if it is too short, too quiet or out of 70 to 350 Hz."""
    x = np.asarray(samples[: 4 * rate], float)
    if len(x) < rate / 10 or np.abs(x).max(initial=0) < 200:
        return 0.0
    x -= x.mean()
    size = 1 << (2 * len(x) - 1).bit_length()
    power = np.abs(np.fft.rfft(x, size)) ** 2
    lags = np.fft.irfft(power, size)[: len(x)]
    low, high = int(rate / 350), min(int(rate / 70), len(x) - 1)
    if low >= high:
        return 0.0
    found = rate / (low + int(lags[low:high].argmax()))
    return float(found) if 70 <= found <= 350 else 0.0


@F.pandas_udf(DoubleType())
def estimate_pitch(samples: pd.Series, rate: pd.Series) -> pd.Series:
    """``pitch_of`` of arrays of 16-bit samples."""
    return pd.Series([0.0 if s is None else pitch_of(s, int(r)) for s, r in zip(samples, rate)])


#: Samples of one chunk of a track.
CHUNK = 1 << 14


def overlay_chunks(segments: DataFrame, totals: DataFrame, mix: bool = False) -> DataFrame:
    """(track_id, chunk, samples): tracks (track_id, total_s) in chunks of 16,384 samples, null where no segment is.

    Segments (track_id, seg, start_s, rate, samples) are cut at the chunks' edges as arrays, and overlaid chunk by chunk
    in the order of seg: where they overlap the later one counts, or with ``mix`` all are added in order, held to 16 bits
    after each. No sample is a row of a shuffle; a task holds one chunk, so that a long track is spread over tasks.
    """
    placed = segments.join(totals, "track_id").select(
        "track_id", "seg", "samples", F.rint(F.col("start_s") * F.col("rate")).cast("long").alias("at"),
        F.ceil(F.greatest(F.lit(0.1), F.col("total_s")) * F.col("rate")).cast("long").alias("ends"))
    first, last = F.greatest("at", F.lit(0)), F.least(F.col("at") + F.size("samples"), "ends") - 1
    placed = placed.withColumns({"first": first, "last": last}).where("last >= first")
    cut = placed.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("first") / CHUNK), F.floor(F.col("last") / CHUNK))))
    begin, end = F.greatest("first", F.col("chunk") * CHUNK), F.least("last", F.col("chunk") * CHUNK + CHUNK - 1)
    pieces = cut.select("track_id", "chunk", "seg", (begin - F.col("chunk") * CHUNK).cast("int").alias("offset"),
                        F.slice("samples", (begin - F.col("at") + 1).cast("int"), (end - begin + 1).cast("int")).cast("array<int>").alias("piece"))

    def overlaid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, covered = None, np.zeros(CHUNK, np.int32), np.zeros(CHUNK, bool)

        def chunk() -> pa.RecordBatch:
            values = pa.array(held, pa.int32(), mask=~covered)
            return pa.RecordBatch.from_arrays([pa.array([now[0]], track), pa.array([now[1]], pa.int64()), pa.ListArray.from_arrays(pa.array([0, CHUNK], pa.int32()), values)], ["track_id", "chunk", "samples"])

        for batch in batches:
            track = batch.schema.field("track_id").type
            pieces = batch.column(3)
            for row, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if key != now:
                    if now is not None:
                        yield chunk()
                    now = key
                    held[:], covered[:] = 0, False
                offset = batch.column(2)[row].as_py()
                piece = pieces[row].values.to_numpy(zero_copy_only=False)
                place = slice(offset, offset + len(piece))
                held[place] = np.clip(held[place] + piece, -32768, 32767) if mix else piece
                covered[place] = True
        if now is not None:
            yield chunk()

    ordered = pieces.repartition("track_id", "chunk").sortWithinPartitions("track_id", "chunk", "seg").select("track_id", "chunk", "offset", "piece")
    kind = dict(segments.dtypes)["track_id"]
    return ordered.mapInArrow(overlaid, f"track_id {kind}, chunk long, samples array<int>")


def overlay_series(segments: DataFrame, totals: DataFrame, mix: bool = False) -> DataFrame:
    """(track_id, pos, v): the samples of ``overlay_chunks`` that a segment covers, a row each; the rest of a track is silent."""
    samples = overlay_chunks(segments, totals, mix).select("track_id", "chunk", F.posexplode("samples").alias("k", "v"))
    return samples.where("v is not null").select("track_id", (F.col("chunk") * CHUNK + F.col("k")).alias("pos"), "v")
