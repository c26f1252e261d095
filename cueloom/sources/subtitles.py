"""Subtitle files as DataFrames: one row (doc_id, value) a file in, cues and rejects out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window

from ..functions.text import strip_markup
from ..functions.timecode import parse_timecode, strip
from ..operators.cues import CUE

SUFFIXES = (".srt", ".vtt", ".ass", ".ssa", ".txt")
#: The columns of an [Events] section without a Format line.
ASS_FIELDS = ["layer", "start", "end", "style", "name", "marginl", "marginr", "marginv", "effect", "text"]
_SETTINGS = r"\s+(?:line|position|size|align|region|vertical):.*$"


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, value) of UTF-8 files, whole; doc_id is the file's path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), "value")


def read_saved(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, value) of texts that ``save_subtitles`` wrote."""
    return spark.read.schema("value string, doc_id string").option("wholetext", True).format("text").load(path).select("doc_id", "value")


def subtitle_file_stream(spark: SparkSession, path: str, files_a_trigger: int | None = None, saved: bool = False) -> DataFrame:
    """(doc_id, value) of UTF-8 files as they land in a folder, each whole and in one batch only.

    doc_id is the file's path, or with ``saved`` the id under which ``save_subtitles`` wrote it. A file that is still being
    written must not be in the folder yet: move it there, as Spark's own writers do.
    """
    reader = spark.readStream.format("text").schema("value string").option("wholetext", True)
    if saved:  # looking for key columns takes Spark's driver a time that grows with the square of the number of folders
        reader = reader.option("recursiveFileLookup", True)
    if files_a_trigger:
        reader = reader.option("maxFilesPerTrigger", files_a_trigger)
    at = F.col("_metadata.file_path")
    return reader.load(path).select((_saved_id(at) if saved else at).alias("doc_id"), "value")


def _saved_id(at: Column) -> Column:
    """The id in a path .../doc_id=.../file: once encoded as a folder's name, and once as a part of a URL."""
    plain = lambda c: F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    folder = plain(F.regexp_extract(at, "/doc_id=([^/]*)/[^/]*$", 1))
    return F.when(~folder.isin("", "__HIVE_DEFAULT_PARTITION__"), plain(folder))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, r"\r?\n"), lambda x: strip(x) != "")


def _blocks(files: DataFrame) -> DataFrame:
    """(doc_id, unit_no, lines): blocks between blank lines."""
    text = strip(F.regexp_replace("value", "^﻿", ""))
    return (files.select("doc_id", F.posexplode(F.split(text, r"\r?\n[^\S\n]*\r?\n")).alias("unit_no", "block"))
            .select("doc_id", (F.col("unit_no") + 1).alias("unit_no"), _lines(F.col("block")).alias("lines")).where(F.size("lines") > 0))


def _timed(blocks: DataFrame, settings: bool = False) -> DataFrame:
    """Adds start_s, end_s, text and whether there is a time line at all."""
    at = F.array_position(F.transform("lines", lambda x: x.contains("-->")), True).cast("int")
    line = F.when(at > 0, F.get("lines", at - 1))
    halves = F.split(line, "-->", 2)
    end = F.get(F.split(strip(F.get(halves, 1)), r"\s+"), 0)
    if settings:
        end = F.regexp_replace(end, _SETTINGS, "")
    text = strip_markup(F.array_join(F.slice("lines", at + 1, F.size("lines")), "\n"))
    return blocks.select("doc_id", "unit_no", (at > 0).alias("timed"), parse_timecode(F.get(halves, 0)).alias("start_s"),
                         parse_timecode(end).alias("end_s"), F.when(at > 0, text).alias("text"))


def _numbered(rows: DataFrame, speaker: Column | None = None) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("start_s", "end_s", "unit_no")
    return rows.select("doc_id", (F.row_number().over(w) - 1).cast("long").alias("idx"), "start_s", "end_s", "text", F.lit("").alias("translation"),
                       (F.lit("") if speaker is None else speaker).alias("speaker"))


def read_srt(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cues, rejects): blocks without a time line or with a bad one are rejects, and the rest is kept."""
    rows = _timed(_blocks(files))
    good = F.col("timed") & F.col("start_s").isNotNull() & F.col("end_s").isNotNull()
    rejects = rows.where(~good).select("doc_id", "unit_no", F.when(F.col("timed"), "bad timecode").otherwise("no time line").alias("message"))
    return _numbered(rows.where(good)), rejects


def read_vtt(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``read_srt`` for WebVTT: header, notes, styles and regions are skipped, cue settings dropped."""
    blocks = _blocks(files.withColumn("value", F.regexp_replace("value", r"^﻿?\s*WEBVTT[^\n]*\n?", "")))
    blocks = blocks.where(~F.upper(F.get("lines", 0)).rlike("^(NOTE|STYLE|REGION)"))
    rows = _timed(blocks, settings=True).where("timed")
    good = F.col("start_s").isNotNull() & F.col("end_s").isNotNull()
    return _numbered(rows.where(good)), rows.where(~good).select("doc_id", "unit_no", F.lit("bad timecode").alias("message"))


def read_ass(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dialogue lines of the [Events] section; a Format line sets the columns, the last of which takes the rest."""
    lines = (files.select("doc_id", F.posexplode(F.split(F.regexp_replace("value", "^﻿", ""), r"\r?\n")).alias("unit_no", "raw"))
             .select("doc_id", (F.col("unit_no") + 1).alias("unit_no"), strip(F.col("raw")).alias("line")))
    w = Window.partitionBy("doc_id").orderBy("unit_no").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when(F.col("line").rlike(r"^\[.*\]$"), F.lower("line")), ignorenulls=True).over(w)
    form = F.last(F.when(F.lower("line").startswith("format:"), F.transform(F.split(F.substring("line", 8, 100_000), ","), lambda f: F.lower(strip(f)))), ignorenulls=True).over(w)
    rows = (lines.withColumn("section", section).where("section = '[events]'").withColumn("fields", F.coalesce(form, F.array(*[F.lit(f) for f in ASS_FIELDS])))
            .where(F.lower("line").startswith("dialogue:")))
    parts = F.split(strip(F.substring(F.col("line"), 10, 1_000_000)), ",", F.size("fields"))
    rows = rows.withColumn("parts", parts).withColumn("enough", F.size("parts") >= F.size("fields"))
    field = lambda name: strip(F.get(F.col("parts"), F.array_position("fields", name).cast("int") - 1))
    rows = rows.select("doc_id", "unit_no", "enough", parse_timecode(field("start")).alias("start_s"), parse_timecode(field("end")).alias("end_s"),
                       strip_markup(field("text")).alias("text"), F.coalesce(field("name"), F.lit("")).alias("who"))
    good = F.col("enough") & F.col("start_s").isNotNull() & F.col("end_s").isNotNull()
    rejects = rows.where(~good).select("doc_id", "unit_no", F.when(F.col("enough"), "bad timecode").otherwise("too few columns").alias("message"))
    return _numbered(rows.where(good), F.col("who")), rejects


def read_plain_text(files: DataFrame, seconds_per_line: float = 3.0) -> DataFrame:
    """One cue a non-blank line, back to back. A line's place is counted in its own row, without a window."""
    lines = F.filter(F.transform(F.split(F.col("value"), r"\r?\n"), strip), lambda x: x != "")
    rows = files.select("doc_id", F.posexplode(lines).alias("idx", "text"))
    return rows.select("doc_id", F.col("idx").cast("long").alias("idx"), (F.col("idx") * seconds_per_line).alias("start_s"), ((F.col("idx") + 1) * seconds_per_line).alias("end_s"),
                       "text", F.lit("").alias("translation"), F.lit("").alias("speaker"))


def subtitle_format(doc_id: Column, value: Column) -> Column:
    """'ass', 'vtt', 'txt' or 'srt', by the file's ending and content."""
    name = F.lower(doc_id.cast("string"))
    return (F.when(name.rlike(r"\.(ass|ssa)$") | value.contains("[Events]"), "ass")
            .when(name.endswith(".vtt") | F.ltrim(F.regexp_replace(value, "^﻿", "")).startswith("WEBVTT"), "vtt")
            .when(name.endswith(".txt") & ~value.contains("-->"), "txt").otherwise("srt"))


def read_subtitles(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cues, rejects) of files of any of the formats; plain text files give one warning among the rejects."""
    marked = files.withColumn("format", subtitle_format(F.col("doc_id"), F.col("value")))
    of = lambda f: marked.where(F.col("format") == f).drop("format")
    srt, vtt, ass = read_srt(of("srt")), read_vtt(of("vtt")), read_ass(of("ass"))
    plain = of("txt")
    warning = plain.select("doc_id", F.lit(0).alias("unit_no"), F.lit("plain text: times are made up").alias("message"))
    cues = srt[0].unionByName(vtt[0]).unionByName(ass[0]).unionByName(read_plain_text(plain))
    return cues.select(CUE), srt[1].unionByName(vtt[1]).unionByName(ass[1]).unionByName(warning)


def read_project_json(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs, cues) of exported projects; missing fields get defaults, entries that are no objects are dropped."""
    kind = "struct<language:string,target_language:string,cues:array<string>>"
    parsed = files.select("doc_id", F.from_json("value", kind).alias("p"))
    docs = parsed.select("doc_id", F.coalesce("p.language", F.lit("")).alias("language"), F.coalesce("p.target_language", F.lit("")).alias("target_language"))
    one = "struct<start:double,end:double,text:string,translation:string,speaker:string>"
    rows = parsed.select("doc_id", F.posexplode(F.filter(F.coalesce("p.cues", F.array().cast("array<string>")), lambda c: F.coalesce(c.startswith("{"), F.lit(False)))).alias("idx", "c"))
    rows = rows.select("doc_id", F.col("idx").cast("long").alias("idx"), F.from_json("c", one).alias("c"))
    text = lambda c: strip(F.coalesce(f"c.{c}", F.lit(""))).alias(c)
    cues = rows.select("doc_id", "idx", F.greatest(F.lit(0.0), F.coalesce("c.start", F.lit(0.0))).alias("start_s"), F.greatest(F.lit(0.0), F.coalesce("c.end", F.lit(0.0))).alias("end_s"),
                       text("text"), text("translation"), text("speaker"))
    return docs, cues


def read_glossary(files: DataFrame) -> DataFrame:
    """(doc_id, pos, src, dst) of lines src=dst; an empty dst stands for src; a later duplicate keeps the first's place."""
    lines = files.select("doc_id", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line")).where(F.col("line").contains("="))
    halves = F.split("line", "=", 2)
    pairs = lines.select("doc_id", "pos", strip(F.get(halves, 0)).alias("src"), strip(F.get(halves, 1)).alias("dst")).where("src <> ''")
    pairs = pairs.withColumn("dst", F.when(F.col("dst") == "", F.col("src")).otherwise(F.col("dst")))
    return pairs.groupBy("doc_id", "src").agg(F.min("pos").alias("pos"), F.max_by("dst", "pos").alias("dst")).select("doc_id", "pos", "src", "dst")
