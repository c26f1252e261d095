"""Cues to subtitle text and JSON."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F, Window
from pyspark.sql.types import StringType

from ..functions.timecode import format_ass, format_srt, format_vtt
from ..operators.cues import display_text
from ..operators.folds import fold_in_order
from ..operators.spread import spread, spread_files
from . import folders

#: The head of a script and its one style.
ASS_HEAD = ("[Script Info]\nScriptType: v4.00+\nPlayResX: {x}\nPlayResY: {y}\nWrapStyle: 0\nScaledBorderAndShadow: yes\n\n[V4+ Styles]\n"
            "Format: Name, Fontname, Fontsize, PrimaryColour, OutlineColour, BackColour, Bold, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV\n"
            "Style: Default,{font},{size},{primary},{outline},{back},{bold},1,{border},{shadow},{alignment},40,40,{margin}\n\n[Events]\n"
            "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n")


def _joined(rows: DataFrame, block: Column, order: str, head: str, mark: str, tail: str = "") -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("n"), block.alias("b"))))
    return rows.groupBy("doc_id").agg(F.concat(F.lit(head), F.array_join(F.transform(ordered, lambda x: x["b"]), mark), F.lit(tail)).alias("value"))


def _srt_block() -> Column:
    return F.concat(F.col("n").cast("string"), F.lit("\n"), format_srt(F.col("start_s")), F.lit(" --> "), format_srt(F.col("end_s")), F.lit("\n"), "shown", F.lit("\n"))


def to_srt(cues: DataFrame, mode: str = "original") -> DataFrame:
    """(doc_id, value); only cues that show something are numbered."""
    rows = cues.withColumn("shown", display_text(mode)).where("shown <> ''")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("idx")))
    return _joined(rows, _srt_block(), "n", "", "\n")


VTT_HEAD = "WEBVTT\n\n"


def _vtt_block() -> Column:
    return F.concat(format_vtt(F.col("start_s")), F.lit(" --> "), format_vtt(F.col("end_s")), F.lit("\n"), "shown", F.lit("\n"))


def to_vtt(cues: DataFrame, mode: str = "original") -> DataFrame:
    rows = cues.withColumn("shown", display_text(mode)).where("shown <> ''")
    return _joined(rows, _vtt_block(), "idx", VTT_HEAD, "\n")


def _ass_head(font: str = "Arial", font_size: int = 48, primary: str = "&H00FFFFFF", outline_color: str = "&H00000000", back: str = "&H80000000", bold: bool = True,
              outline: float = 2.0, shadow: float = 1.0, alignment: int = 2, margin_v: int = 40, x: int = 1920, y: int = 1080) -> str:
    return ASS_HEAD.format(x=x, y=y, font=font, size=font_size, primary=primary, outline=outline_color, back=back, bold=-1 if bold else 0, border=f"{outline:g}",
                           shadow=f"{shadow:g}", alignment=alignment, margin=margin_v)


def _ass_line() -> Column:
    return F.concat(F.lit("Dialogue: 0,"), format_ass(F.col("start_s")), F.lit(","), format_ass(F.col("end_s")), F.lit(",Default,"),
                    F.replace("speaker", F.lit(","), F.lit(" ")), F.lit(",0,0,0,,"), F.replace("shown", F.lit("\n"), F.lit("\\N")))


def to_ass(cues: DataFrame, mode: str = "original", font: str = "Arial", font_size: int = 48, primary: str = "&H00FFFFFF", outline_color: str = "&H00000000",
           back: str = "&H80000000", bold: bool = True, outline: float = 2.0, shadow: float = 1.0, alignment: int = 2, margin_v: int = 40, x: int = 1920, y: int = 1080) -> DataFrame:
    head = _ass_head(font, font_size, primary, outline_color, back, bold, outline, shadow, alignment, margin_v, x, y)
    rows = cues.withColumn("shown", display_text(mode)).where("shown <> ''")
    return _joined(rows, _ass_line(), "idx", head, "\n", "\n")


def to_text(cues: DataFrame, mode: str = "original") -> DataFrame:
    """(doc_id, value): each document in the format that its id's ending names, .srt for any other. Cues are read once for all formats."""
    name = F.lower(F.col("doc_id").cast("string"))
    kind = F.when(name.endswith(".vtt"), "vtt").when(name.rlike(r"\.(ass|ssa)$"), "ass").otherwise("srt")
    rows = cues.withColumn("shown", display_text(mode)).where("shown <> ''").withColumn("kind", kind)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("idx")))
    of = {k: F.col("kind") == k for k in ("vtt", "ass")}
    rows = rows.withColumn("block", F.when(of["vtt"], _vtt_block()).when(of["ass"], _ass_line()).otherwise(_srt_block()))
    rows = rows.withColumn("n", F.when(of["vtt"] | of["ass"], F.col("idx").cast("long")).otherwise(F.col("n").cast("long")))
    made = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda x: x["block"]), "\n")
    return rows.groupBy("doc_id", "kind").agg(made.alias("value")).select(
        "doc_id", F.when(of["vtt"], F.concat(F.lit(VTT_HEAD), "value")).when(of["ass"], F.concat(F.lit(_ass_head()), "value", F.lit("\n"))).otherwise(F.col("value")).alias("value"))


def save_subtitles(cues: DataFrame, path: str, kind: str | None = None, mode: str = "original") -> None:
    """Writes one text a document under doc_id=..., in the format of the id's ending unless ``kind`` names one; all or nothing."""
    made = to_text(cues, mode) if kind is None else {"srt": to_srt, "vtt": to_vtt, "ass": to_ass}[kind](cues, mode)
    made = spread_files(made, "doc_id", cues)
    if root := folders.mounted(cues.sparkSession, path):
        folders.write_new(made, root, "doc_id", folders.TextFile)
    else:
        made.write.partitionBy("doc_id").mode("overwrite").text(path)


def export_manifest(projects: DataFrame, cues: DataFrame) -> DataFrame:
    """(doc_id, value): JSON of projects (doc_id, name, language, target_language, duration_s) with their cues."""
    r3 = lambda c: F.rint(F.col(c) * 1000) / 1000
    listed = cues.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(
        "idx", r3("start_s").alias("start"), r3("end_s").alias("end"), "text", "translation", "speaker"))),
        lambda c: F.struct(c["start"], c["end"], c["text"], c["translation"], c["speaker"])).alias("cues"))
    whole = F.struct("name", r3("duration_s").alias("duration"), "language", "target_language", "cues")
    return projects.join(listed, "doc_id", "left").select("doc_id", F.to_json(whole).alias("value"))


def timeline_segments(cues: DataFrame, mode: str = "translation", base: int = 0) -> DataFrame:
    """(doc_id, idx, text, start_us, duration_us, render_index, style_end) of editor segments; empty ones are left out."""
    flat = F.trim(F.replace(display_text(mode), F.lit("\n"), F.lit(" ")))
    rows = cues.withColumn("shown", flat).where((F.col("shown") != "") & (F.col("end_s") > F.col("start_s")))
    us = lambda c: F.rint(c * 1e6).cast("long")
    return rows.select("doc_id", "idx", F.col("shown").alias("text"), us(F.col("start_s")).alias("start_us"),
                       F.greatest(F.lit(1), us(F.col("end_s") - F.col("start_s"))).alias("duration_us"), (F.col("idx") + base).alias("render_index"), F.length("shown").alias("style_end"))


def to_timeline_json(cues: DataFrame, mode: str = "translation", base: int = 0) -> DataFrame:
    s = timeline_segments(cues, mode, base)
    one = F.struct("idx", "text", "start_us", "duration_us", "render_index", F.array(F.lit(0), F.col("style_end")).alias("range"))
    return s.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("value"))


def upsert_frame_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The latest version of each (cache_key, frame_idx); both sides carry version, and the new side wins ties."""
    both = cache.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    w = Window.partitionBy("cache_key", "frame_idx").orderBy(F.desc("version"), F.desc("_side"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_side")


def save_frame_cache(path: str, new: DataFrame, staging: str) -> None:
    """Upserts new rows (cache_key, frame_idx, version, rows_json) into the cache kept under a path, a folder for each cache_key.

    Only the folders of keys in ``new`` are read and written again, and all new files are made before the first old one is
    replaced. New rows are written under ``staging`` first, so that they are made once. Rows without a key are left out.
    """
    from ..operators.audit import CACHE, open_frame_cache

    spark = new.sparkSession
    rows = new.select(F.col("frame_idx").cast("long").alias("frame_idx"), F.col("version").cast("long").alias("version"), "rows_json", F.col("cache_key").cast("string").alias("cache_key")).where("cache_key <> ''")
    rows.write.mode("overwrite").parquet(f"{staging}/new")
    rows = spark.read.schema(rows.schema).parquet(f"{staging}/new")
    chunk = F.floor(F.col("frame_idx") / CACHE_FRAMES)
    if root := folders.mounted(spark, path):
        known = folders.read_folders(spread(rows.select("cache_key").distinct(), "cache_key"), root, "cache_key", CACHE)
        merged = spread_files(upsert_frame_cache(known, rows), "cache_key", rows, chunk)
        folders.write_over(merged, root, "cache_key", folders.ParquetFile, f"frames-{CACHE_FRAMES}", chunk, ("frame_idx",))
        return
    try:
        known = open_frame_cache(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        merged = upsert_frame_cache(rows.limit(0), rows)
    else:
        merged = upsert_frame_cache(_of_keys(known, rows), rows)
    # a task that is run again must read nothing that is being replaced
    merged.write.mode("overwrite").parquet(f"{staging}/merged")
    staged = spark.read.schema(merged.schema).parquet(f"{staging}/merged")
    (spread_files(staged, "cache_key", staged, chunk).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("cache_key").parquet(path))


def _of_keys(known: DataFrame, rows: DataFrame) -> DataFrame:
    """The known rows of the keys of some rows: up to ``LISTED_KEYS`` are named in the scan's filter, more are joined."""
    keys = rows.select("cache_key").distinct()
    listed = [r["cache_key"] for r in keys.limit(LISTED_KEYS + 1).collect()]
    if len(listed) <= LISTED_KEYS:
        return known.where(F.col("cache_key").isin(listed))
    return known.join(keys, "cache_key", "left_semi")


#: Keys that are collected to name the folders that an upsert reads, at most.
LISTED_KEYS = 10_000
#: Frames of one file of a key, about, so that a long video's folder is written by many tasks. Files' names tell it, so that another number replaces them.
CACHE_FRAMES = 100_000


@F.pandas_udf(StringType())
def _composed(name: pd.Series) -> pd.Series:
    return name.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def safe_name(name: Column, fallback: str = "project") -> Column:
    """A file name: composed (NFC), without invalid characters, at most 80 long, no device name."""
    plain = ~name.rlike(r"[^\x00-\x7f]")
    name = F.when(plain, name).otherwise(_composed(F.when(~plain, name)))
    t = F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_")
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), r"^[. ]+|[. ]+$", "")
    t = F.when(F.upper(t).rlike(r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(\..*)?$"), F.concat(F.lit("_"), t)).otherwise(t)
    t = F.regexp_replace(F.left(t, F.lit(80)), r"[. ]+$", "")
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit(fallback)).otherwise(t)


_NUMBERED = re.compile(r"(.+)_([1-9][0-9]*)", re.S)


class _Names:
    """The names of one family in one folder: stems that differ by ending numbers only, such as a, a_1 and a_1_2.

    A stem's numbers are handed out in rising order, so that one number a distinct stem tells all that were handed out;
    besides, names that were taken before are remembered.
    """

    def __init__(self):
        self.taken: set[str] = set()
        self.next: dict[str, int] = {}

    def free(self, name: str) -> bool:
        numbered = _NUMBERED.fullmatch(name)
        return not (name in self.taken or self.next.get(name, 0) > 0 or numbered and self.next.get(numbered[1], 0) > int(numbered[2]))

    def take(self, row: dict):
        if row["id"] is None and row["number"] is None:
            self.taken.add(row["stem"])
            return
        n, stem = self.next.get(row["stem"], 0), row["stem"]
        while not self.free(f"{stem}_{n}" if n else stem):
            n += 1
        self.next[stem] = n + 1
        yield row["id"], row["folder"], f"{stem}_{n}" if n else stem

    def end(self):
        return ()


def output_names(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, folder, file_name) of rows (id, folder, name, and remembered if there is such a column): a name of its own for each in its folder.

    In the order of id, each row gets its safe name, or the first of name_1, name_2 ... that is free: neither in existing
    (folder, stem), nor remembered, nor given to an earlier row. A row with a remembered name keeps it.

    A name can clash only with those that differ by ending numbers. Where only one stem of such a family is asked for, the
    r-th row gets the r-th number that isn't taken, found from the gaps between the taken ones by windows; the other
    families are folded in order, with one number a distinct stem in memory.
    """
    remembered = F.col("remembered") if "remembered" in rows.columns else F.lit(None).cast("string")
    kept = rows.where(remembered.isNotNull()).select("id", "folder", remembered.alias("file_name"))
    named = rows.where(remembered.isNull()).select("id", "folder", safe_name(F.col("name")).alias("stem"))
    family = lambda name: F.regexp_replace(name, r"(_[1-9][0-9]*)+$", "").alias("family")
    taken = existing.select("folder", "stem").unionByName(kept.select("folder", F.col("file_name").alias("stem"))).where("stem is not null").distinct()
    asked = named.select("*", family(F.col("stem")))
    several = asked.groupBy("folder", "family").agg((F.min("stem") != F.max("stem")).alias("several"))
    asked = asked.join(several, ["folder", "family"])
    one = asked.where("not several").select("id", "folder", "stem", (F.row_number().over(Window.partitionBy("folder", "stem").orderBy("id")) - 1).cast("long").alias("rank"))

    # the number of a taken name for every stem that it may be one of: the name itself has 0, stem_7 has 7
    ending = F.regexp_extract("stem", r"(?s)^.+_([1-9][0-9]*)$", 1)
    numbers = taken.select("folder", "stem", F.lit(0).cast("long").alias("number")).unionByName(
        taken.where(ending != "").select("folder", F.regexp_extract("stem", r"(?s)^(.+)_[1-9][0-9]*$", 1).alias("stem"), ending.try_cast("long").alias("number")).where("number is not null"))
    stem = Window.partitionBy("folder", "stem")
    gaps = numbers.join(one.select("folder", "stem").distinct(), ["folder", "stem"], "left_semi").select(
        "folder", "stem", (F.col("number") - F.row_number().over(stem.orderBy("number")) + 1).alias("rank"), F.lit(None).cast(dict(named.dtypes)["id"]).alias("id"), F.lit(1).alias("gap"))
    both = one.withColumn("gap", F.lit(0)).unionByName(gaps)
    before = F.sum("gap").over(stem.orderBy("rank", F.desc("gap"), "id").rowsBetween(Window.unboundedPreceding, 0))
    number = F.col("rank") + F.col("before")
    single = (both.withColumn("before", before).where("gap = 0")
              .select("id", "folder", F.when(number == 0, F.col("stem")).otherwise(F.concat("stem", F.lit("_"), number.cast("string"))).alias("file_name")))

    crowded = asked.where("several")
    known = taken.select("*", family(F.col("stem"))).join(crowded.select("folder", "family").distinct(), ["folder", "family"], "left_semi")
    in_order = crowded.select("id", "folder", "family", "stem", F.lit(1).alias("number")).unionByName(
        known.select(F.lit(None).cast(dict(named.dtypes)["id"]).alias("id"), "folder", "family", "stem", F.lit(None).cast("int").alias("number")))
    keyed = in_order.withColumns({"of": F.struct("folder", "family"), "at": F.struct("number", "id", "stem")})
    kinds = dict(named.dtypes)
    folded = fold_in_order(keyed, "of", "at", lambda _: _Names(), f"id {kinds['id']}, folder {kinds['folder']}, file_name string")
    return single.unionByName(folded).unionByName(kept)
