"""Row-wise operators, filters, edits and summaries on cues (doc_id, idx, start_s, end_s, text, translation, speaker)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, Window
from pyspark.sql.window import WindowSpec

from ..functions import text as tx
from ..functions.timecode import format_srt, strip

MIN_DURATION = 0.05
CUE = ["doc_id", "idx", "start_s", "end_s", "text", "translation", "speaker"]

def in_order() -> WindowSpec:
    """A document's cues in list order."""
    return Window.partitionBy("doc_id").orderBy("idx")


def by_time() -> WindowSpec:
    """A document's cues by start, end and list order."""
    return Window.partitionBy("doc_id").orderBy("start_s", "end_s", "idx")


def duration() -> Column:
    return F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s"))


def blank(column: str) -> Column:
    return strip(F.coalesce(F.col(column), F.lit(""))) == ""


# ---- projections

def normalize_cues(cues: DataFrame) -> DataFrame:
    """Times not below 0, texts stripped, null texts empty."""
    texts = {c: strip(F.coalesce(F.col(c), F.lit(""))) for c in ("text", "translation", "speaker")}
    return cues.withColumns({c: F.greatest(F.lit(0.0), F.col(c)) for c in ("start_s", "end_s")} | texts)


def cue_metrics(cues: DataFrame) -> DataFrame:
    """Adds duration_s, chars, cps and length_ratio."""
    chars, original = F.length("text"), F.length(strip(F.col("text")))
    return (cues.withColumns({"duration_s": duration(), "chars": chars})
            .withColumns({"cps": F.when(duration() > 0, chars / duration()).otherwise(0.0),
                          "length_ratio": F.when(original > 0, F.length(strip(F.col("translation"))) / original).otherwise(0.0)}))


def display_text(mode: str = "original") -> Column:
    """What a cue shows: its text, its translation, or both where there are both."""
    text, other = F.col("text"), F.col("translation")
    if mode == "translation":
        return F.when(other != "", other).otherwise(text)
    if mode == "both":
        return F.when((text != "") & (other != ""), F.concat(text, F.lit("\n"), other)).when(text != "", text).otherwise(other)
    return F.when(text != "", text).otherwise(other)


def shift_cues(cues: DataFrame, offset: float, chosen: Column | None = None) -> DataFrame:
    """Times moved by ``offset``, not below 0 and with the least duration; only ``chosen`` rows if given."""
    start = F.greatest(F.lit(0.0), F.col("start_s") + offset)
    end = F.greatest(start + MIN_DURATION, F.col("end_s") + offset)
    pick = F.lit(True) if chosen is None else chosen
    return cues.withColumns({"start_s": F.when(pick, start).otherwise(F.col("start_s")), "end_s": F.when(pick, end).otherwise(F.col("end_s"))})


def scale_cues(cues: DataFrame, factor: float) -> DataFrame:
    if factor <= 0:
        raise ValueError("the factor must be over 0")
    return cues.withColumns({c: F.col(c) * factor for c in ("start_s", "end_s")})


def round_cues(cues: DataFrame) -> DataFrame:
    """Times to three decimals, halves to even."""
    return cues.withColumns({c: F.rint(F.col(c) * 1000) / 1000 for c in ("start_s", "end_s")})


def cue_table_view(cues: DataFrame) -> DataFrame:
    """(doc_id, idx, label, speaker, time, text, translation, ratio) as shown in a table."""
    flat = lambda c: F.replace(F.col(c), F.lit("\n"), F.lit(" "))
    m = cue_metrics(cues)
    return m.select(
        "doc_id", "idx", F.format_string("No. %d", (F.col("idx") + 1).cast("long")).alias("label"),
        F.when(F.col("speaker") == "", "1").otherwise(F.col("speaker")).alias("speaker"),
        F.concat(format_srt(F.col("start_s")), F.lit(" --> "), format_srt(F.col("end_s"))).alias("time"),
        flat("text").alias("text"), flat("translation").alias("translation"),
        F.when(F.col("length_ratio") > 0, F.format_string("%.2f", "length_ratio")).otherwise("-").alias("ratio"))


def sort_cues(cues: DataFrame) -> DataFrame:
    """By start, end and former position within each document, renumbered from 0."""
    return cues.withColumn("idx", F.row_number().over(by_time()) - 1)


# ---- filters

def clean_cues(cues: DataFrame, drop_chars: str = "", drop_words: str = "") -> DataFrame:
    """Without the listed characters and words; white space collapsed; rows left empty go."""
    text = F.col("text")
    for char in filter(None, (c.strip() for c in drop_chars.split(","))):
        text = F.replace(text, F.lit(char), F.lit(""))
    for word in filter(None, (w.strip() for w in drop_words.split(","))):
        text = F.regexp_replace(text, f"(?iu){re.escape(word)}", "")
    return cues.withColumn("text", tx.collapse_ws(text)).where(F.col("text") != "")


def drop_invalid_cues(cues: DataFrame) -> DataFrame:
    return cues.where(~blank("text") & (F.col("end_s") > F.col("start_s")))


def pending_cues(cues: DataFrame) -> DataFrame:
    """Cues with a text to work on, at their positions."""
    return cues.where(~blank("text"))


def voice_windows(cues: DataFrame, least: float = 0.25, most: float = 4.0) -> DataFrame:
    """(doc_id, idx, start_s, length_s) of the part of each cue to listen to."""
    return (cues.where(F.col("end_s") - F.col("start_s") >= least)
            .select("doc_id", "idx", "start_s", F.greatest(F.lit(MIN_DURATION), F.least(F.col("end_s"), F.col("start_s") + most) - F.col("start_s")).alias("length_s")))


# ---- edits

def merge_cues(cues: DataFrame, chosen: DataFrame) -> DataFrame:
    """Merges the chosen (doc_id, idx) of each document, two or more and in a row, into the first of them.

    Documents whose choice isn't so stay as they are. Later positions move up.
    """
    spans = (chosen.distinct().groupBy("doc_id").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("n"))
             .where("n >= 2 and last - first = n - 1"))
    marked = cues.join(spans, "doc_id", "left").withColumn("merging", F.coalesce(F.col("idx").between(F.col("first"), F.col("last")), F.lit(False)))
    ordered = F.array_sort(F.collect_list(F.struct("idx", "text", "translation", "speaker")))
    said = lambda c: F.array_join(F.filter(F.transform(F.col("rows"), lambda r: strip(r[c])), lambda t: t != ""), " ").alias(c)
    merged = (marked.where("merging").groupBy("doc_id", F.col("first").alias("idx"))
              .agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), ordered.alias("rows"))
              .select("doc_id", "idx", "start_s", "end_s", said("text"), said("translation"),
                      F.coalesce(F.get(F.filter(F.transform("rows", lambda r: r["speaker"]), lambda s: s != ""), 0), F.lit("")).alias("speaker")))
    rest = marked.where("not merging").withColumn("idx", F.when(F.col("idx") > F.col("last"), F.col("idx") - F.col("n") + 1).otherwise(F.col("idx")))
    return rest.select(CUE).unionByName(merged.select(CUE))


def split_cues(cues: DataFrame, cuts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cues, rejects): each cut (doc_id, idx, t) well inside its cue splits it in two; others are rejects."""
    cut = cues.join(cuts.select("doc_id", "idx", "t"), ["doc_id", "idx"], "left")
    good = (F.col("t") >= F.col("start_s") + MIN_DURATION) & (F.col("t") <= F.col("end_s") - MIN_DURATION)
    share = F.try_divide(F.col("t") - F.col("start_s"), F.col("end_s") - F.col("start_s"))
    marked = cut.withColumns({"good": F.coalesce(good, F.lit(False)), "a": tx.split_text(F.col("text"), share), "b": tx.split_text(F.col("translation"), share)})
    whole = F.array(F.struct(F.lit(0).alias("half"), "start_s", "end_s", "text", "translation"))
    halves = F.array(
        F.struct(F.lit(0).alias("half"), "start_s", F.col("t").alias("end_s"), F.col("a.left").alias("text"), F.col("b.left").alias("translation")),
        F.struct(F.lit(1).alias("half"), F.col("t").alias("start_s"), "end_s", F.col("a.right").alias("text"), F.col("b.right").alias("translation")))
    out = (marked.select("doc_id", "idx", "speaker", F.explode(F.when(F.col("good"), halves).otherwise(whole)).alias("h"))
           .select("doc_id", "idx", "speaker", "h.*")
           .withColumn("idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("idx", "half")) - 1).select(CUE))
    rejects = marked.where("t is not null and not good").select("doc_id", "idx", "t", F.lit("the cut is not inside the cue").alias("message"))
    return out, rejects


def update_cues(cues: DataFrame, edits: DataFrame) -> DataFrame:
    """Applies edits (doc_id, idx, start_s, end_s, text, translation, speaker), null for unchanged, at most one a cue.

    A new range must end after it starts, else the old times stay; a new end alone is held to the least duration.
    """
    new = edits.select("doc_id", "idx", *[F.col(c).alias(f"new_{c}") for c in CUE[2:]])
    joined = cues.join(new, ["doc_id", "idx"], "left")
    ranged, fits = F.col("new_start_s").isNotNull() & F.col("new_end_s").isNotNull(), F.col("new_end_s") > F.col("new_start_s")
    start = F.when(ranged & fits, F.col("new_start_s")).otherwise(F.col("start_s"))
    end = (F.when(ranged, F.when(fits, F.col("new_end_s")).otherwise(F.col("end_s")))
           .when(F.col("new_end_s").isNotNull(), F.greatest(F.col("new_end_s"), F.col("start_s") + MIN_DURATION)).otherwise(F.col("end_s")))
    return joined.select("doc_id", "idx", start.alias("start_s"), end.alias("end_s"), *[F.coalesce(f"new_{c}", c).alias(c) for c in CUE[4:]])


def delete_cues(cues: DataFrame, chosen: DataFrame) -> DataFrame:
    """Without the chosen (doc_id, idx), renumbered."""
    return cues.join(chosen.select("doc_id", "idx"), ["doc_id", "idx"], "left_anti").withColumn("idx", F.row_number().over(in_order()) - 1)


def insert_cues(cues: DataFrame, times: DataFrame, seconds: float = 2.0) -> DataFrame:
    """With an empty cue at each (doc_id, t), sorted and renumbered."""
    new = times.select("doc_id", F.lit(None).cast("long").alias("idx"), F.col("t").alias("start_s"), (F.col("t") + seconds).alias("end_s"),
                       *[F.lit("").alias(c) for c in CUE[4:]])
    late = Window.partitionBy("doc_id").orderBy("start_s", "end_s", F.col("idx").asc_nulls_last())
    return cues.select(CUE).unionByName(new).withColumn("idx", F.row_number().over(late) - 1)


def append_cues(cues: DataFrame, more: DataFrame) -> DataFrame:
    """Both lists' cues, sorted and renumbered; on ties the first list's come first."""
    both = cues.select(*CUE, F.lit(0).alias("list")).unionByName(more.select(*CUE, F.lit(1).alias("list")))
    order = Window.partitionBy("doc_id").orderBy("start_s", "end_s", "list", "idx")
    return both.withColumn("idx", F.row_number().over(order) - 1).drop("list")


# ---- summaries

def doc_summary(cues: DataFrame) -> DataFrame:
    return cues.groupBy("doc_id").agg(
        F.count("*").alias("cue_count"), F.sum(F.length("text")).alias("total_chars"),
        F.count_if(~blank("translation")).alias("translated"), F.coalesce(F.max("end_s"), F.lit(0.0)).alias("duration_s"))


def project_rollup(projects: DataFrame, cues: DataFrame) -> DataFrame:
    """projects (doc_id, target_language, has_dub, has_render) with counts and states."""
    some = projects.join(doc_summary(cues), "doc_id", "left")
    return some.select(
        "doc_id", F.coalesce("cue_count", F.lit(0)).alias("cue_count"), F.coalesce("total_chars", F.lit(0)).alias("total_chars"),
        (F.coalesce("cue_count", F.lit(0)) > 0).alias("has_subtitle"), (F.coalesce("translated", F.lit(0)) > 0).alias("has_translation"),
        "has_dub", "has_render", F.coalesce(F.nullif("target_language", F.lit("")), F.lit("vi")).alias("target_language"))


def project_states(projects: DataFrame) -> DataFrame:
    """Label columns of the five states, the language shown and the count with dots."""
    label = lambda c: F.when(F.col(c), "yes").otherwise("no").alias(c)
    return projects.select(
        "doc_id", *[label(c) for c in ("has_audio", "has_subtitle", "has_translation", "has_dub", "has_render")],
        F.coalesce(F.nullif("language", F.lit("")), F.nullif("target_language", F.lit("")), F.lit("-")).alias("language"),
        F.translate(F.format_number("char_count", 0), ",", ".").alias("chars"))


def reset_interrupted(projects: DataFrame) -> DataFrame:
    """Projects with a task under way: task emptied, progress 0, status 'closed earlier'."""
    busy = F.coalesce(F.col("task"), F.lit("")) != ""
    return projects.withColumns({"task": F.lit(""), "progress": F.when(busy, 0).otherwise(F.col("progress")),
                                 "status": F.when(busy, "closed earlier").otherwise(F.col("status"))})


def search_projects(projects: DataFrame, keyword: str = "", only_pending: bool = False) -> DataFrame:
    found = projects.where(F.lower(F.concat_ws(" ", F.col("id").cast("string"), "name", "status", "task")).contains(keyword.strip().lower()))
    return found.where(~F.col("has_render")) if only_pending else found


def first_n_per_key(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    at = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(at)).where(F.col("_n") <= n).drop("_n")


def project_log(log: DataFrame, project_id: int, n: int = 200) -> DataFrame:
    """(id, line): the latest ``n`` rows of one project as text."""
    line = F.concat(F.lit("["), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.lit("] "), "name", F.lit(" - "), "status", F.lit(": "), "message")
    return log.where(F.col("project_id") == project_id).orderBy(F.desc("id")).limit(n).select("id", line.alias("line"))


def batch_status(runs: DataFrame) -> DataFrame:
    """Counts of run states by batch; messages are cut to 50,000 characters elsewhere by ``log_rows``."""
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    return runs.groupBy("batch").agg(is_("running").alias("running"), is_("pending").alias("waiting"), is_("done").alias("done"),
                                     is_("failed", "cancelled").alias("failed"))


def log_rows(runs: DataFrame, most: int = 50_000) -> DataFrame:
    return runs.withColumn("message", F.left("message", F.lit(most)))
