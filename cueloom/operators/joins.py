"""Joins on time, text and position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from .folds import fold_in_order
from ..functions.fuzzy import alike_pairs, text_ratio
from ..functions.text import translation_key
from ..functions.timecode import strip
from .cues import blank


#: Levels of time cells: 2 ** -6 s to 2 ** 55 s, by what is added to make them numbers from 0 to 61.
_FINEST, _COARSEST = -6, 55


def _level(start: Column, end: Column) -> Column:
    """The level of the smallest cells that are as long as a span, so that it touches two of them, or by rounding three."""
    return F.greatest(F.lit(_FINEST), F.least(F.lit(_COARSEST), F.ceil(F.log2(F.greatest(end - start, F.lit(2.0 ** _FINEST)))))).cast("int")


def _cell(t: Column, level: Column) -> Column:
    return F.floor(t / F.pow(F.lit(2.0), level.cast("double")))


def stabbed(points: DataFrame, at: str, spans: DataFrame) -> DataFrame:
    """Each point (doc_id, ...) with each span (doc_id, start_s, end_s, ...) of its document for which start_s <= at < end_s.

    An interval join on cells of time at levels of their own: a span of any length is a row in each of the two cells that
    it touches at the level of its length, a point one in its cell at each level that occurs. Which levels those are is
    one number, told to all tasks; there is no width to choose.
    """
    real = (F.col("end_s") > F.col("start_s")) & ~F.isnan("end_s") & (F.abs("start_s") < 1e15)
    leveled = spans.where(real).withColumn("_level", _level(F.col("start_s"), F.col("end_s")))
    placed = leveled.withColumn("_cell", F.explode(F.sequence(_cell(F.col("start_s"), F.col("_level")), _cell(F.least("end_s", F.lit(1e15)), F.col("_level")))))
    occurring = leveled.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_level") - _FINEST)).alias("levels")).scalar()  # one number
    levels = F.filter(F.sequence(F.lit(_FINEST), F.lit(_COARSEST)), lambda n: F.call_function("shiftright", F.col("_levels"), n - _FINEST).bitwiseAND(F.lit(1).cast("long")) == 1)
    asked = (points.where(F.abs(at) < 1e15).withColumn("_levels", occurring).withColumn("_level", F.explode(levels))
             .withColumn("_cell", _cell(F.col(at), F.col("_level"))).drop("_levels"))
    return asked.join(placed, ["doc_id", "_level", "_cell"]).where((F.col("start_s") <= F.col(at)) & (F.col(at) < F.col("end_s"))).drop("_level", "_cell")


def cue_at(cues: DataFrame, probes: DataFrame) -> DataFrame:
    """(doc_id, t, idx): the first cue in list order with start <= t < end, -1 if there is none."""
    asked = probes.select("doc_id", "t").distinct()
    hits = stabbed(asked, "t", cues.select("doc_id", "idx", "start_s", "end_s")).groupBy("doc_id", "t").agg(F.min("idx").alias("idx"))
    return asked.join(hits, ["doc_id", "t"], "left").select("doc_id", "t", F.coalesce("idx", F.lit(-1)).alias("idx"))


def align_translations(cues: DataFrame, source: DataFrame, reach: float = 2.0) -> DataFrame:
    """(doc_id, idx, source_idx, translation): the source row that each cue's middle falls in, else the nearest in reach.

    Hits come from an interval join, the first in source order; the others from the nearest middles before and after in
    one ordered pass, the first on ties. Cues without either keep their translation.
    """
    mid = lambda: (F.col("start_s") + F.col("end_s")) / 2
    asked = cues.select("doc_id", "idx", "translation", mid().alias("mid"))
    rows = source.select("doc_id", F.col("idx").alias("source_idx"), "start_s", "end_s", F.col("text").alias("source_text"), mid().alias("source_mid"))
    hits = (stabbed(asked.select("doc_id", "idx", "mid"), "mid", rows.select("doc_id", "source_idx", "source_text", "start_s", "end_s"))
            .groupBy("doc_id", "idx").agg(F.min(F.struct("source_idx", "source_text")).alias("hit")))
    # as-of: rows of one middle are reduced to the first in source order, then carried to the cues from both sides
    marks = rows.groupBy("doc_id", F.col("source_mid").alias("at")).agg(F.min(F.struct("source_idx", "source_text")).alias("row"))
    line = (asked.select("doc_id", F.col("mid").alias("at"), "idx", F.lit(None).cast("struct<at:double,row:struct<source_idx:bigint,source_text:string>>").alias("m"))
            .unionByName(marks.select("doc_id", "at", F.lit(None).cast("bigint").alias("idx"),
                                      F.struct("at", F.struct(F.col("row.source_idx").cast("bigint").alias("source_idx"), F.col("row.source_text").alias("source_text")).alias("row")).alias("m"))))
    w = Window.partitionBy("doc_id").orderBy("at")
    before = F.last("m", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first("m", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))
    near = line.withColumns({"p": before, "n": after}).where("idx is not null")
    dp, dn = F.col("at") - F.col("p.at"), F.col("n.at") - F.col("at")
    closer = F.when(F.col("p").isNull(), F.col("n")).when(F.col("n").isNull(), F.col("p")).otherwise(
        F.when(dp < dn, F.col("p")).when(dn < dp, F.col("n")).otherwise(F.when(F.col("p.row.source_idx") <= F.col("n.row.source_idx"), F.col("p")).otherwise(F.col("n"))))
    near = near.select("doc_id", "idx", closer.alias("c"), "at").select("doc_id", "idx", F.when(F.abs(F.col("c.at") - F.col("at")) <= reach, F.col("c.row")).alias("near"))
    best = F.coalesce(F.struct(F.col("hit.source_idx").cast("bigint").alias("source_idx"), F.col("hit.source_text").alias("source_text")), F.lit(None))
    out = asked.join(hits, ["doc_id", "idx"], "left").join(near, ["doc_id", "idx"], "left")
    chosen = F.when(F.col("hit").isNotNull(), best).otherwise(F.col("near"))
    return out.withColumn("c", chosen).select("doc_id", "idx", F.coalesce("c.source_idx", F.lit(-1)).cast("long").alias("source_idx"),
                                              F.coalesce("c.source_text", "translation").alias("translation"))


def fuzzy_anti_join(rows: DataFrame, ignore: DataFrame, key: str = "video_id", threshold: float = 0.85) -> DataFrame:
    """Rows whose text is not like any ignored text (key, item) of their video; rows without a text stay.

    Alike: equal whatever the case, or lengths within max(4, len(item) / 2) and a ratio of ``threshold``. Distinct texts
    are joined through an index of their rare characters (``alike_pairs``), so that few pairs are compared.
    """
    texts = rows.select(key, F.lower("text").alias("a"))
    items = ignore.select(key, F.lower("item").alias("b"))
    li, lt = F.length("b"), F.length("a")
    pairs = alike_pairs(texts, items, [key], threshold)
    bad = pairs.where((F.col("a") == F.col("b")) | (F.abs(li - lt) <= F.greatest(F.lit(4), F.floor(li / 2)))).select(key, F.col("a").alias("low")).distinct()
    return rows.withColumn("low", F.lower("text")).join(bad, [key, "low"], "left_anti").drop("low")


def translation_memory(cues: DataFrame, memory: DataFrame, provider: str, source: str, target: str) -> DataFrame:
    """(doc_id, idx, key, translation, pending): memory (key, result) by the text's key; blank results never overwrite."""
    keyed = cues.where(~blank("text")).withColumn("key", translation_key(F.lit(provider), F.lit(source), F.lit(target), F.col("text")))
    hit = keyed.join(memory.select("key", "result"), "key", "left")
    good = F.coalesce(strip(F.col("result")) != "", F.lit(False))
    return hit.select("doc_id", "idx", "key", F.when(good, F.col("result")).otherwise(F.col("translation")).alias("translation"), (~good).alias("pending"))


def missing_frames(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """(cache_key, frame_idx) of the frames 0 to total - 1 of wanted (cache_key, total) that are not cached."""
    every = wanted.where("total > 0").select("cache_key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total").cast("long") - 1)).alias("frame_idx"))
    return every.join(cached.select("cache_key", F.col("frame_idx").cast("long").alias("frame_idx")), ["cache_key", "frame_idx"], "left_anti")


def pitch_label(pitch: Column, limit: float = 165.0) -> Column:
    return F.when(pitch <= 0, "?").when(pitch < limit, "Nam").otherwise("Nu")


def assign_speakers(cues: DataFrame, pitches: DataFrame) -> DataFrame:
    """cues with the speaker of pitches (doc_id, idx, pitch) unless it is unknown, and whether it was assigned."""
    label = pitch_label(F.col("pitch"))
    joined = cues.join(pitches.select("doc_id", "idx", "pitch"), ["doc_id", "idx"], "left")
    known = F.col("pitch").isNotNull() & (label != "?")
    return joined.withColumns({"assigned": known, "speaker": F.when(known, label).otherwise(F.col("speaker"))}).drop("pitch")


def match_voice_profile(cues: DataFrame, profiles: DataFrame) -> DataFrame:
    """(doc_id, idx, profile): for profiles (pos, name, gender), the first of the speaker's gender, else the first
    default one, else the first; null without profiles. The profiles are reduced to one row before the join."""
    gender = F.lower(strip(F.col("gender")))
    default = gender.isin("", "mac dinh", "default")
    best = profiles.agg(
        F.min_by("name", F.when(gender == "nam", F.col("pos"))).alias("m"), F.min_by("name", F.when(gender.isin("nu", "nữ"), F.col("pos"))).alias("f"),
        F.min_by("name", F.when(default, F.col("pos"))).alias("d"), F.min_by("name", "pos").alias("a")).withColumn("_one", F.lit(1))
    who = F.lower(strip(F.col("speaker")))
    fit = F.when(who == "nam", F.col("m")).when(who.isin("nu", "nữ"), F.col("f"))
    return cues.withColumn("_one", F.lit(1)).join(F.broadcast(best), "_one", "left").select("doc_id", "idx", F.coalesce(fit, "d", "a").alias("profile"))


def refine_boundaries(cues: DataFrame, fine: DataFrame, step: float, threshold: float = 0.8) -> DataFrame:
    """Cue times moved to where fine reads (doc_id, stamp_s, text) first show and last show the cue's text.

    Reads within ``step`` before the start and the end are found by a bucketed range join; a fold over each document's
    cues keeps a start from going before the refined end of the one before.
    """
    b = lambda c: F.floor(c / step)
    wide = cues.withColumns({"lo_s": F.greatest(F.lit(0.0), F.col("start_s") - step), "lo_e": F.greatest(F.lit(0.0), F.col("end_s") - step)})
    windows = wide.select("doc_id", "idx", "text", "start_s", "end_s", "lo_s", "lo_e",
                          F.explode(F.array_distinct(F.array(b(F.col("lo_s")), b(F.col("start_s")), b(F.col("lo_e")), b(F.col("end_s"))))).alias("b"))
    near = windows.join(fine.select("doc_id", "stamp_s", F.col("text").alias("read"), b(F.col("stamp_s")).alias("b")), ["doc_id", "b"])
    early = F.col("stamp_s").between(F.col("lo_s"), F.col("start_s")) & (F.col("start_s") > 0)
    late = F.col("stamp_s").between(F.col("lo_e"), F.col("end_s"))
    seen = near.where(early | late).withColumns({"early": early, "late": late})
    same = (F.col("read") == F.col("text")) | F.coalesce((F.length("read") > 0) & (text_ratio(F.col("read"), F.col("text")) >= threshold), F.lit(False))
    told = seen.withColumn("same", same)
    # a read at the very moment of the first match is not after it, in whatever order the two come
    told = told.withColumn("met", F.min(F.when(F.col("late") & F.col("same"), F.col("stamp_s"))).over(Window.partitionBy("doc_id", "idx")))
    bounds = told.groupBy("doc_id", "idx").agg(F.min(F.when(F.col("early") & F.col("same"), F.col("stamp_s"))).alias("appeared"),
                                              F.min(F.when(F.col("late") & ~F.col("same") & (F.col("stamp_s") > F.col("met")), F.col("stamp_s"))).alias("gone"))
    rows = cues.join(bounds, ["doc_id", "idx"], "left")
    schema = f"doc_id {cues.schema['doc_id'].dataType.simpleString()}, idx long, start_s double, end_s double, text string, translation string, speaker string"
    return fold_in_order(rows.select("doc_id", "idx", "start_s", "end_s", "text", "translation", "speaker", "appeared", "gone"), "doc_id", "idx", lambda _: _Refined(), schema)


class _Refined:
    """Carries the end of the cue before."""

    def __init__(self):
        self.last = 0.0

    def take(self, row: dict):
        moved = row["start_s"] if row["appeared"] is None else min(row["appeared"], row["end_s"] - 0.05)
        start, gone = max(self.last, moved), row["gone"]
        self.last = gone if gone is not None and gone > start + 0.05 else row["end_s"]
        yield row["doc_id"], row["idx"], start, self.last, row["text"], row["translation"], row["speaker"]

    def end(self):
        return ()


def apply_timing(cues: DataFrame, timing: DataFrame) -> DataFrame:
    """Times of timing (doc_id, idx, new_start, new_end) where a document has one for each cue and it is a range."""
    w = Window.partitionBy("doc_id")
    counts = timing.groupBy("doc_id").agg(F.count("*").alias("_m"))
    rows = cues.withColumn("_n", F.count("*").over(w)).join(counts, "doc_id", "left").join(timing.select("doc_id", "idx", "new_start", "new_end"), ["doc_id", "idx"], "left")
    good = F.coalesce((F.col("_n") == F.col("_m")) & (F.col("new_end") > F.col("new_start")), F.lit(False))
    return rows.withColumns({"start_s": F.when(good, F.col("new_start")).otherwise(F.col("start_s")),
                             "end_s": F.when(good, F.col("new_end")).otherwise(F.col("end_s"))}).drop("_n", "_m", "new_start", "new_end")


_REPLY = "struct<translations:array<struct<id:string,text:string>>>"


def scatter_results(batches: DataFrame) -> DataFrame:
    """(batch, texts): replies (batch, response, expected) with JSON translations put at their ids, '' where missing.

    Tags and code fences around the JSON are dropped; ids out of range or unreadable are ignored; the last of an id wins.
    """
    body = F.regexp_extract(F.regexp_replace("response", r"(?s)<think>.*?</think>|```(?:json)?", ""), r"(?s)\{.*\}", 0)
    parsed = F.coalesce(F.from_json(body, _REPLY)["translations"], F.array().cast("array<struct<id:string,text:string>>"))
    placed = F.transform(parsed, lambda r: F.struct(r["id"].try_cast("int").alias("id"), F.coalesce(r["text"], F.lit("")).alias("text")))
    one = lambda i: F.coalesce(F.try_element_at(F.transform(F.filter(F.col("p"), lambda r: r["id"] == i), lambda r: r["text"]), F.lit(-1)), F.lit(""))
    rows = batches.select("batch", "expected", placed.alias("p"))
    texts = F.when(F.col("expected") > 0, F.transform(F.sequence(F.lit(0), F.col("expected") - 1), one)).otherwise(F.array().cast("array<string>"))
    return rows.select("batch", texts.alias("texts"))


def language_names(rows: DataFrame, names: dict[str, str], column: str = "lang") -> DataFrame:
    """Adds language_name; codes that are not named stand for themselves."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return rows.withColumn("language_name", F.coalesce(table[F.col(column)], F.col(column)))
