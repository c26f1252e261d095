"""Timing checks, repairs and plans over the order of a document's cues."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from .cues import CUE, MIN_DURATION, blank, by_time, cue_metrics, in_order

MAX_CPS, LEAST, MOST, MAX_GAP, MAX_RATIO = 21.0, 0.5, 8.0, 15.0, 1.6


def remove_overlaps(cues: DataFrame, min_gap: float = 0.04) -> DataFrame:
    """Sorted cues whose ends keep ``min_gap`` from the next start; fixed tells which were changed."""
    following = F.lead("start_s").over(by_time())
    cut = F.greatest(F.col("start_s") + MIN_DURATION, following - min_gap)
    end = F.when(F.col("end_s") > following - min_gap, cut).otherwise(F.col("end_s"))
    return (cues.withColumns({"new_end": end, "at": F.row_number().over(by_time()) - 1})
            .select("doc_id", F.col("at").alias("idx"), "start_s",
                    F.when(F.abs(F.col("new_end") - F.col("end_s")) > 1e-6, F.col("new_end")).otherwise(F.col("end_s")).alias("end_s"),
                    "text", "translation", "speaker", (F.abs(F.col("new_end") - F.col("end_s")) > 1e-6).alias("fixed")))


def check_timing(cues: DataFrame, max_cps: float = MAX_CPS, least: float = LEAST, most: float = MOST, max_gap: float = MAX_GAP,
                 max_ratio: float = MAX_RATIO, digits: int | None = None) -> DataFrame:
    """(doc_id, idx, kind, severity, message): the issues of each cue; the next cue is the next in list order.

    Times that were written as decimals have differences that binary fractions miss by a little; with ``digits`` these are
    rounded to as many decimals, so that a gap of just 15 s between such times is not over 15 s.
    """
    m = cue_metrics(cues).withColumn("following", F.lead("start_s").over(in_order()))
    d, gap = F.col("duration_s"), F.col("following") - F.col("end_s")
    if digits is not None:
        d, gap = F.round(d, digits), F.round(gap, digits)
        m = m.withColumn("cps", F.when(d > 0, F.col("chars") / d).otherwise(0.0))
    issue = lambda kind, severity, message: F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), message.alias("message"))
    place = (F.col("idx") + 2).cast("long")
    found = F.array(
        F.when(F.col("end_s") <= F.col("start_s"), issue("negative", "error", F.lit("end is not after start")))
        .when(d < least, issue("short", "warning", F.format_string("too short (%.2f s)", d)))
        .when(d > most, issue("long", "warning", F.format_string("too long (%.1f s)", d))),
        F.when((d > 0) & (F.col("cps") > max_cps), issue("fast", "warning", F.format_string("too fast (%.0f characters/s)", "cps"))),
        F.when(blank("text") & blank("translation"), issue("empty", "warning", F.lit("no content"))),
        F.when(~blank("translation") & (F.col("length_ratio") > max_ratio),
               issue("ratio", "warning", F.format_string("translation is %.2f times as long", "length_ratio"))),
        F.when(F.col("end_s") > F.col("following") + 1e-6, issue("overlap", "error", F.format_string("overlaps cue %d (%.2f s)", place, -gap)))
        .when(gap > max_gap, issue("gap", "warning", F.format_string("gap of %.0f s before cue %d", gap, place))))
    return m.select("doc_id", "idx", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select("doc_id", "idx", "i.*")


def sort_issues(issues: DataFrame) -> DataFrame:
    return issues.orderBy("doc_id", "idx", "kind")


def issue_summary(issues: DataFrame) -> DataFrame:
    """Issues, errors and the count of each kind by document."""
    kinds = ("negative", "short", "long", "fast", "empty", "ratio", "overlap", "gap")
    return issues.groupBy("doc_id").agg(F.count("*").alias("issues"), F.count_if(F.col("severity") == "error").alias("errors"),
                                        *[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


def make_continuous(cues: DataFrame, max_gap: float = 1.5) -> DataFrame:
    """Ends moved to the next start over gaps of at most ``max_gap``."""
    following = F.lead("start_s").over(in_order())
    gap = following - F.col("end_s")
    return cues.withColumn("end_s", F.when((gap > 0) & (gap <= max_gap), following).otherwise(F.col("end_s")))


def merge_exact_repeats(cues: DataFrame, max_gap: float = 0.2) -> DataFrame:
    """Neighbours of equal text at most ``max_gap`` apart become one: islands, for start-sorted cues with end >= start."""
    before_text, before_end = F.lag("text").over(in_order()), F.lag("end_s").over(in_order())
    gap = F.col("start_s") - before_end
    new = F.coalesce(~((F.col("text") == before_text) & (gap >= 0) & (gap <= max_gap)), F.lit(True))
    grouped = cues.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(in_order()))
    first = lambda c: F.min_by(c, "idx").alias(c)
    return (grouped.groupBy("doc_id", "island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), first("text"), first("translation"), first("speaker"))
            .withColumn("idx", F.col("island") - 1).select(CUE))


def voice_timeline(cues: DataFrame, voices: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(timings, lengths) for voices (doc_id, idx, voice_s) and totals (doc_id, total_s).

    timings: (doc_id, idx, src_start, src_end, target_s, new_start, new_end). A cue's span ends where the next one
    starts; its target is the longer of span and voice; spans are laid end to end after what stands before the first.
    lengths: (doc_id, total_s) of the result, with the rest after the last span. Starts must increase strictly, so that
    no span depends on another.
    """
    following = F.lead("start_s").over(in_order())
    rows = cues.select("doc_id", "idx", "start_s", "end_s").join(voices.select("doc_id", "idx", "voice_s"), ["doc_id", "idx"], "left")
    src_end = F.coalesce(following, F.greatest(F.col("end_s"), F.col("start_s") + 0.04))
    target = F.greatest(F.lit(0.04), F.col("src_end") - F.col("start_s"), F.coalesce("voice_s", F.lit(0.0)))
    first = F.first("start_s").over(in_order())
    rows = (rows.withColumn("src_end", src_end).withColumn("lead_in", F.when(first > 0.001, first).otherwise(0.0)).withColumn("target_s", target))
    before = F.coalesce(F.sum("target_s").over(in_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + F.col("lead_in")
    r6 = lambda c: F.rint(c * 1e6) / 1e6
    placed = rows.withColumn("at", before)
    timings = placed.select("doc_id", "idx", F.col("start_s").alias("src_start"), "src_end", "target_s",
                            r6(F.col("at")).alias("new_start"), r6(F.col("at") + F.col("target_s")).alias("new_end"))
    ends = placed.groupBy("doc_id").agg(F.max_by(F.col("at") + F.col("target_s"), "idx").alias("laid"), F.max_by("src_end", "idx").alias("source"))
    rest = F.when(F.col("source") < F.col("total_s") - 0.001, F.col("total_s") - F.col("source")).otherwise(0.0)
    return timings, ends.join(totals, "doc_id").select("doc_id", (F.col("laid") + rest).alias("total_s"))


def dub_fit_plan(cues: DataFrame, voices: DataFrame, must_fit: bool = False, avoid_overlap: bool = True, most: float = 2.5) -> DataFrame:
    """(doc_id, idx, slot_s, voice_s, tempo, apply, over): how much faster each voice has to be to fit its slot."""
    following = F.lead("start_s").over(in_order())
    slot_end = F.when(following > F.col("start_s"), F.least(F.col("end_s"), following)).otherwise(F.col("end_s"))
    slot = F.greatest(F.lit(0.1), slot_end - F.col("start_s"))
    need = F.lit(must_fit) | (F.lit(avoid_overlap) & (F.col("voice_s") > F.col("slot_s")))
    rows = cues.withColumn("slot_s", slot).join(voices, ["doc_id", "idx"]).withColumn("raw", F.when(need, F.col("voice_s") / F.col("slot_s")).otherwise(1.0))
    return rows.select("doc_id", "idx", "slot_s", "voice_s", F.least(F.col("raw"), F.lit(most)).alias("tempo"), (F.col("raw") > 1.02).alias("apply"), (F.col("raw") > most).alias("over"))


def dub_report(plan: DataFrame, short_ms: float = 500.0) -> DataFrame:
    return plan.groupBy("doc_id").agg(F.count_if(F.col("voice_s") > 0).alias("made"), F.count_if(F.coalesce(F.col("voice_s"), F.lit(0.0)) <= 0).alias("failed"),
                                      F.count_if("over").alias("over_tempo"), F.count_if(F.col("voice_s") * 1000 < short_ms).alias("short"))


def translation_batches(cues: DataFrame, size: int = 25) -> DataFrame:
    """(doc_id, batch, texts, context_before, context_after): non-blank texts in order, with the texts around each batch."""
    size = max(1, size)
    rows = cues.where(~blank("text")).withColumns({
        "n": F.row_number().over(in_order()) - 1, "before": F.lag("text").over(in_order()), "after": F.lead("text").over(in_order())})
    return (rows.withColumn("batch", F.floor(F.col("n") / size)).groupBy("doc_id", "batch")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias("texts"),
                 F.coalesce(F.min_by("before", "n"), F.lit("")).alias("context_before"), F.coalesce(F.max_by("after", "n"), F.lit("")).alias("context_after")))


def spread_sample(rows: DataFrame, key: str, order: str, count: int) -> DataFrame:
    """Evenly spaced ``count`` rows of each key, the ends included, places rounded half to even."""
    w = Window.partitionBy(key)
    placed = rows.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    wanted = F.when(F.col("_n") <= count, F.sequence(F.lit(0), F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(max(count - 1, 0))), lambda i: F.rint(i * (F.col("_n") - 1) / max(count - 1, 1)).cast("int")))
    return placed.where((F.col("_n") <= count) | F.array_contains(wanted, F.col("_i"))).drop("_i", "_n")


def thin(rows: DataFrame, key: str, order: str, keep: int) -> DataFrame:
    """Every ceil(n / keep)-th row of each key."""
    w = Window.partitionBy(key)
    placed = rows.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    return placed.where(F.col("_i") % F.ceil(F.col("_n") / keep) == 0).drop("_i", "_n")


def frame_gap(stamps: DataFrame, fallback: float) -> DataFrame:
    """(video_id, gap_s): the largest positive gap of neighbouring stamps, at most twice the fallback; none: the fallback."""
    w = Window.partitionBy("video_id").orderBy("stamp_s")
    gaps = stamps.withColumn("g", F.col("stamp_s") - F.lag("stamp_s").over(w))
    return gaps.groupBy("video_id").agg(F.coalesce(F.least(F.max(F.when(F.col("g") > 0, F.col("g"))), F.lit(2 * fallback)), F.lit(fallback)).alias("gap_s"))


