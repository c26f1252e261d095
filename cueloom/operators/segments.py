"""Splitting long cues and joining short ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..functions.text import collapse_ws, split_by_length, wrap_lines
from .cues import CUE
from .folds import fold_in_order

class _Joining:
    """The cue that may still grow, and how many are out."""

    def __init__(self, doc_id, least: float, most: float, limit: int):
        self.doc_id, self.least, self.most, self.limit, self.cue, self.count, self.last = doc_id, least, most, limit, None, 0, 0.0

    def whole(self, row: dict) -> dict:
        """The row without nulls."""
        start = self.last if row["start_s"] is None else row["start_s"]
        self.last = start if row["end_s"] is None else row["end_s"]
        return row | {"start_s": start, "end_s": self.last} | {c: row[c] or "" for c in ("text", "translation", "speaker")}

    def takes(self, row: dict) -> bool:
        """Whether a short row continues the open cue: near enough, and neither too long in time nor in characters."""
        spans = [max(0.0, c["end_s"] - c["start_s"]) for c in (self.cue, row)]
        near = row["start_s"] - self.cue["end_s"] < 0.4
        return near and spans[1] < self.least and sum(spans) <= self.most and len(self.cue["text"]) + 1 + len(row["text"]) <= self.limit

    def take(self, row: dict):
        row = self.whole(row)
        if self.cue is not None and self.takes(row):
            self.cue |= {"end_s": row["end_s"], "text": f"{self.cue['text']} {row['text']}".strip()}
            return
        yield from self.end()
        self.cue = row

    def end(self):
        if self.cue is not None:
            yield (self.doc_id, self.count, *(self.cue[c] for c in CUE[2:]))
            self.count += 1


def merge_short(cues: DataFrame, least: float = 0.6, most: float = 7.0, limit: int = 84) -> DataFrame:
    """Short cues are appended to the one before where the length, duration and gap of the result allow it.

    Null texts count as empty, a null start as the end of the row before (0 at first), a null end as the start.
    """
    schema = f"doc_id {cues.schema['doc_id'].dataType.simpleString()}, idx long, start_s double, end_s double, text string, translation string, speaker string"
    return fold_in_order(cues.select(*CUE), "doc_id", "idx", lambda doc_id: _Joining(doc_id, least, most, limit), schema)


def split_long(cues: DataFrame, max_chars: int = 42, max_lines: int = 2, on_overflow: str = "keep") -> DataFrame:
    """Cues with a text in parts of at most max_chars * max_lines, wrapped; a part's time is its share of the characters.

    Translations of split cues are cleared; blank cues go.
    """
    limit = max(10, max_chars * max(1, max_lines))
    rows = cues.withColumn("text", collapse_ws(F.coalesce("text", F.lit("")))).where("text <> ''")
    long = F.length("text") > limit
    rows = rows.withColumn("parts", F.when(long, split_by_length(F.col("text"), limit)).otherwise(F.array("text")))
    chars = F.aggregate(F.transform("parts", F.length), F.lit(0), lambda a, x: a + x)
    span = F.greatest(F.greatest(F.lit(0.0), F.col("end_s") - F.col("start_s")), F.lit(0.1))
    kind = "struct<at:double,out:array<struct<s:double,e:double,t:string>>>"

    def place(state: Column, part: Column) -> Column:
        end = F.least(F.col("end_s"), state["at"] + F.col("span") * (F.length(part) / F.col("chars")))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(state["at"].alias("s"), F.greatest(state["at"] + 0.05, end).alias("e"), part.alias("t")))).alias("out")).cast(kind)

    rows = rows.withColumns({"chars": chars, "span": span})
    placed = F.aggregate("parts", F.struct(F.col("start_s").alias("at"), F.array().alias("out")).cast(kind), place)["out"]
    whole = F.array(F.struct(F.col("start_s").alias("s"), F.col("end_s").alias("e"), F.col("text").alias("t")))
    out = rows.select("doc_id", "idx", "translation", "speaker", F.posexplode(F.when(F.size("parts") > 1, placed).otherwise(whole)).alias("k", "p"), (F.size("parts") > 1).alias("cut"))
    w = Window.partitionBy("doc_id").orderBy("idx", "k")
    return out.select("doc_id", (F.row_number().over(w) - 1).cast("long").alias("idx"), F.col("p.s").alias("start_s"), F.col("p.e").alias("end_s"),
                      wrap_lines(F.col("p.t"), max_chars, max_lines, on_overflow).alias("text"), F.when(F.col("cut"), "").otherwise(F.col("translation")).alias("translation"), "speaker")


def resegment(cues: DataFrame, max_chars: int = 42, max_lines: int = 2, least: float = 0.6, most: float = 7.0, on_overflow: str = "keep") -> DataFrame:
    """Long cues split and wrapped (``on_overflow`` as in ``wrap_lines``), then short ones joined to the one before."""
    limit = max(10, max_chars * max(1, max_lines))
    return merge_short(split_long(cues, max_chars, max_lines, on_overflow), least, most, limit)
