"""Timecodes as column expressions; times are seconds from the start of the media, as doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

_CLOCK = r"^(?:(\d+):)?(\d{1,3}):(\d{1,2})(?:[.,](\d{1,3}))?$"
_PLAIN = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


#: White space of Unicode, as regular expressions know it.
_BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space at either end, Unicode's included. The text stands once in it, so that nested ones stay small."""
    return F.btrim(text, F.lit(_BLANK))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _clock_seconds(parts: Column) -> Column:
    number = lambda n: F.coalesce(F.get(parts, n).try_cast("double"), F.lit(0.0))
    fraction = F.coalesce(F.get(parts, 4).try_cast("double") / F.pow(F.lit(10.0), F.length(F.get(parts, 4))), F.lit(0.0))
    return F.when((number(2) <= 59) & (number(3) <= 59), number(1) * 3600 + number(2) * 60 + number(3) + fraction)


def _seconds(raw: Column) -> Column:
    parts = F.split(F.regexp_replace(raw, _CLOCK, "\0$1\0$2\0$3\0$4"), "\0")  # nothing, and then the four parts of the clock
    plain = F.replace(raw, F.lit(","), F.lit("."))
    value = F.when(plain.rlike(_PLAIN), plain.try_cast("double"))
    return F.when(raw.rlike(_CLOCK), _once(parts, _clock_seconds)).otherwise(F.when(value >= 0, value))


def parse_timecode(text: Column) -> Column:
    """Seconds of ``[h:]mm:ss[.,]fff`` or of a plain number; null for negative, empty or unreadable ones."""
    return _once(strip(text), _seconds)


def millis(seconds: Column) -> Column:
    """Whole milliseconds, halves to even; negative times count as 0."""
    return F.rint(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")


def _clock(seconds: Column, hours: str, mark: str) -> Column:
    ms = millis(seconds)
    return F.format_string(
        f"{hours}:%02d:%02d{mark}%03d", F.expr("0L") + F.floor(ms / 3_600_000).cast("long"), F.floor(ms % 3_600_000 / 60_000).cast("long"),
        F.floor(ms % 60_000 / 1000).cast("long"), (ms % 1000).cast("long"))


def format_srt(seconds: Column) -> Column:
    """hh:mm:ss,mmm"""
    return _clock(seconds, "%02d", ",")


#: What a table of cues shows is the SRT form.
format_display = format_srt


def format_vtt(seconds: Column) -> Column:
    """hh:mm:ss.mmm"""
    return _clock(seconds, "%02d", ".")


def format_ass(seconds: Column) -> Column:
    """h:mm:ss.cc, hundredths cut off."""
    return F.regexp_replace(_clock(seconds, "%d", "."), r"\d$", "")


def parse_time_range(text: Column) -> Column:
    """struct(start_s, end_s) of ``a --> b``, ``a → b`` or ``a -> b``; the second may be missing, which gives null."""
    parts = F.split(text, "-->|→|->", 2)
    return F.struct(parse_timecode(F.get(parts, 0)).alias("start_s"), parse_timecode(F.get(parts, 1)).alias("end_s"))
