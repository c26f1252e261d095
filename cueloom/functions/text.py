"""Text rules as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F

from .timecode import strip

#: The code points that count as Chinese, Japanese or Korean.
CJK = "぀-ヿ㐀-鿿가-힯"
_CLAUSE_END = "。！？!?；;，,、"


def collapse_ws(text: Column) -> Column:
    """White space to single spaces, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_markup(text: Column) -> Column:
    """Without {...} and the formatting tags; literal \\N and \\n become line breaks."""
    plain = F.regexp_replace(text, r"\{[^}]*\}", "")
    plain = F.regexp_replace(plain, r"(?i)</?(?:b|i|u|font|ruby|rt|c|v)(?:[ .][^>]*)?>", "")
    return strip(F.regexp_replace(plain, r"\\[Nn]", "\n"))


def normalize_punctuation(text: Column) -> Column:
    """ASCII marks, no space before them and one after."""
    plain = F.replace(text, F.lit("…"), F.lit("..."))
    plain = F.translate(plain, "；，。！？", ";,.!?")
    plain = F.regexp_replace(plain, r"(?U)\s+([,.;:!?])", "$1")
    plain = F.regexp_replace(plain, r"(?U)([,.;:!?])(?=[^\s,.;:!?])", "$1 ")
    return collapse_ws(plain)


def apply_glossary(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Ordered literal replacements whatever the case; a replacement is put in as it is."""
    for source, target in pairs:
        if source:
            quoted = target.replace("\\", "\\\\").replace("$", "\\$")
            text = F.regexp_replace(text, f"(?iu){re.escape(source)}", quoted)
    return text


def apply_dictionary(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """As ``apply_glossary``, the longest source first."""
    return apply_glossary(text, sorted(pairs, key=lambda p: -len(p[0])))


def split_text(text: Column, ratio: Column) -> Column:
    """struct(left, right): lines cut at the ratio, else the nearest space to it; ties go left, no space leaves all left."""
    t = strip(F.coalesce(text, F.lit("")))
    n = F.length(t)
    lines = F.split(t, "\n")
    count = F.size(lines)
    at_line = F.greatest(F.lit(1), F.least(count - 1, F.rint(count * ratio).cast("int")))
    target = F.greatest(F.lit(1), F.least(n - 1, F.rint(n * ratio).cast("int")))
    head = F.substring(t, F.lit(1), target)
    before, after = F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1, F.position(F.lit(" "), t, target + 1) - 1
    left, right = F.when(before > 0, before), F.when(after > 0, after)
    cut = F.when(left.isNull(), right).when(right.isNull(), left).otherwise(F.when(target - left <= right - target, left).otherwise(right))
    by_line = F.struct(strip(F.array_join(F.slice(lines, 1, at_line), "\n")).alias("left"),
                       strip(F.array_join(F.slice(lines, at_line + 1, F.greatest(count - at_line, F.lit(0))), "\n")).alias("right"))
    whole = F.struct(t.alias("left"), F.lit("").alias("right"))
    by_space = F.struct(strip(F.substring(t, F.lit(1), cut)).alias("left"), strip(F.substring(t, cut + 1, n)).alias("right"))
    return F.when(n == 0, whole).when(t.contains("\n"), by_line).when(cut.isNull(), whole).otherwise(by_space)


def packed(parts: list[str], limit: int, joint: str) -> list[str]:
    """Greedy packing of parts into strings of at most ``limit`` characters; a longer part stands alone."""
    out: list[str] = []
    held: list[str] = []
    size = 0
    for part in parts:
        if held and size + len(joint) + len(part) > limit:
            out.append(joint.join(held))
            held, size = [], 0
        size += len(part) + (len(joint) if held else 0)
        held.append(part)
    return [*out, joint.join(held)] if held else out


def _packed(text: Column, limit: int, unspaced: Column) -> Column:
    """Packed words of a text, or the clauses of an unspaced one, cut where they are too long. Over Arrow batches, as it
    is linear in the text so, where a fold of native arrays copies them at every word."""
    clause = re.compile(f"(?<=[{_CLAUSE_END}])")

    def parts(t: str, whole: bool) -> list[str]:
        if not whole:
            return packed([w for w in t.split(" ") if w], limit, " ")
        return packed([c[at: at + limit] for c in clause.split(t) for at in range(0, len(c), limit)], limit, "")

    @F.pandas_udf("array<string>")
    def pack(texts: pd.Series, wholes: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else parts(t, bool(u)) for t, u in zip(texts, wholes)], dtype=object)

    return pack(text, unspaced)


def _slices(part: Column, limit: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length(part), F.lit(1)) - 1) / limit).cast("int")),
                       lambda k: F.substring(part, k * limit + 1, F.lit(limit)))


def split_by_length(text: Column, limit: int) -> Column:
    """Parts of at most ``limit`` characters: words packed greedily; a text without spaces is cut after clause marks."""
    unspaced = ~strip(text).contains(" ") & (F.length(strip(text)) > limit)
    return _packed(collapse_ws(text), limit, unspaced)


def wrap_lines(text: Column, max_chars: int, max_lines: int, on_overflow: str = "keep") -> Column:
    """Lines of at most ``max_chars``; words beyond the last line are kept on it, or cut off with 'truncate'."""
    spaced = text.contains(" ")
    lines = F.when(spaced, _packed(text, max_chars, F.lit(False))).otherwise(_slices(text, max_chars))
    out = F.array_join(F.slice(lines, 1, max_lines), "\n")
    if on_overflow != "truncate":
        more = F.slice(lines, max_lines + 1, F.size(lines))
        rest = F.when(spaced, F.concat(F.lit(" "), F.array_join(more, " "))).otherwise(F.array_join(more, ""))
        out = F.concat(out, F.when(F.size(lines) > max_lines, rest).otherwise(""))
    return F.when((F.length(text) <= max_chars) | F.lit(max_lines <= 1), text).otherwise(out)


def translation_key(provider: Column, source: Column, target: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", provider, source, target, text).cast("binary"), 256)


def _json_string(text: Column) -> Column:
    return F.expr("''") if text is None else F.regexp_extract(F.to_json(F.struct(text.alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)


def voice_key(provider: Column, rate: Column, text: Column, voice: Column, volume: Column) -> Column:
    """sha256 of the sorted settings and the collapsed text as JSON."""
    return F.sha2(F.concat(F.lit('{"provider": '), _json_string(provider), F.lit(', "rate": '), rate.cast("int").cast("string"),
                           F.lit(', "text": '), _json_string(collapse_ws(text)), F.lit(', "voice": '), _json_string(voice),
                           F.lit(', "volume": '), volume.cast("int").cast("string"), F.lit("}")).cast("binary"), 256)


def frame_cache_key(**parts: Column) -> Column:
    """sha256 of the named settings, sorted by name, as JSON."""
    return F.sha2(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)])).cast("binary"), 256)


def pause_ms(text: Column, end_pause: int = 250, newline: int = 400, sentence: int = 300, comma: int = 200) -> Column:
    """Pause after a spoken text: by a line break or its last mark, at least ``end_pause``."""
    t = strip(text)
    found = (F.when(text.contains("\n"), newline).when(t.rlike(r"[.!?]$"), sentence).when(t.rlike(r"[,;:]$"), comma).otherwise(0))
    return F.greatest(found, F.lit(end_pause))


def word_overlap(a: Column, b: Column) -> Column:
    """Share of b's distinct words a-z that a has too."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)))
    return F.size(F.array_intersect(words(a), words(b))) / F.greatest(F.lit(1), F.size(words(b)))


def trim_repeat(left: Column, right: Column, limit: int = 12) -> Column:
    """right without the longest beginning, up to ``limit`` characters, that left ends in, whatever the case."""
    same = F.filter(F.sequence(F.lit(limit), F.lit(1), F.lit(-1)), lambda n: (n <= F.length(left)) & (n <= F.length(right)) & (
        F.lower(F.right(left, n)) == F.lower(F.left(right, n))))
    return F.substring(right, F.coalesce(F.get(same, 0), F.lit(0)) + 1, F.length(right))


def separator(left: Column, right: Column) -> Column:
    """Nothing next to CJK or before closing marks, else a space."""
    tight = left.rlike(f"[{CJK}]$") | right.rlike(f"^[{CJK}]") | right.rlike(r"^[,.;:!?%)\]}…]")
    return F.when((left == "") | (right == "") | tight, F.lit("")).otherwise(F.lit(" "))


# ---- colours


def parse_color(text: Column) -> Column:
    """struct(r, g, b) of #RGB, #RRGGBB or r,g,b (also with ;), else null."""
    t = strip(text)
    hex6 = F.when(t.rlike("^#?[0-9A-Fa-f]{6}$"), F.regexp_replace(t, "#", "")).when(
        t.rlike("^#?[0-9A-Fa-f]{3}$"), F.regexp_replace(F.regexp_replace(t, "#", ""), "(.)", "$1$1"))
    channel = lambda n: F.conv(F.substring(hex6, n, 2), 16, 10).cast("int")
    parts = F.split(t, "[,;]")
    given = lambda n: F.trim(F.get(parts, n)).try_cast("int")
    fits = (F.size(parts) == 3) & F.forall(parts, lambda p: F.coalesce(F.trim(p).try_cast("int").between(0, 255), F.lit(False)))
    make = lambda f, a, b, c: F.struct(f(a).alias("r"), f(b).alias("g"), f(c).alias("b"))
    return F.when(hex6.isNotNull(), make(channel, 1, 3, 5)).when(fits, make(given, 0, 1, 2))


def format_color(rgb: Column) -> Column:
    return F.when(rgb.isNotNull(), F.format_string("#%02X%02X%02X", rgb["r"], rgb["g"], rgb["b"])).otherwise(F.lit(""))


def color_name(rgb: Column) -> Column:
    """A colour's name: grey tones by their lightness, the others by the first range of channels that fits (fixed values)."""
    r, g, b = rgb["r"], rgb["g"], rgb["b"]
    light, dark = F.greatest(r, g, b), F.least(r, g, b)
    grey = F.when(light >= 200, "trang").when(light <= 60, "den").otherwise("xam")
    return (F.when(rgb.isNull(), "chua ro").when(light - dark <= 32, grey)
            .when((r >= 180) & (g >= 150) & (b <= 120), "vang").when((r >= 150) & (F.greatest(g, b) <= 120), "do")
            .when((g >= 150) & (r <= 140), "xanh la").when((b >= 150) & (r <= 150), "xanh duong")
            .when(F.least(r, b) >= 150, "tim").otherwise("mau khac"))


def ass_color(rgb: Column, opacity: Column) -> Column:
    """&HAABBGGRR, alpha being how transparent it is; null for a null colour."""
    alpha = F.rint((100 - F.greatest(F.lit(0), F.least(F.lit(100), opacity))) * 255 / 100).cast("int")
    return F.when(rgb.isNotNull(), F.format_string("&H%02X%02X%02X%02X", alpha, rgb["b"], rgb["g"], rgb["r"]))
