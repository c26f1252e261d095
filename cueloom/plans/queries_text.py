"""Queries on text and time functions, sources, sinks, audits and media."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fuzzy, geometry as geo, text as x, timecode as tc
from ..operators import audit, joins
from ..operators.spread import spread
from ..sources import decoding, sinks, subtitles
from ..streaming import run as streams
from .registry import MS, cues_out, lcs, ms, register, sql
from .relations import table, v_configs, v_cues, v_lines


def m(e: str) -> str:
    return MS.format(e)


def clock(e: str, mark: str, hours: str = "%02d") -> str:
    return f"printf('{hours}:%02d:%02d{mark}%03d', {e} // 3600000, {e} % 3600000 // 60000, {e} % 60000 // 1000, {e} % 1000)"


# ---- timecodes
register("format_timecodes", lambda s, d: v_cues(s, d).select("doc_id", "idx", tc.format_srt(F.col("start_s")).alias("srt"), tc.format_vtt(F.col("start_s") - 50).alias("vtt"), tc.format_ass(F.col("end_s")).alias("ass"), tc.format_display(F.col("end_s")).alias("display")),
         sql(f"""WITH q AS (SELECT doc_id, idx, {m('start_s')} AS a, {m('greatest(start_s - 50, 0)')} AS b, {m('end_s')} AS c FROM v_cues)
 SELECT doc_id, idx, {clock('a', ',')} AS srt, {clock('b', '.')} AS vtt, printf('%d:%02d:%02d.%02d', c // 3600000, c % 3600000 // 60000, c % 60000 // 1000, c % 1000 // 10) AS ass, {clock('c', ',')} AS display FROM q""", "v_cues"))
register("parse_timecode", lambda s, d: v_cues(s, d).select("doc_id", "idx", ms(tc.parse_timecode(
    F.when(F.col("idx") % 4 == 0, tc.format_srt(F.col("start_s"))).when(F.col("idx") % 4 == 1, F.concat(F.lit(" "), F.col("value").cast("string"))).when(F.col("idx") % 4 == 2, F.concat(F.lit("00:75:0"), (F.col("idx") % 10).cast("string"))).otherwise(F.concat((F.col("idx") % 60).cast("string"), F.lit(":07.5"))))).alias("t_ms")),
    sql(f"SELECT doc_id, idx, CASE idx % 4 WHEN 0 THEN {m('start_s')} WHEN 1 THEN {m('value')} WHEN 3 THEN (idx % 60 * 60 + 7) * 1000 + 500 END AS t_ms FROM v_cues", "v_cues"))
register("parse_time_range", lambda s, d: v_cues(s, d).select("doc_id", "idx", tc.parse_time_range(F.concat(tc.format_srt(F.col("start_s")), F.element_at(F.array(F.lit(" --> "), F.lit(" → "), F.lit("->")), (F.col("idx") % 3 + 1).cast("int")), tc.format_srt(F.col("end_s")))).alias("r")).select("doc_id", "idx", ms("r.start_s").alias("start_ms"), ms("r.end_s").alias("end_ms")),
         sql(f"SELECT doc_id, idx, {m('start_s')} AS start_ms, {m('end_s')} AS end_ms FROM v_cues", "v_cues"))

# ---- texts
L = "SELECT doc_id, idx, {} FROM v_lines"
register("strip_markup", lambda s, d: v_lines(s, d).select("doc_id", "idx", x.strip_markup(F.concat(F.lit("{\\an8}<i>"), "text", F.lit("</i>\\N<font color=red>x</font>"))).alias("plain")), sql(L.format("text || chr(10) || 'x' AS plain"), "v_lines"))
register("collapse_ws", lambda s, d: v_lines(s, d).select("doc_id", "idx", x.collapse_ws(F.concat(F.lit("\t "), F.replace("text", F.lit(" "), F.lit(" \n ")))).alias("plain")), sql(L.format("trim(regexp_replace(text, '\\s+', ' ', 'g')) AS plain"), "v_lines"))
register("normalize_punctuation", lambda s, d: v_lines(s, d).select("doc_id", "idx", x.normalize_punctuation(F.concat(F.replace("text", F.lit(", "), F.lit(" ，")), F.lit("…"))).alias("plain")),
         sql(L.format("trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(text, ', ', ' ,'), '，', ','), '…', '...') || '...', '\\s+([,.;:!?])', '\\1', 'g'), '([,.;:!?])([^\\s,.;:!?])', '\\1 \\2', 'g'), '\\s+', ' ', 'g')) AS plain"), "v_lines"))
PAIRS = [("the", "DER"), ("of", "$1"), ("ing", "\\")]
register("apply_glossary", lambda s, d: v_lines(s, d).select("doc_id", "idx", x.apply_glossary(F.col("text"), PAIRS).alias("done")),
         sql(L.format("regexp_replace(regexp_replace(regexp_replace(text, 'the', 'DER', 'gi'), 'of', '$1', 'gi'), 'ing', '\\\\', 'gi') AS done"), "v_lines"))
register("apply_dictionary", lambda s, d: v_lines(s, d).select("doc_id", "idx", x.apply_dictionary(F.col("text"), [("th", "1"), ("then", "2"), ("the", "3")]).alias("done")),
         sql(L.format("regexp_replace(regexp_replace(regexp_replace(text, 'then', '2', 'gi'), 'the', '3', 'gi'), 'th', '1', 'gi') AS done"), "v_lines"))
register("split_text", lambda s, d: v_lines(s, d).select("doc_id", "idx", x.split_text(F.col("text"), F.lit(0.4)).alias("t")).select("doc_id", "idx", "t.left", "t.right"),
         sql("""WITH q AS (SELECT doc_id, idx, text, length(text) AS n, greatest(1, least(length(text) - 1, CAST(round_even(length(text) * 0.4::DOUBLE, 0) AS INT))) AS g FROM v_lines),
 p AS (SELECT *, list_filter(range(1, n), lambda i: substring(text, i + 1, 1) = ' ') AS sp FROM q), c AS (SELECT *, list_max(list_filter(sp, lambda i: i < g)) AS a, list_min(list_filter(sp, lambda i: i >= g)) AS b FROM p),
 z AS (SELECT *, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN g - a <= b - g THEN a ELSE b END AS cut FROM c)
 SELECT doc_id, idx, CASE WHEN cut IS NULL THEN text ELSE trim(text[1:cut]) END AS left, CASE WHEN cut IS NULL THEN '' ELSE trim(text[cut + 1:]) END AS right FROM z""", "v_lines"))
_SPACES = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def greedy(name: str, source: str, keys: str, limit: int) -> str:
    """Relations {name}_f and {name} (keys, k, part): the texts t of a source (keys, t, u) cut greedily, a part a step; u: 'words', 'clauses' or 'slices'."""
    head = f"substring(rest, 1, {limit + 1})"
    marked = f"length(regexp_extract(substring(rest, 1, {limit}), '^.*[{x._CLAUSE_END}]'))"
    word = f"length({head}) - length(regexp_extract({head}, '[^ ]*$')) - 1"
    size = f"""CASE WHEN length(rest) <= {limit} THEN length(rest) WHEN u = 'slices' THEN {limit} WHEN u = 'clauses' THEN CASE WHEN {marked} > 0 THEN {marked} ELSE {limit} END
 WHEN {word} > 0 THEN {word} WHEN strpos(rest, ' ') > 0 THEN strpos(rest, ' ') - 1 ELSE length(rest) END"""
    return f"""{name}_f AS (SELECT {keys}, u, 0 AS k, t AS rest, NULL::VARCHAR AS part FROM {source}
 UNION ALL SELECT {keys}, u, k + 1, CASE WHEN u = 'words' THEN ltrim(substring(rest, n + 1), ' ') ELSE substring(rest, n + 1) END, substring(rest, 1, n) FROM (SELECT *, {size} AS n FROM {name}_f WHERE rest <> '')),
 {name} AS MATERIALIZED (SELECT {keys}, k, part FROM {name}_f WHERE k > 0)"""


LINES = f"WITH c AS MATERIALIZED (SELECT doc_id, idx, trim(regexp_replace(text, '{_SPACES}', ' ', 'g'), ' ') AS t, NOT contains(text, ' ') AS whole FROM v_lines)"


def wrapped(text: str, lines: str, chars: int, most: int, keep: bool) -> str:
    more = f" || CASE WHEN len({lines}) > {most} THEN CASE WHEN contains({text}, ' ') THEN ' ' || array_to_string({lines}[{most + 1}:], ' ') ELSE array_to_string({lines}[{most + 1}:], '') END ELSE '' END" if keep else ""
    return f"CASE WHEN length({text}) <= {chars} THEN {text} ELSE array_to_string({lines}[1:{most}], chr(10)){more} END"


register("split_by_length", lambda s, d: v_lines(s, d).select("doc_id", "idx", F.array_join(x.split_by_length(F.col("text"), 60), "|").alias("parts")),
         sql(LINES + ", src AS (SELECT doc_id, idx, t, CASE WHEN whole AND length(t) > 60 THEN 'clauses' ELSE 'words' END AS u FROM c), " + greedy("p", "src", "doc_id, idx", 60) +
             " SELECT doc_id, idx, string_agg(part, '|' ORDER BY k) AS parts FROM p GROUP BY ALL", "v_lines", recursive=True))
register("wrap_lines", lambda s, d: v_lines(s, d).select("doc_id", "idx", x.wrap_lines(x.collapse_ws(F.col("text")), 42, 3, "truncate").alias("wrapped"), x.wrap_lines(x.collapse_ws(F.col("text")), 42, 3).alias("kept")),
         sql(LINES + ", src AS (SELECT doc_id, idx, t, CASE WHEN contains(t, ' ') THEN 'words' ELSE 'slices' END AS u FROM c), " + greedy("p", "src", "doc_id, idx", 42) +
             ", l AS (SELECT doc_id, idx, list(part ORDER BY k) AS ls FROM p GROUP BY ALL) SELECT doc_id, idx, " + wrapped("t", "ls", 42, 3, False) + " AS wrapped, " + wrapped("t", "ls", 42, 3, True) + " AS kept FROM c JOIN l USING (doc_id, idx)", "v_lines", recursive=True))
#: Long lines in parts of 84, each wrapped at 42; a part's time is its share of the characters; short ones are joined to the one before.
RESEGMENT = (LINES + ", src AS (SELECT doc_id, idx, t, CASE WHEN whole AND length(t) > 84 THEN 'clauses' ELSE 'words' END AS u FROM c WHERE length(t) > 84), " + greedy("long", "src", "doc_id, idx", 84) +
             """, z AS (SELECT doc_id, idx, sum(length(part)) AS chars, max(k) AS n FROM long GROUP BY ALL),
 pl AS (SELECT doc_id, idx, 0 AS k, idx * 3.0::DOUBLE AS at_s, NULL::DOUBLE AS s, NULL::DOUBLE AS e, NULL::VARCHAR AS t FROM z WHERE n > 1
 UNION ALL SELECT long.doc_id, long.idx, long.k, y.e, pl.at_s, greatest(pl.at_s + 0.05::DOUBLE, y.e), long.part FROM pl JOIN long ON long.doc_id = pl.doc_id AND long.idx = pl.idx AND long.k = pl.k + 1 JOIN z ON z.doc_id = long.doc_id AND z.idx = long.idx,
 LATERAL (SELECT least((long.idx + 1) * 3.0::DOUBLE, pl.at_s + ((long.idx + 1) * 3.0::DOUBLE - long.idx * 3.0::DOUBLE) * (length(long.part) / z.chars)) AS e) y),
 parts AS MATERIALIZED (SELECT doc_id, idx, k, s, e, t FROM pl WHERE k > 0 UNION ALL SELECT doc_id, idx, 0, idx * 3.0::DOUBLE, (idx + 1) * 3.0::DOUBLE, t FROM c WHERE t <> '' AND (doc_id, idx) NOT IN (SELECT (doc_id, idx) FROM z WHERE n > 1)),
 wide AS (SELECT doc_id, idx, k AS at_k, t, CASE WHEN contains(t, ' ') THEN 'words' ELSE 'slices' END AS u FROM parts WHERE length(t) > 42), """ + greedy("w", "wide", "doc_id, idx, at_k", 42) +
             ", l AS (SELECT doc_id, idx, at_k, list(part ORDER BY k) AS ls FROM w GROUP BY ALL), done AS (SELECT parts.doc_id, parts.idx, k, s, e, " + wrapped("t", "ls", 42, 2, True) + """ AS text FROM parts LEFT JOIN l ON l.doc_id = parts.doc_id AND l.idx = parts.idx AND l.at_k = parts.k),
 n AS MATERIALIZED (SELECT doc_id, s AS start_s, e AS end_s, text, row_number() OVER (PARTITION BY doc_id ORDER BY idx, k) AS k, greatest(0, e - s) AS dur FROM done),
 f AS (SELECT doc_id, k, start_s, end_s, text, 0::BIGINT AS idx FROM n WHERE k = 1 UNION ALL
 SELECT n.doc_id, n.k, CASE WHEN j THEN f.start_s ELSE n.start_s END, n.end_s, CASE WHEN j THEN trim(f.text || ' ' || n.text) ELSE n.text END, CASE WHEN j THEN f.idx ELSE f.idx + 1 END
 FROM f JOIN n ON n.doc_id = f.doc_id AND n.k = f.k + 1, LATERAL (SELECT n.dur < 0.6::DOUBLE AND greatest(0, f.end_s - f.start_s) + n.dur <= 7 AND length(f.text) + length(n.text) + 1 <= 84 AND n.start_s - f.end_s < 0.4::DOUBLE AS j)),
 o AS (SELECT *, '' AS translation, '' AS speaker FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, idx ORDER BY k DESC) = 1) SELECT {CUES} FROM o""")
register("translation_key", lambda s, d: v_lines(s, d).select("doc_id", "idx", x.translation_key(F.lit("g"), F.lit("en"), F.lit("vi"), F.col("text")).alias("key")), sql(L.format("sha256('g|en|vi|' || text) AS key"), "v_lines"))
register("voice_key", lambda s, d: v_cues(s, d).select("doc_id", "idx", x.voice_key(F.lit("p"), F.lit(0), F.col("text"), F.col("speaker"), F.lit(100)).alias("key")),
         sql("""SELECT doc_id, idx, sha256('{"provider": "p", "rate": 0, "text": "' || text || '", "voice": "' || speaker || '", "volume": 100}') AS key FROM v_cues""", "v_cues"))
register("frame_cache_key", lambda s, d: table(s, d, "part").select("p_partkey", x.frame_cache_key(video=F.col("p_name"), fps=F.round("p_retailprice", 6), region=F.array("p_size")).alias("key")),
         sql("""SELECT p_partkey, sha256('{"fps":' || round(p_retailprice::DOUBLE, 6)::VARCHAR || ',"region":[' || p_size || '],"video":' || to_json(p_name)::VARCHAR || '}') AS key FROM part"""))
register("pause_ms", lambda s, d: v_lines(s, d).select("doc_id", "idx", x.pause_ms(F.when(F.col("idx") % 3 == 0, F.concat("text", F.lit("\nx"))).otherwise(F.col("text"))).alias("pause")),
         sql(L.format("CASE WHEN idx % 3 = 0 THEN 400 WHEN regexp_matches(text, '[.!?]$') THEN 300 ELSE 250 END AS pause"), "v_lines"))
register("pitch_label", lambda s, d: v_cues(s, d).select("doc_id", "idx", joins.pitch_label(F.col("value") * 3 - 10).alias("label")), sql("SELECT doc_id, idx, CASE WHEN value * 3 - 10 <= 0 THEN '?' WHEN value * 3 - 10 < 165 THEN 'Nam' ELSE 'Nu' END AS label FROM v_cues", "v_cues"))
register("effective_fps", lambda s, d: v_cues(s, d).select("doc_id", "idx", F.round(audit.effective_fps(F.col("value") / 10, F.col("value") / 20, True), 6).alias("fast"), F.round(audit.effective_fps(F.col("value") / 10, F.col("value") / 20), 6).alias("plain")),
         sql("SELECT doc_id, idx, round(CASE WHEN value / 20 > 1 THEN least(greatest(0.5, value / 10), greatest(0.5, value / 20 / 2)) ELSE greatest(0.5, value / 10) END, 6) AS fast, round(greatest(0.5, value / 10), 6) AS plain FROM v_cues", "v_cues"))
register("word_overlap", lambda s, d: table(s, d, "part").select("p_partkey", F.round(x.word_overlap(F.concat("p_name", F.lit(" red blue")), F.concat(F.lit("Red "), "p_name", F.lit(" Small 7"), "p_type")), 6).alias("share")),
         """WITH q AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name || ' red blue'), '[a-z]+')) AS a, list_distinct(regexp_extract_all(lower('Red ' || p_name || ' Small 7' || p_type), '[a-z]+')) AS b FROM part)
 SELECT p_partkey, round(len(list_intersect(a, b)) / greatest(1, len(b)), 6) AS share FROM q""")
register("trim_repeat", lambda s, d: table(s, d, "part").select("p_partkey", x.trim_repeat(F.concat(F.lit("a "), F.left("p_name", F.lit(5))), F.upper("p_name")).alias("rest")),
         """WITH q AS (SELECT p_partkey, 'a ' || left(p_name, 5) AS l, upper(p_name) AS r FROM part) SELECT p_partkey, r[coalesce(list_max(list_filter(range(1, 13), lambda n: n <= length(l) AND n <= length(r) AND lower(right(l, n)) = lower(left(r, n)))), 0) + 1:] AS rest FROM q""")
register("separator", lambda s, d: table(s, d, "part").select("p_partkey", F.length(x.separator(F.col("p_name"), F.when(F.col("p_size") % 3 == 0, "。").when(F.col("p_size") % 3 == 1, "字").otherwise("word"))).alias("n")),
         "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 1 END AS n FROM part")
register("parse_color", lambda s, d: table(s, d, "part").select("p_partkey", x.parse_color(F.when(F.col("p_partkey") % 3 == 0, F.format_string("#%06X", F.col("p_partkey") * 977 % 16777216)).when(F.col("p_partkey") % 3 == 1, F.concat_ws(";", F.col("p_size"), F.col("p_size") * 2, F.col("p_size") * 6)).otherwise("#abc")).alias("c")).select("p_partkey", "c.r", "c.g", "c.b", x.format_color(F.col("c")).alias("hex"), x.ass_color(F.col("c"), F.lit(40)).alias("ass")),
         """WITH q AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_partkey * 977 % 16777216 // 65536 WHEN 1 THEN p_size ELSE 170 END AS r, CASE p_partkey % 3 WHEN 0 THEN p_partkey * 977 % 65536 // 256 WHEN 1 THEN p_size * 2 ELSE 187 END AS g,
 CASE p_partkey % 3 WHEN 0 THEN p_partkey * 977 % 256 WHEN 1 THEN p_size * 6 ELSE 204 END AS b, p_partkey % 3 = 1 AND p_size * 6 > 255 AS bad FROM part), z AS (SELECT p_partkey, CASE WHEN NOT bad THEN r END AS r, CASE WHEN NOT bad THEN g END AS g, CASE WHEN NOT bad THEN b END AS b FROM q)
 SELECT *, CASE WHEN r IS NULL THEN '' ELSE printf('#%02X%02X%02X', r, g, b) END AS hex, CASE WHEN r IS NOT NULL THEN printf('&H99%02X%02X%02X', b, g, r) END AS ass FROM z""")


# ---- similarity
def _pairs(s, d):
    p = table(s, d, "part").select("p_partkey", F.col("p_name").alias("a"), F.concat(F.reverse(F.left("p_type", F.lit(3))), F.lower("p_type"), F.lit(" "), F.left("p_name", F.lit(7))).alias("b"))
    return p


LCS = """WITH q AS (SELECT p_partkey, p_name AS a, reverse(left(p_type, 3)) || lower(p_type) || ' ' || left(p_name, 7) AS b FROM part),
 l AS (SELECT *, list_last(list_reduce(list_prepend([0 for x in range(length(b) + 1)], [[i] for i in range(1, length(a) + 1)]), lambda row, i: list_reduce(list_prepend([0], [[j] for j in range(1, length(b) + 1)]),
 lambda acc, j: list_append(acc, CASE WHEN substring(a, i[1]::INT, 1) = substring(b, j[1]::INT, 1) THEN row[j[1]] + 1 ELSE greatest(row[j[1] + 1], list_last(acc)) END)))) AS n FROM q),
 r AS (SELECT p_partkey, a, b, 2 * n / (length(a) + length(b)) AS r FROM l)"""
register("text_ratio", lambda s, d: _pairs(s, d).select("p_partkey", F.round(fuzzy.text_ratio(F.col("a"), F.col("b")), 6).alias("r")), LCS + " SELECT p_partkey, round(r, 6) AS r FROM r")
register("similar", lambda s, d: _pairs(s, d).select("p_partkey", fuzzy.similar(F.col("a"), F.col("b"), 0.5).alias("same")), LCS + " SELECT p_partkey, a = b OR r >= 0.5 AS same FROM r")
register("same_caption_version", lambda s, d: table(s, d, "part").select("p_partkey", fuzzy.same_caption_version(F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, F.substring("p_name", 3, 100)).otherwise(F.concat(F.lit("x"), F.substring_index("p_name", " ", 1 ), F.lit(" "), F.substring("p_name", 4, 100))), 0.8).alias("same")),
         "WITH p AS (SELECT p_partkey, p_name AS a, CASE WHEN p_partkey % 3 = 0 THEN p_name[3:] ELSE 'x' || split_part(p_name, ' ', 1) || ' ' || p_name[4:] END AS b FROM part), q AS (SELECT DISTINCT a, b FROM p), " + lcs("q") + """,
 s AS (SELECT p_partkey, a, b, replace(a, ' ', '') AS x, replace(b, ' ', '') AS y FROM p) SELECT p_partkey, a = b OR r >= 0.8::DOUBLE
 OR (least(length(x), length(y)) >= 3 AND 2 * least(length(x), length(y)) >= greatest(length(x), length(y)) AND CASE WHEN length(x) <= length(y) THEN contains(y, x) ELSE contains(x, y) END) AS same FROM s JOIN ratios USING (a, b)""")
register("better_read", lambda s, d: v_cues(s, d).select("doc_id", "idx", fuzzy.better_read(F.col("text"), F.col("value") / 500, F.lit("click"), F.lit(0.1)).alias("better")),
         sql("SELECT doc_id, idx, CASE WHEN abs(value / 500 - 0.1::DOUBLE) > 0.015::DOUBLE THEN value / 500 > 0.1::DOUBLE ELSE length(text) > 5 END AS better FROM v_cues", "v_cues"))


# ---- sources and sinks
def _srt(s, d):
    return sinks.to_srt(v_cues(s, d))


SHOWN = "WITH q AS (SELECT *, CASE WHEN text <> '' THEN text ELSE translation END AS shown, " + m("start_s") + " AS a, " + m("end_s") + " AS b FROM v_cues), r AS (SELECT *, row_number() {ORDER} AS n FROM q WHERE shown <> '')"
register("to_srt", _srt, sql(SHOWN + f" SELECT doc_id, string_agg(n || chr(10) || {clock('a', ',')} || ' --> ' || {clock('b', ',')} || chr(10) || shown || chr(10), chr(10) ORDER BY n) AS value FROM r GROUP BY doc_id", "v_cues"))
register("to_vtt", lambda s, d: sinks.to_vtt(v_cues(s, d)), sql(SHOWN + f" SELECT doc_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({clock('a', '.')} || ' --> ' || {clock('b', '.')} || chr(10) || shown || chr(10), chr(10) ORDER BY n) AS value FROM r GROUP BY doc_id", "v_cues"))
register("to_ass", lambda s, d: sinks.to_ass(v_cues(s, d)).select("doc_id", F.substring_index("value", "Effect, Text\n", -1).alias("events")),
         sql(SHOWN + " SELECT doc_id, string_agg('Dialogue: 0,' || printf('%d:%02d:%02d.%02d', a // 3600000, a % 3600000 // 60000, a % 60000 // 1000, a % 1000 // 10) || ',' || printf('%d:%02d:%02d.%02d', b // 3600000, b % 3600000 // 60000, b % 60000 // 1000, b % 1000 // 10) || ',Default,' || speaker || ',0,0,0,,' || shown, chr(10) ORDER BY n) || chr(10) AS events FROM r GROUP BY doc_id", "v_cues"))
READ = SHOWN + ", z AS (SELECT doc_id, a, b, shown, n, row_number() OVER (PARTITION BY doc_id ORDER BY a, b, n) - 1 AS idx FROM r) SELECT doc_id, idx, a AS start_ms, b AS end_ms, {text} AS text FROM z"
_timed = lambda df: df.select("doc_id", "idx", ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms"), "text")
NO_BRACES = "regexp_replace(shown, '\\{[^}]*\\}', '', 'g')"
register("read_srt", lambda s, d: _timed(subtitles.read_srt(_srt(s, d))[0]), sql(READ.replace("{text}", NO_BRACES), "v_cues"))
register("read_vtt", lambda s, d: _timed(subtitles.read_vtt(sinks.to_vtt(v_cues(s, d)))[0]), sql(READ.replace("{text}", NO_BRACES), "v_cues"))
register("read_ass", lambda s, d: _timed(subtitles.read_ass(sinks.to_ass(v_cues(s, d)))[0]),
         sql(SHOWN + ", y AS (SELECT *, a // 10 * 10 AS aa, b // 10 * 10 AS bb FROM r), z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY aa, bb, n) - 1 AS at FROM y) SELECT doc_id, \"at\" AS idx, aa AS start_ms, bb AS end_ms, ".replace("AS at FROM", 'AS "at" FROM') + NO_BRACES + " AS text FROM z", "v_cues"))
register("read_plain_text", lambda s, d: v_lines(s, d).select("doc_id", "idx", ms("start_s").alias("start_ms"), "text"), sql("SELECT doc_id, idx, idx * 3000 AS start_ms, text FROM v_lines", "v_lines"))


def _mixed(s, d):
    a = _srt(s, d).select(F.concat(F.col("doc_id").cast("string"), F.lit(".srt")).alias("doc_id"), F.concat("value", F.lit("\n\nno time here")).alias("value"))
    b = sinks.to_vtt(v_cues(s, d)).select(F.concat(F.col("doc_id").cast("string"), F.lit(".vtt")).alias("doc_id"), "value")
    return a.unionByName(b)


register("read_subtitles", lambda s, d: subtitles.read_subtitles(_mixed(s, d))[0].groupBy("doc_id").agg(F.count("*").alias("cues")),
         sql(SHOWN + " SELECT doc_id || e AS doc_id, count(*) AS cues FROM r, (SELECT unnest(['.srt', '.vtt']) AS e) GROUP BY ALL", "v_cues"))
register("rejects", lambda s, d: subtitles.read_subtitles(_mixed(s, d))[1].select("doc_id", F.col("unit_no").cast("long").alias("unit_no"), "message"),
         sql(SHOWN + " SELECT doc_id || '.srt' AS doc_id, count(*) + 1 AS unit_no, 'no time line' AS message FROM r GROUP BY doc_id", "v_cues"))


def _manifest(s, d):
    p = v_cues(s, d).groupBy("doc_id").agg(F.max("end_s").alias("duration_s")).select("doc_id", F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("name"), "duration_s", F.lit("en").alias("language"), F.lit("vi").alias("target_language"))
    return sinks.export_manifest(p, v_cues(s, d))


register("export_manifest", _manifest,
         sql("""SELECT doc_id, '{"name":"p' || doc_id || '","duration":' || round_even(max(end_s) * 1000, 0) / 1000 || ',"language":"en","target_language":"vi","cues":[' || string_agg(
 '{"start":' || round_even(start_s * 1000, 0) / 1000 || ',"end":' || round_even(end_s * 1000, 0) / 1000 || ',"text":' || to_json(text) || ',"translation":' || to_json(translation) || ',"speaker":"' || speaker || '"}', ',' ORDER BY idx)
 || ']}' AS value FROM v_cues GROUP BY doc_id""", "v_cues"))
register("read_project_json", lambda s, d: cues_out(subtitles.read_project_json(_manifest(s, d))[1]), sql("SELECT {CUES} FROM v_cues", "v_cues"))
register("to_timeline_json", lambda s, d: sinks.timeline_segments(v_cues(s, d)).select("doc_id", "idx", "text", F.col("start_us").alias("start_us"), "duration_us", "render_index", F.col("style_end").cast("long").alias("style_end")),
         sql("""WITH q AS (SELECT *, CASE WHEN translation <> '' THEN translation ELSE text END AS shown FROM v_cues) SELECT doc_id, idx, shown AS text, CAST(round_even(start_s * 1e6, 0) AS BIGINT) AS start_us, greatest(1, CAST(round_even((end_s - start_s) * 1e6, 0) AS BIGINT)) AS duration_us,
 idx AS render_index, length(shown) AS style_end FROM q WHERE shown <> '' AND end_s > start_s""", "v_cues"))


def _cache(s, d, part):
    return v_cues(s, d).where(part).select(F.col("doc_id").alias("cache_key"), (F.col("idx") % 20).alias("frame_idx"), F.col("event_id").alias("version"), "text")


register("upsert_frame_cache", lambda s, d: sinks.upsert_frame_cache(_cache(s, d, "idx % 2 = 0"), _cache(s, d, "idx % 2 = 1")),
         sql("SELECT doc_id AS cache_key, idx % 20 AS frame_idx, event_id AS version, text FROM v_cues QUALIFY row_number() OVER (PARTITION BY doc_id, idx % 20 ORDER BY event_id DESC) = 1", "v_cues"))


def _asked(s, d):
    """Few stems in few folders, some with numbers, decomposed letters and odd characters; some names are remembered."""
    p = table(s, d, "part")
    word = F.concat(F.substring_index("p_name", " ", 1), F.when(F.col("p_partkey") % 3 == 0, "e\u0301 ?").otherwise(""))
    number = F.when(F.col("p_partkey") % 4 == 0, "_1").when(F.col("p_partkey") % 11 == 0, "_2").when(F.col("p_partkey") % 13 == 0, "_1_1").otherwise("")
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 5).alias("folder"), F.concat(F.lit(" "), word, number, F.lit(". ")).alias("name"),
                    F.when(F.col("p_partkey") % 17 == 0, F.concat(F.substring_index("p_name", " ", 1), F.lit("_3"))).alias("remembered"))


def _taken(s, d):
    p = table(s, d, "part").where("p_partkey % 7 = 0")
    return p.select((F.col("p_size") % 5).alias("folder"), F.concat(F.substring_index("p_name", " ", 1), F.when(F.col("p_partkey") % 2 == 0, "_2").otherwise("")).alias("stem"))


ASKED = """WITH RECURSIVE p AS (SELECT p_partkey AS id, p_size % 5 AS folder, split_part(p_name, ' ', 1) AS word FROM part),
 q AS (SELECT id, folder, word || CASE WHEN id % 3 = 0 THEN '\u00e9 _' ELSE '' END || CASE WHEN id % 4 = 0 THEN '_1' WHEN id % 11 = 0 THEN '_2' WHEN id % 13 = 0 THEN '_1_1' ELSE '' END AS stem, CASE WHEN id % 17 = 0 THEN word || '_3' END AS remembered FROM p),
 taken AS (SELECT folder, word || CASE WHEN id % 2 = 0 THEN '_2' ELSE '' END AS stem FROM p WHERE id % 7 = 0 UNION SELECT folder, remembered FROM q WHERE remembered IS NOT NULL),
 t AS (SELECT folder, list(stem) AS names FROM taken GROUP BY folder), r AS MATERIALIZED (SELECT q.id, q.folder, stem, row_number() OVER (PARTITION BY q.folder ORDER BY q.id) AS k FROM q WHERE remembered IS NULL),
 f AS (SELECT folder, 0::BIGINT AS k, coalesce(names, []) AS names, NULL::BIGINT AS id, NULL::VARCHAR AS file_name FROM (SELECT DISTINCT folder FROM r) LEFT JOIN t USING (folder)
 UNION ALL SELECT f.folder, r.k, list_append(names, n), r.id, n FROM f JOIN r ON r.folder = f.folder AND r.k = f.k + 1,
 LATERAL (SELECT CASE WHEN NOT list_contains(f.names, r.stem) THEN r.stem ELSE r.stem || '_' || list_min(list_filter(range(1, len(f.names) + 2), lambda i: NOT list_contains(f.names, r.stem || '_' || i))) END AS n))
 SELECT id, folder, file_name FROM f WHERE k > 0 UNION ALL SELECT id, folder, remembered FROM q WHERE remembered IS NOT NULL"""
register("output_names", lambda s, d: sinks.output_names(_asked(s, d), _taken(s, d)), ASKED)


def _stored_cache(s, d):
    """A cache that is written, upserted twice on storage, and read again."""
    rows = v_cues(s, d).select(F.col("doc_id").cast("string").alias("cache_key"), (F.col("idx") % 20).alias("frame_idx"), F.col("event_id").alias("version"), F.to_json(F.array(F.struct("text"))).alias("rows_json"), "doc_id", "idx")
    folder = streams.shared_folder(s, "frame-cache")
    for n, part in enumerate(("idx % 3 = 0", "idx % 3 = 1 and doc_id % 2 = 0", "idx % 3 = 2 and doc_id % 5 > 0")):
        sinks.save_frame_cache(f"{folder}/cache", rows.where(part), f"{folder}/staging-{n}")
    return audit.whole_frame_cache(s, f"{folder}/cache")


register("save_frame_cache", lambda s, d: _stored_cache(s, d).select("cache_key", "frame_idx", "version", F.get(F.from_json("rows_json", "array<struct<text string>>"), F.lit(0))["text"].alias("text")),
         sql("SELECT doc_id::VARCHAR AS cache_key, idx % 20 AS frame_idx, event_id AS version, text FROM v_cues WHERE idx % 3 = 0 OR idx % 3 = 1 AND doc_id % 2 = 0 OR idx % 3 = 2 AND doc_id % 5 > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, idx % 20 ORDER BY event_id DESC) = 1", "v_cues"))
register("read_glossary", lambda s, d: subtitles.read_glossary(table(s, d, "customer").groupBy(F.col("c_nationkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_mktsegment"))), lambda r: F.concat(r["c_mktsegment"], F.lit("="), r["c_custkey"].cast("string"))), "\n").alias("value"))).select("doc_id", F.col("pos").cast("long").alias("pos"), "src", "dst"),
         "WITH q AS (SELECT c_nationkey AS doc_id, c_mktsegment AS src, c_custkey::VARCHAR AS dst, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos FROM customer) SELECT doc_id, min(pos) AS pos, src, arg_max(dst, pos) AS dst FROM q GROUP BY doc_id, src")

# ---- configurations and audits
register("list_configs", lambda s, d: audit.list_configs(v_configs(s, d)), "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 5 <> 0")
register("read_config_cues", lambda s, d: cues_out(audit.read_config_cues(v_configs(s, d))),
         """SELECT c_custkey AS doc_id, 0::BIGINT AS idx, 1000::BIGINT AS start_ms, 2500::BIGINT AS end_ms, c_name AS text, c_mktsegment AS translation, 'A' AS speaker FROM customer
 UNION ALL SELECT c_custkey, 1, c_custkey % 60 * 1000 + 250, 30000, c_mktsegment, '', 'B' FROM customer WHERE c_custkey % 60 < 30""")
register("config_pick_first", lambda s, d: audit.config_pick_first(v_configs(s, d)).select("id", "name"), "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN c_name || ' (NOT USED)' ELSE c_name END AS name FROM customer ORDER BY c_custkey LIMIT 1")
register("setting_index", lambda s, d: audit.setting_index(v_configs(s, d)),
         """WITH q AS (SELECT c_custkey AS id, unnest([{'k': 'video_file', 'v': c_name}, {'k': 'segment', 'v': c_mktsegment}, {'k': 'api_token', 'v': '<redacted>'}, {'k': 'data_table', 'v': '<table>'}]) AS s FROM customer),
 f AS (SELECT s.k AS key, s.v AS v, min(id) AS first FROM q GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY first, v) AS n FROM f)
 SELECT key, (SELECT count(*) FROM customer) AS configs, string_agg(v, '|' ORDER BY n) AS samples FROM t WHERE n <= 3 GROUP BY key""")
register("redact_config", lambda s, d: v_configs(s, d).select("id", audit.redact_config(F.col("value")).alias("value")),
         """SELECT c_custkey AS id, '{"api_token": "<redacted>", "data_table": {"columns": 5, "rows": 2}, "segment": "' || c_mktsegment || '", "video_file": "' || c_name || '"}' AS value FROM customer""")


def _settings(s, d):
    c = table(s, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.to_json(F.struct(F.col("c_nationkey").alias("thread_ocr_v2"), (F.col("c_custkey") % 100).alias("frame_size_ocr_v2"), (F.col("c_nationkey") / 10).alias("dau_cham"), (F.col("c_nationkey") % 2 == 0).alias("use_gpu"), F.lit("slow").alias("he_so_preset"),
                                                                       F.concat((F.col("c_nationkey") + 20).cast("string"), F.lit("px")).alias("font_size"), F.lit("1920|1080").alias("chat_luong_video"), F.when(F.col("c_nationkey") % 3 == 0, "translation").alias("sub_long_tieng"))).alias("value"))


register("map_global_config", lambda s, d: audit.map_global_config(_settings(s, d)).select("id", "max_workers", "ocr_batch_size", "ocr_confidence", "tts_pause_period_ms", "tts_pause_comma_ms", "render_preset", "render_fps", "use_gpu", "smart_cut"),
         """SELECT c_custkey AS id, least(8, greatest(1, coalesce(nullif(c_nationkey, 0), 2))) AS max_workers, least(64, coalesce(nullif(c_custkey % 100, 0), 5)) AS ocr_batch_size, 70.0::DOUBLE AS ocr_confidence, CAST(trunc(c_nationkey / 10 * 1000) AS INT) AS tts_pause_period_ms,
 200 AS tts_pause_comma_ms, 'slow' AS render_preset, '30' AS render_fps, c_nationkey % 2 = 0 AS use_gpu, false AS smart_cut FROM customer""")
register("map_project_config", lambda s, d: audit.map_project_config(_settings(s, d)).select("id", "tts_end_pause_ms", "dub_source", "render_scale", "font_size", "bold"),
         "SELECT c_custkey AS id, 250 AS tts_end_pause_ms, CASE WHEN c_nationkey % 3 = 0 THEN 'translation' ELSE 'original' END AS dub_source, '1920x1080' AS render_scale, c_nationkey + 20 AS font_size, true AS bold FROM customer")


def _frames(s, d):
    box = F.struct(F.array(F.col("value"), F.col("start_s")).alias("order"), "text", (F.col("value") / 500).alias("score"), F.array("value", "value").alias("rect"))
    return v_cues(s, d).select((F.col("doc_id") % 3).cast("string").alias("cache_key"), F.col("event_id").alias("frame_idx"), F.when(F.col("idx") % 5 == 0, "{bad").otherwise(F.to_json(F.array(box))).alias("rows_json"))


register("read_frame_cache", lambda s, d: audit.read_frame_cache(_frames(s, d), "1", 1 << 40).select("frame_idx", F.get("boxes", F.lit(0))["text"].alias("text")), sql("SELECT event_id AS frame_idx, text FROM v_cues WHERE doc_id % 3 = 1 AND idx % 5 <> 0", "v_cues"))


def _probe(s, d):
    stream = lambda kind, name, w, h, r: F.struct(F.lit(kind).alias("codec_type"), F.lit(name).alias("codec_name"), w.alias("width"), h.alias("height"), r.alias("r_frame_rate"))
    none = F.lit(None).cast("int")
    return table(s, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.to_json(F.struct(
        F.struct(F.when(F.col("p_size") % 4 == 0, "N/A").otherwise(F.col("p_retailprice").cast("string")).alias("duration"), F.col("p_partkey").cast("string").alias("size")).alias("format"),
        F.array(stream("audio", "aac", none, none, F.lit("0/0")), stream("video", "h264", F.col("p_size") * 10, F.col("p_size") * 5, F.lit("30000/1001")), stream("video", "png", F.col("p_size"), F.col("p_size"), F.lit("1/1"))).alias("streams"))).alias("value"))


register("parse_media_probe", lambda s, d: audit.parse_media_probe(_probe(s, d)).select("path", ms("duration_s").alias("duration_ms"), "width", "height", F.round("fps", 6).alias("fps"), "has_video", "has_audio", "video_codec", "audio_codec", "size_bytes"),
         f"SELECT p_partkey::VARCHAR AS path, CASE WHEN p_size % 4 = 0 THEN 0 ELSE {m('p_retailprice')} END AS duration_ms, p_size * 10 AS width, p_size * 5 AS height, round(30000 / 1001, 6) AS fps, true AS has_video, true AS has_audio, 'h264' AS video_codec, 'aac' AS audio_codec, p_partkey AS size_bytes FROM part")
register("parse_frame_log", lambda s, d: audit.parse_frame_log(v_cues(s, d).where("doc_id % 2 = 0 or idx % 3 > 0").select(F.col("doc_id").alias("video_id"), F.col("idx").alias("line_no"), F.concat(F.lit("[showinfo] n:1 pts_time: "), F.col("value").cast("string"), F.lit(" x")).alias("line")),
                                                           v_cues(s, d).groupBy(F.col("doc_id").alias("video_id")).agg(F.count("*").alias("frames")), 0.5).select("video_id", F.col("frame_idx").cast("long").alias("frame_idx"), ms("stamp_s").alias("stamp_ms")),
         sql(f"SELECT doc_id AS video_id, idx AS frame_idx, CASE WHEN doc_id % 2 = 0 OR count(*) FILTER (idx % 3 = 0) OVER (PARTITION BY doc_id) = 0 THEN {m('value')} ELSE {m('idx * 0.5')} END AS stamp_ms FROM v_cues", "v_cues"))


def _wavs(s, d):
    le = lambda c, n: F.unhex(F.concat(*[F.substring(F.lpad(F.hex(c), 2 * n, "0"), 2 * n - 2 * k - 1, 2) for k in range(n)]))
    wide = F.col("p_partkey") % 5 == 0  # the extensible format
    odd = F.col("p_partkey") % 2 == 0
    other = lambda name, size: F.concat(F.unhex(F.lit(name)), le(size.cast("long"), 4), F.unhex(F.repeat(F.lit("00"), (size + size % 2).cast("int"))))
    head = F.concat(F.unhex(F.lit("52494646")), le(F.col("p_partkey"), 4), F.unhex(F.lit("57415645")), F.when(odd, other("62657874", F.col("p_size"))).otherwise(F.unhex(F.lit(""))), F.unhex(F.lit("666D7420")), le(F.when(wide, 40).otherwise(16).cast("long"), 4),
                    F.unhex(F.when(wide, "FEFF").otherwise("0100")), le(F.lit(1).cast("long"), 2), le((F.col("p_size") % 3 * 8000 + 8000).cast("long"), 4), F.unhex(F.lit("00000000")), F.unhex(F.lit("0200")), F.unhex(F.lit("1000")),
                    F.unhex(F.when(wide, "1600100004000000" + "0100000000001000800000AA00389B71").otherwise("")), F.when(F.col("p_partkey") % 3 == 0, other("4C495354", F.col("p_size") + 1)).otherwise(F.unhex(F.lit(""))),
                    F.unhex(F.lit("64617461")), le((F.col("p_partkey") * 1000).cast("long"), 4))
    return table(s, d, "part").select(F.col("p_partkey").cast("string").alias("path"), F.when(F.col("p_partkey") % 7 == 0, F.unhex(F.lit("00"))).otherwise(head).alias("content"))


WAV = "SELECT p_partkey::VARCHAR AS path, p_partkey % 7 <> 0 AS ok, p_size % 3 * 8000 + 8000 AS rate, p_partkey * 500 AS frames FROM part"
register("read_wav_headers", lambda s, d: audit.read_wav_headers(_wavs(s, d)).select("path", "frames", ms("seconds").alias("ms"), "label"),
         f"SELECT path, CASE WHEN ok THEN frames ELSE 0 END AS frames, CASE WHEN ok THEN {m('(frames / rate)')} ELSE 0 END AS ms, CASE WHEN ok THEN rate || 'Hz/1ch/16bit' ELSE 'unreadable' END AS label FROM ({WAV})")
register("wav_summary", lambda s, d: audit.wav_summary(audit.read_wav_headers(_wavs(s, d))).select("label", "files", ms("shortest_s").alias("shortest_ms"), ms("longest_s").alias("longest_ms")),
         f"SELECT CASE WHEN ok THEN rate || 'Hz/1ch/16bit' ELSE 'unreadable' END AS label, count(*) AS files, {m('min(CASE WHEN ok THEN frames / rate ELSE 0 END)')} AS shortest_ms, {m('max(CASE WHEN ok THEN frames / rate ELSE 0 END)')} AS longest_ms FROM ({WAV}) GROUP BY ALL")
register("padded_length", lambda s, d: v_cues(s, d).select("doc_id", "idx", ms(audit.padded_length(F.floor("value"), F.lit(16000), F.col("value") / 20 - 1)).alias("ms")),
         sql(f"SELECT doc_id, idx, {m('(floor(value) + round_even(greatest(0, least(5, value / 20 - 1)) * 16000, 0) / 16000)')} AS ms FROM v_cues", "v_cues"))
register("sample_stamps", lambda s, d: v_cues(s, d).select("doc_id", "idx", F.explode(audit.sample_stamps(F.when(F.col("idx") % 5 == 0, 0.0).otherwise(F.col("value")), 5)).alias("t")).select("doc_id", "idx", F.round("t", 6).alias("t")),
         sql("WITH q AS (SELECT doc_id, idx, CASE WHEN idx % 5 = 0 OR value <= 0 THEN 60.0::DOUBLE ELSE value END AS w FROM v_cues), r AS (SELECT *, least(2.0::DOUBLE, w * 0.05::DOUBLE) AS k FROM q) SELECT doc_id, idx, round(k + greatest(0.0::DOUBLE, w - 2 * k) * i / 4, 6) AS t FROM r, range(5) g(i)", "v_cues"))
register("extension_counts", lambda s, d: audit.extension_counts(table(s, d, "part").select(F.concat(F.lit("/a/"), F.regexp_replace("p_type", " .*", ""), F.lit("/"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, ".SRT").otherwise(".tar.gz")).alias("path"))),
         "SELECT regexp_replace(p_type, ' .*', '') || ':' || CASE p_size % 3 WHEN 0 THEN '[none]' WHEN 1 THEN '.srt' ELSE '.gz' END AS label, count(*) AS files FROM part GROUP BY ALL")
register("schema_variants", lambda s, d: audit.schema_variants(table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("database"), F.explode(F.array(F.lit("id"), F.concat(F.lit("c"), (F.col("c_nationkey") % 4).cast("string")))).alias("column")).withColumns({"table": F.lit("t"), "type": F.lit("INT")})).select("databases", "example"),
         "SELECT count(*) AS databases, min(c_custkey::VARCHAR) AS example FROM customer GROUP BY c_nationkey % 4")
register("segment_bounds", lambda s, d: v_cues(s, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.col("text").alias("word"), "start_s", "end_s"))).alias("w")).select("doc_id", audit.segment_bounds(F.col("w"), F.lit(0.0), F.lit(1.0)).alias("b")).select("doc_id", ms("b.start_s").alias("start_ms"), ms("b.end_s").alias("end_ms")),
         sql(f"SELECT doc_id, {m('min(start_s)')} AS start_ms, {m('greatest(arg_max(end_s, idx), min(start_s) + 0.05)')} AS end_ms FROM v_cues WHERE text <> '' GROUP BY doc_id", "v_cues"))


def _segments(s, d):
    return v_cues(s, d).select("doc_id", F.col("idx").alias("pos"), "text", "start_s", "end_s", F.array(F.struct(F.lit("w").alias("word"), (F.col("start_s") + 0.25).alias("start_s"), F.when(F.col("idx") % 3 > 0, F.col("end_s")).alias("end_s"))).alias("words"))


register("read_asr_segments", lambda s, d: audit.read_asr_segments(_segments(s, d)).select("doc_id", "idx", ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms"), "text"),
         sql(f"WITH q AS (SELECT doc_id, row_number() {{ORDER}} - 1 AS n, text, CASE WHEN idx % 3 > 0 THEN start_s + 0.25 ELSE start_s END AS a, end_s FROM v_cues WHERE text <> '') SELECT doc_id, n AS idx, {m('a')} AS start_ms, {m('greatest(end_s, a + 0.05::DOUBLE)')} AS end_ms, text FROM q", "v_cues"))


def _series(s, d):
    """Every cue as a segment of its document's track; the track ends with the last one's half."""
    segments = v_cues(s, d).select(F.col("doc_id").alias("track_id"), F.col("idx").alias("seg"), (F.col("idx") * 0.5).alias("start_s"), F.lit(10).alias("rate"), F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: (F.col("event_id") * 37 % 40000 - 12000 + k * 100).cast("int")).alias("samples"))
    return segments, segments.groupBy("track_id").agg((F.max("start_s") + 0.6).alias("total_s"))


TRACK = """WITH q AS (SELECT doc_id AS track_id, idx AS seg, idx * 5 + k AS pos, event_id * 37 % 40000 - 12000 + k * 100 AS v FROM v_cues, range(12) r(k)),
 n AS (SELECT doc_id AS track_id, max(idx) * 5 + 6 AS n FROM v_cues GROUP BY doc_id), z AS (SELECT q.* FROM q JOIN n USING (track_id) WHERE pos < n)"""
register("overlay_series", lambda s, d: audit.overlay_series(*_series(s, d)), sql(TRACK + " SELECT track_id, pos, CAST(arg_max(v, seg) AS INT) AS v FROM z GROUP BY ALL", "v_cues"))
register("overlay_series_mix", lambda s, d: audit.overlay_series(*_series(s, d), mix=True),
         sql(TRACK + ", l AS (SELECT track_id, pos, list_prepend(0::BIGINT, list(v ORDER BY seg)) AS vs FROM z GROUP BY ALL) SELECT track_id, pos, CAST(list_reduce(vs, lambda a, b: greatest(-32768, least(32767, a + b))) AS INT) AS v FROM l", "v_cues"))


def _voices(s, d):
    """A voice for each part, of the pitch that its size gives; the sine of each of the 50 sizes is made once, and then judged for every part."""
    p = table(s, d, "part").select("p_partkey", "p_size")
    wave = F.transform(F.sequence(F.lit(0), F.lit(7999)), lambda k: (F.sin(k * 2 * 3.141592653589793 * (F.col("p_size") * 4 + 80) / 16000) * 9000).cast("int"))
    return spread(p, "p_partkey").join(F.broadcast(p.select("p_size").distinct().withColumn("wave", wave)), "p_size")


register("estimate_pitch", lambda s, d: _voices(s, d).select("p_partkey", F.round(audit.estimate_pitch("wave", F.lit(16000)), 6).alias("pitch")),
         """WITH w AS (SELECT p_size, k, trunc(sin(k * 2 * 3.141592653589793::DOUBLE * (p_size * 4 + 80) / 16000) * 9000) AS v FROM (SELECT DISTINCT p_size FROM part), range(8000) r(k)),
 c AS MATERIALIZED (SELECT p_size, list(v ORDER BY k) AS v FROM (SELECT p_size, k, v - avg(v) OVER (PARTITION BY p_size) AS v FROM w) GROUP BY p_size),
 a AS (SELECT p_size, lag, list_inner_product(v[1:8000 - lag], v[lag + 1:8000]) AS power FROM c, range(45, 228) l(lag)),
 b AS (SELECT p_size, lag FROM a QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY power DESC, lag) = 1)
 SELECT p_partkey, CASE WHEN 16000 / lag BETWEEN 70 AND 350 THEN round(16000 / lag, 6) ELSE 0 END AS pitch FROM part JOIN b USING (p_size)""")

# ---- regions
register("clamp_region", lambda s, d: table(s, d, "part").select("p_partkey", geo.clamp_region(F.col("p_partkey") - 50, F.col("p_size") * 40, F.col("p_size") * 3, F.lit(10), F.lit(640), F.lit(480)).alias("r")).select("p_partkey", "r.*"),
         """WITH q AS (SELECT p_partkey, greatest(24, least(p_size * 3, 640)) AS w, 24 AS h, p_size FROM part) SELECT p_partkey, greatest(0, least(p_partkey - 50, 640 - w)) AS x, greatest(0, least(p_size * 40, 480 - h)) AS y, w, h FROM q""")
register("scale_region", lambda s, d: table(s, d, "part").select("p_partkey", geo.scale_region(
    F.when(F.col("p_partkey") % 3 > 0, F.struct((F.col("p_size") * 4).alias("x"), (F.col("p_size") * 9).alias("y"), (F.col("p_size") * 20).alias("w"), (F.col("p_size") * 2).alias("h"))), F.lit(1920), F.lit(1080), F.col("p_size") * 40, F.lit(720)).alias("r")).select("p_partkey", "r.*"),
         """WITH q AS (SELECT p_partkey, p_size * 40 AS wide, p_partkey % 3 > 0 AS known, p_size AS z FROM part),
 s AS (SELECT p_partkey, wide, CASE WHEN known THEN round_even(z * 4 * wide / 1920.0::DOUBLE, 0) ELSE round_even(wide * 0.05::DOUBLE, 0) END AS x, CASE WHEN known THEN round_even(z * 9 * 720 / 1080.0::DOUBLE, 0) ELSE 504 END AS y,
 CASE WHEN known THEN round_even(z * 20 * wide / 1920.0::DOUBLE, 0) ELSE round_even(wide * 0.9::DOUBLE, 0) END AS w, CASE WHEN known THEN round_even(z * 2 * 720 / 1080.0::DOUBLE, 0) ELSE round_even(720 * 0.28::DOUBLE, 0) END AS h FROM q),
 c AS (SELECT p_partkey, x, y, wide, greatest(24, least(w, wide)) AS w, greatest(24, least(h, 720)) AS h FROM s)
 SELECT p_partkey, CAST(greatest(0, least(x, wide - w)) AS INT) AS x, CAST(greatest(0, least(y, 720 - h)) AS INT) AS y, CAST(w AS INT) AS w, CAST(h AS INT) AS h FROM c""")
register("color_name", lambda s, d: table(s, d, "part").select("p_partkey", x.color_name(F.when(F.col("p_partkey") % 50 > 0, F.struct((F.col("p_partkey") * 37 % 256).alias("r"), (F.col("p_partkey") * 101 % 256).alias("g"), (F.col("p_partkey") * 7 % 256).alias("b")))).alias("name")),
         """WITH q AS (SELECT p_partkey, p_partkey * 37 % 256 AS r, p_partkey * 101 % 256 AS g, p_partkey * 7 % 256 AS b FROM part)
 SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN 'chua ro' WHEN greatest(r, g, b) - least(r, g, b) <= 32 THEN CASE WHEN greatest(r, g, b) >= 200 THEN 'trang' WHEN greatest(r, g, b) <= 60 THEN 'den' ELSE 'xam' END
 WHEN r >= 180 AND g >= 150 AND b <= 120 THEN 'vang' WHEN r >= 150 AND g <= 120 AND b <= 120 THEN 'do' WHEN g >= 150 AND r <= 140 THEN 'xanh la' WHEN b >= 150 AND r <= 150 THEN 'xanh duong' WHEN r >= 150 AND b >= 150 THEN 'tim' ELSE 'mau khac' END AS name FROM q""")
register("parse_region", lambda s, d: table(s, d, "part").select("p_partkey", geo.parse_region(F.concat(F.lit("["), F.concat_ws(", ", F.col("p_size"), F.col("p_partkey"), F.col("p_size") % 5, F.lit(9)), F.lit("]"))).alias("r")).select("p_partkey", "r.*"),
         "SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN p_size END AS x, CASE WHEN p_size % 5 > 0 THEN p_partkey END AS y, CASE WHEN p_size % 5 > 0 THEN p_size % 5 END AS w, CASE WHEN p_size % 5 > 0 THEN 9 END AS h FROM part")
register("default_region", lambda s, d: table(s, d, "part").select("p_partkey", geo.default_region(F.col("p_size") * 30, F.col("p_size") * 20).alias("r")).select("p_partkey", "r.*"),
         "SELECT p_partkey, CAST(round_even(p_size * 30 * 0.1::DOUBLE, 0) AS INT) AS x, CAST(round_even(p_size * 20 * 0.74::DOUBLE, 0) AS INT) AS y, CAST(round_even(p_size * 30 * 0.8::DOUBLE, 0) AS INT) AS w, CAST(round_even(p_size * 20 * 0.2::DOUBLE, 0) AS INT) AS h FROM part")

register("decode_text", lambda s, d: table(s, d, "documents").select("doc_id", decoding.decode_text(F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))).alias("text")),
         "SELECT doc_id, text FROM documents")
