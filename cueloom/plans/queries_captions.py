"""Queries on boxes, frame reads, captions and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.text import CJK
from ..operators import captions as cp, joins as j, segments as sg
from .registry import MS, cues_out, lcs, ms, register, sql
from ..sources import sinks, subtitles as sub
from ..streaming import captions as st, run as streams
from .queries_text import RESEGMENT
from .relations import SAID, SAID_SQL, table, v_boxes, v_cues, v_lines, v_noisy, v_reads


def m(e: str) -> str:
    return MS.format(e)


def _frame_boxes(s, d):
    return v_boxes(s, d).groupBy("frame").agg(F.array_sort(F.collect_list(F.struct(F.col("box").alias("n"), "text", "score", "rect"))).alias("boxes"))


register("filter_detections", lambda s, d: cp.filter_detections(v_boxes(s, d).withColumn("score", F.when(F.col("box") % 5 > 0, F.col("score")))).select("frame", "box", "text"),
         sql("SELECT frame, box, text FROM v_boxes WHERE box % 5 = 0 OR score >= 0.7::DOUBLE", "v_boxes"))
register("filter_height_fill", lambda s, d: cp.filter_height_fill(v_boxes(s, d).withColumns({"height": F.col("rect.y2") - F.col("rect.y1"), "fill": F.col("rect.x1") / 900}), 32, 0).select("frame", "box"),
         sql("SELECT frame, box FROM v_boxes WHERE y2 - y1 >= 32 AND x1 / 900 BETWEEN 0.008::DOUBLE AND 0.92::DOUBLE", "v_boxes"))
register("filter_color", lambda s, d: cp.filter_color(table(s, d, "part").select("p_partkey", (F.col("p_size") * 5).alias("r"), (F.col("p_partkey") % 256).alias("g"), F.lit(200).alias("b")), (250, 240, 210), 30.0).select("p_partkey"),
         "SELECT p_partkey FROM part WHERE sqrt((p_size * 5 - 250) ** 2 + (p_partkey % 256 - 240) ** 2 + 100) <= 0.3::DOUBLE * sqrt(3 * 255.0::DOUBLE ** 2)")
register("box_geometry", lambda s, d: v_boxes(s, d).withColumn("poly", F.array(F.array("rect.x2", "rect.y1"), F.array("rect.x1", "rect.y2"))).select("frame", "box", geo.area(geo.bbox(F.col("poly"))).alias("area"), geo.box_order(F.col("poly"))["y"].alias("y"), geo.box_order(F.col("poly"))["x"].alias("x")),
         sql("SELECT frame, box, (x2 - x1) * (y2 - y1) AS area, y1 AS y, x1 AS x FROM v_boxes", "v_boxes"))


def _box_pairs(s, d):
    a = v_boxes(s, d).select("frame", F.col("box").alias("a"), F.col("rect").alias("ra"))
    b = v_boxes(s, d).select("frame", F.col("box").alias("b"), F.col("rect").alias("rb"))
    return a.join(b, "frame").where("a < b")


PAIR = "WITH p AS (SELECT x.frame, x.box AS a, y.box AS b, greatest(0, least(x.x2, y.x2) - greatest(x.x1, y.x1)) AS ox, least(x.y2, y.y2) - greatest(x.y1, y.y1) AS oy, (x.x2 - x.x1) * (x.y2 - x.y1) AS area, least(x.y2 - x.y1, y.y2 - y.y1) AS low FROM v_boxes x JOIN v_boxes y ON x.frame = y.frame AND x.box < y.box)"
register("covered", lambda s, d: _box_pairs(s, d).select("frame", "a", "b", F.round(geo.covered(F.col("ra"), F.col("rb")), 6).alias("share")), sql(PAIR + " SELECT frame, a, b, round(ox * greatest(0, oy) / area, 6) AS share FROM p", "v_boxes"))
register("same_line", lambda s, d: _box_pairs(s, d).select("frame", "a", "b", geo.same_line(F.col("ra"), F.col("rb")).alias("same"), geo.overlap_x(F.col("ra"), F.col("rb")).alias("overlap")), sql(PAIR + " SELECT frame, a, b, low > 0 AND oy > 0.5 * low AS same, ox AS overlap FROM p", "v_boxes"))
APART = """WITH o AS (SELECT *, (x2 - x1) * (y2 - y1) AS area, row_number() OVER (PARTITION BY frame ORDER BY (x2 - x1) * (y2 - y1) DESC, box) AS k FROM v_boxes), l AS (SELECT frame, list({'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'box': box, 'area': area} ORDER BY k) AS bs FROM o GROUP BY frame),
 f AS (SELECT frame, bs, 2 AS k, [bs[1]] AS kept FROM l UNION ALL SELECT frame, bs, k + 1, CASE WHEN len(list_filter(kept, lambda g: greatest(0, least(g.x2, bs[k].x2) - greatest(g.x1, bs[k].x1)) * greatest(0, least(g.y2, bs[k].y2) - greatest(g.y1, bs[k].y1)) / bs[k].area >= 0.7::DOUBLE)) > 0 THEN kept ELSE list_append(kept, bs[k]) END FROM f WHERE k <= len(bs))
 SELECT frame, unnest(kept).box AS box FROM f WHERE k = len(bs) + 1"""
register("drop_overlaps", lambda s, d: _frame_boxes(s, d).select("frame", F.explode(cp.drop_overlaps(F.col("boxes"))).alias("b")).select("frame", F.col("b.n").alias("box")),
         sql(APART, "v_boxes", recursive=True))
def _said_boxes(s, d):
    """Frames' boxes that say something in two scripts, some ending in a dash."""
    n = F.col("box") % 4
    said = F.when(n == 0, F.concat(F.lit("字幕"), "text")).when(n == 1, F.concat("text", F.lit(" -"))).when(n == 2, F.lower("text")).otherwise(F.col("text"))
    return v_boxes(s, d).withColumn("text", said).groupBy("frame").agg(F.array_sort(F.collect_list(F.struct(F.col("box").alias("n"), "text", "score", "rect"))).alias("boxes"))


READ = """WITH o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY y1, x1, box) AS k FROM v_boxes),
 f AS (SELECT frame, 0::BIGINT AS k, []::STRUCT(y1 DOUBLE, y2 DOUBLE, n BIGINT)[] AS heads, NULL::STRUCT(y1 DOUBLE, y2 DOUBLE, n BIGINT) AS head, NULL::BIGINT AS box, NULL::DOUBLE AS x1 FROM (SELECT DISTINCT frame FROM o)
 UNION ALL SELECT o.frame, o.k, CASE WHEN hit IS NULL THEN list_append(f.heads, {'y1': o.y1, 'y2': o.y2, 'n': o.box}) ELSE f.heads END, coalesce(f.heads[hit], {'y1': o.y1, 'y2': o.y2, 'n': o.box}), o.box, o.x1 FROM f JOIN o ON o.frame = f.frame AND o.k = f.k + 1,
 LATERAL (SELECT list_position(list_transform(f.heads, lambda h: least(h.y2 - h.y1, o.y2 - o.y1) > 0 AND least(h.y2, o.y2) - greatest(h.y1, o.y1) > 0.5::DOUBLE * least(h.y2 - h.y1, o.y2 - o.y1)), true) AS hit)),
 r AS MATERIALIZED (SELECT frame, box, head.y1 AS line, row_number() OVER (PARTITION BY frame ORDER BY head.y1, head.n, x1, box) AS k FROM f WHERE k > 0)"""
register("reading_order", lambda s, d: _frame_boxes(s, d).select("frame", F.posexplode(cp.reading_order(F.col("boxes"))).alias("at", "b")).select("frame", F.col("at").cast("long").alias("place"), F.col("b.b.n").alias("box")),
         sql(READ + ' SELECT frame, k - 1 AS place, box FROM r', "v_boxes", recursive=True))
JOINED = f""", b AS MATERIALIZED (SELECT r.frame, r.k, r.line, v.x1, v.x2, v.score, SAID_HERE AS said FROM r JOIN v_boxes v ON v.frame = r.frame AND v.box = r.box),
 g AS (SELECT DISTINCT frame, 0::BIGINT AS k, '' AS text, -1e18::DOUBLE AS line, -1e18::DOUBLE AS edge FROM b
 UNION ALL SELECT b.frame, b.k, kept || CASE WHEN g.line = b.line AND b.x1 < g.edge THEN substring(said, coalesce(list_max(list_filter(range(1, 13), lambda n: n <= length(kept) AND n <= length(said) AND lower(right(kept, n)) = lower(left(said, n)))), 0) + 1)
 ELSE CASE WHEN kept = '' OR regexp_matches(kept, '[{CJK}]$') OR regexp_matches(said, '^[{CJK}]') OR regexp_matches(said, '^[,.;:!?%)\\]}}…]') THEN '' ELSE ' ' END || said END, b.line, b.x2
 FROM g JOIN b ON b.frame = g.frame AND b.k = g.k + 1, LATERAL (SELECT CASE WHEN g.line = b.line AND regexp_matches(b.said, '^[{CJK}]') THEN regexp_replace(g.text, '[-—_]+$', '') ELSE g.text END AS kept)),
 last AS (SELECT frame, text FROM g QUALIFY row_number() OVER (PARTITION BY frame ORDER BY k DESC) = 1) SELECT frame, text, round((SELECT avg(score) FROM v_boxes v WHERE v.frame = last.frame), 6) AS score FROM last"""
register("join_rows", lambda s, d: _said_boxes(s, d).select("frame", cp.join_rows(F.col("boxes")).alias("r")).select("frame", "r.text", F.round("r.score", 6).alias("score")),
         sql(READ + JOINED.replace("SAID_HERE", "CASE r.box % 4 WHEN 0 THEN '字幕' || text WHEN 1 THEN text || ' -' WHEN 2 THEN lower(text) ELSE text END"), "v_boxes", recursive=True))


def _stills(s, d):
    """Boxes of videos of 128 order numbers each: the first box of a frame hardly moves, and in a third of the videos says nearly the same."""
    b = v_boxes(s, d).withColumn("video_id", F.floor(F.col("frame") / 128).cast("long"))
    said = F.when(F.col("video_id") % 3 == 0, F.when(F.col("frame") % 7 == 0, "Live newz").otherwise("Live news")).when(F.col("video_id") % 3 == 1, F.concat(F.lit("scene "), F.col("frame").cast("string"))).otherwise(F.col("text"))
    first = F.col("box") == 1
    return b.select("video_id", F.col("frame").alias("frame_idx"), F.col("box").alias("n"), F.when(first, said).otherwise(F.col("text")).alias("text"),
                    F.when(first, F.col("frame") % 5 * 3).otherwise(F.col("rect.x1")).alias("x"), F.when(first, 10 + F.col("frame") % 3).otherwise(100 + F.col("rect.y1")).alias("y"))


STILLS = """WITH s AS (SELECT frame // 128 AS video_id, frame, box, CASE WHEN box > 1 OR (frame // 128) % 3 = 2 THEN text WHEN (frame // 128) % 3 = 1 THEN 'scene ' || frame WHEN frame % 7 = 0 THEN 'Live newz' ELSE 'Live news' END AS text,
 CASE WHEN box = 1 THEN frame % 5 * 3 ELSE x1 END::DOUBLE AS x, CASE WHEN box = 1 THEN 10 + frame % 3 ELSE 100 + y1 END::DOUBLE AS y FROM v_boxes),
 n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame, box) AS k FROM s WHERE length(text) >= 2),
 f AS (SELECT video_id, 0::BIGINT AS k, []::STRUCT(x DOUBLE, y DOUBLE)[] AS heads, NULL::BIGINT AS spot, NULL::BIGINT AS frame, NULL::VARCHAR AS text FROM (SELECT DISTINCT video_id FROM n)
 UNION ALL SELECT n.video_id, n.k, CASE WHEN hit IS NULL THEN list_append(heads, {'x': n.x, 'y': n.y}) ELSE heads END, coalesce(hit, len(heads) + 1), n.frame, n.text FROM f JOIN n ON n.video_id = f.video_id AND n.k = f.k + 1,
 LATERAL (SELECT list_position(list_transform(f.heads, lambda h: abs(n.x - h.x) <= 14 AND abs(n.y - h.y) <= 10), true) AS hit)),
 c AS (SELECT video_id, spot, text, count(*) AS n FROM f WHERE k > 0 GROUP BY ALL), o AS (SELECT video_id, spot, count(DISTINCT frame) AS seen, count(*) AS total FROM f WHERE k > 0 GROUP BY ALL),
 m AS (SELECT video_id, spot, arg_max(text, {'n': n, 'text': text}) AS common, max(n) AS most FROM c GROUP BY ALL), v AS (SELECT video_id, count(DISTINCT frame) AS frames FROM s GROUP BY ALL),
 g AS (SELECT * FROM o JOIN m USING (video_id, spot) JOIN v USING (video_id) WHERE frames >= 8 AND seen >= greatest(8, floor(frames * 0.6::DOUBLE)) AND most >= 0.55::DOUBLE * total),
 q AS (SELECT DISTINCT text AS a, common AS b FROM c JOIN g USING (video_id, spot)), """
register("static_texts", lambda s, d: cp.static_texts(_stills(s, d), _stills(s, d).groupBy("video_id").agg(F.count_distinct("frame_idx").alias("frames"))),
         sql(STILLS + lcs("q") + """, w AS (SELECT video_id, spot FROM c JOIN g USING (video_id, spot) JOIN ratios r ON r.a = c.text AND r.b = g.common
 GROUP BY ALL HAVING sum(CASE WHEN c.text = g.common OR r.r >= 0.7::DOUBLE THEN c.n ELSE 0 END) >= 0.75::DOUBLE * any_value(g.total)) SELECT DISTINCT video_id, lower(text) AS text FROM c JOIN w USING (video_id, spot)""", "v_boxes", recursive=True))
register("height_range", lambda s, d: cp.height_range(v_boxes(s, d).select(F.col("frame").alias("video_id"), (F.col("rect.y2") - F.col("rect.y1")).alias("height"))),
         sql("SELECT frame AS video_id, round(median(y2 - y1) * 0.62::DOUBLE, 1) AS low, round(median(y2 - y1) * 1.75::DOUBLE, 1) AS high, list_sort(list(y2 - y1))[count(*) // 2 + 1] AS middle FROM v_boxes GROUP BY frame", "v_boxes"))
register("dominant_color", lambda s, d: cp.dominant_color(table(s, d, "part").select(F.floor(F.col("p_partkey") / 50).cast("long").alias("video_id"), F.col("p_partkey").alias("pos"), (F.col("p_size") * 5).alias("r"), (F.col("p_size") * 3).alias("g"), F.lit(100).alias("b"), (F.col("p_partkey") % 9 + 1).alias("weight"))).select("video_id", "rgb.*"),
         """WITH RECURSIVE n AS MATERIALIZED (SELECT p_partkey // 50 AS video_id, row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) AS k, (p_size * 5)::DOUBLE AS r, (p_size * 3)::DOUBLE AS g, (p_partkey % 9 + 1)::DOUBLE AS w FROM part),
 f AS (SELECT video_id, 0::BIGINT AS k, []::STRUCT(r DOUBLE, g DOUBLE, w DOUBLE)[] AS cs FROM (SELECT DISTINCT video_id FROM n)
 UNION ALL SELECT n.video_id, n.k, CASE WHEN hit IS NULL THEN list_append(cs, {'r': n.r, 'g': n.g, 'w': n.w}) ELSE list_transform(cs, lambda c, i: CASE WHEN i = hit THEN {'r': (c.r * c.w + n.r * n.w) / (c.w + n.w), 'g': (c.g * c.w + n.g * n.w) / (c.w + n.w), 'w': c.w + n.w} ELSE c END) END
 FROM f JOIN n ON n.video_id = f.video_id AND n.k = f.k + 1, LATERAL (SELECT list_position(list_transform(f.cs, lambda c: (c.r - n.r) ** 2 + (c.g - n.g) ** 2 <= 3600), true) AS hit)),
 l AS (SELECT video_id, cs FROM f QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY k DESC) = 1), t AS (SELECT video_id, cs[list_position(list_transform(cs, lambda c: c.w), list_max(list_transform(cs, lambda c: c.w)))] AS c FROM l)
 SELECT video_id, round_even(c.r, 0)::INT AS r, round_even(c.g, 0)::INT AS g, 100 AS b FROM t""")
register("downsample_min_gap", lambda s, d: cp.downsample_min_gap(v_reads(s, d).select("video_id", "stamp_s"), 0.25).select("video_id", ms("stamp_s").alias("stamp_ms")),
         sql(f"""o AS (SELECT video_id, list(stamp_s ORDER BY stamp_s) AS ts FROM v_reads GROUP BY video_id), f AS (SELECT video_id, ts, 1 AS k, ts[1] AS last, [ts[1]] AS kept FROM o UNION ALL
 SELECT video_id, ts, k + 1, CASE WHEN ts[k + 1] >= last + (4.0::DOUBLE - 0.005::DOUBLE) THEN ts[k + 1] ELSE last END, CASE WHEN ts[k + 1] >= last + (4.0::DOUBLE - 0.005::DOUBLE) THEN list_append(kept, ts[k + 1]) ELSE kept END FROM f WHERE k < len(ts)),
 u AS (SELECT video_id, unnest(kept) AS t FROM f WHERE k = len(ts)) SELECT video_id, {m('t')} AS stamp_ms FROM u""".join(["WITH ", ""]), "v_reads", recursive=True))
#: Ratios of all pairs of the distinct noisy texts, and those alike at 0.8 as strings of both.
NOISY = "WITH q AS (SELECT x.text AS a, y.text AS b FROM (SELECT DISTINCT text FROM v_noisy WHERE text <> '') x, (SELECT DISTINCT text FROM v_noisy WHERE text <> '') y), " + lcs("q") + ", al AS MATERIALIZED (SELECT list(a || chr(1) || b) AS pairs FROM ratios WHERE r >= 0.8::DOUBLE)"
STABLE = """, w AS (SELECT video_id, frame_idx, text, score, count(*) OVER (PARTITION BY video_id) AS total, list_filter(list({'t': text, 's': score}) OVER (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), lambda x: x.t <> '') AS said FROM v_noisy),
 g AS (SELECT w.*, list_transform(said, lambda c: list_filter(said, lambda x: list_contains(pairs, x.t || chr(1) || c.t))) AS groups FROM w, al),
 h AS (SELECT *, list_transform(groups, lambda x, i: {'n': len(x), 's': round(list_sum(list_transform(x, lambda y: y.s)), 9), 'i': -i, 'x': x}) AS ranked FROM g),
 best AS (SELECT *, CASE WHEN text <> '' AND total >= 3 AND len(ranked) > 0 THEN list_sort(ranked, 'DESC')[1].x END AS top FROM h),
 stable AS (SELECT video_id, frame_idx, CASE WHEN len(top) >= 3 THEN list_reduce(top, lambda a, x: CASE WHEN CASE WHEN abs(x.s - a.s) > 0.015::DOUBLE THEN x.s > a.s ELSE length(x.t) > length(a.t) END THEN x ELSE a END) ELSE {'t': text, 's': score} END AS v FROM best)"""
FLICKER = """, near AS (SELECT *, lag(v) OVER o AS b, lead(v) OVER o AS a FROM stable WINDOW o AS (PARTITION BY video_id ORDER BY frame_idx)),
 odd AS (SELECT near.*, b IS NOT NULL AND a IS NOT NULL AND v.t <> '' AND NOT list_contains(pairs, v.t || chr(1) || b.t) AND NOT list_contains(pairs, v.t || chr(1) || a.t) AS odd, coalesce(b.t <> '' AND list_contains(pairs, b.t || chr(1) || a.t), false) AS same FROM near, al),
 calm AS (SELECT video_id, frame_idx, CASE WHEN odd AND same THEN CASE WHEN CASE WHEN abs(b.s - a.s) > 0.015::DOUBLE THEN b.s > a.s ELSE length(b.t) > length(a.t) END THEN b ELSE a END
 WHEN odd AND length(v.t) < 12 AND 2 * length(v.t) < greatest(length(b.t), length(a.t)) THEN {'t': '', 's': 0.0::DOUBLE} ELSE v END AS v FROM odd)"""
RAW = ", stable AS (SELECT video_id, frame_idx, {'t': text, 's': score} AS v FROM v_noisy)"
register("drop_flicker", lambda s, d: cp.drop_flicker(v_noisy(s, d)).select("video_id", "frame_idx", "text", F.round("score", 6).alias("score")),
         sql(NOISY + RAW + FLICKER + " SELECT video_id, frame_idx, v.t AS text, round(v.s, 6) AS score FROM calm", "v_cues", "v_noisy"))
register("stabilize_reads", lambda s, d: cp.stabilize_reads(v_noisy(s, d)).select("video_id", "frame_idx", "text", F.round("score", 6).alias("score")),
         sql(NOISY + STABLE + " SELECT video_id, frame_idx, v.t AS text, round(v.s, 6) AS score FROM stable", "v_cues", "v_noisy"))
register("best_caption", lambda s, d: cp.best_caption(v_noisy(s, d).withColumn("g", F.floor(F.col("frame_idx") / 10)), ["video_id", "g"]).select("video_id", "g", "text", F.round("score", 6).alias("score")),
         sql(NOISY + """, t AS (SELECT video_id, frame_idx // 10 AS g, text, count(*) AS n, avg(score) AS mean, min(frame_idx) AS first FROM v_noisy WHERE text <> '' GROUP BY ALL),
 p AS (SELECT t.*, sum(CASE WHEN r >= 0.8::DOUBLE THEN o.n ELSE 0 END) AS alike, round(sum(r * o.n), 9) AS near FROM t JOIN t o ON o.video_id = t.video_id AND o.g = t.g JOIN ratios ON a = t.text AND b = o.text GROUP BY ALL)
 SELECT video_id, g, text, round(mean, 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY video_id, g ORDER BY n DESC, alike DESC, near DESC, mean DESC, length(text) DESC, first) = 1""", "v_cues", "v_noisy"))
#: The fold of reads to captions: what is on is a list of distinct texts with their reads and scores; its best one is found anew with each read.
FOLD = """, rr AS MATERIALIZED (SELECT map(list(a || chr(1) || b), list(r)) AS rs FROM ratios), ns AS (SELECT list(DISTINCT text) AS known FROM v_noisy),
 k AS MATERIALIZED (SELECT video_id, stamp_s, v.t AS text, v.s AS score, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS k FROM {reads} JOIN v_noisy USING (video_id, frame_idx)),
 f AS (SELECT video_id, 0::BIGINT AS k, 0.0::DOUBLE AS start_s, []::STRUCT(t VARCHAR, n BIGINT, s DOUBLE)[] AS said, ''::VARCHAR AS shown, NULL::DOUBLE AS from_s, NULL::DOUBLE AS until_s, NULL::VARCHAR AS done, 0.0::DOUBLE AS last FROM (SELECT DISTINCT video_id FROM k)
 UNION ALL SELECT x.video_id, x.k, CASE WHEN x.go THEN x.start_s ELSE x.stamp_s END, x.now, coalesce(best.t, ''), CASE WHEN NOT x.go AND x.shown <> '' THEN x.start_s END, CASE WHEN NOT x.go AND x.shown <> '' THEN x.stamp_s END, CASE WHEN NOT x.go AND x.shown <> '' THEN x.shown END, x.stamp_s
 FROM (SELECT y.*, CASE WHEN text = '' THEN kept WHEN list_contains(list_transform(kept, lambda c: c.t), text) THEN list_transform(kept, lambda c: CASE WHEN c.t = text THEN {{'t': c.t, 'n': c.n + 1, 's': c.s + score}} ELSE c END)
 ELSE list_append(kept, {{'t': text, 'n': 1::BIGINT, 's': score}}) END AS now FROM (SELECT z.*, CASE WHEN go THEN said ELSE [] END AS kept FROM (SELECT f.video_id, f.start_s, f.said, f.shown, k.k, k.stamp_s, k.text, k.score, rs,
 CASE WHEN k.text = '' OR f.shown = '' THEN k.text = f.shown ELSE rs[k.text || chr(1) || f.shown] >= 0.8::DOUBLE OR (least(length(replace(k.text, ' ', '')), length(replace(f.shown, ' ', ''))) >= 3
 AND greatest(length(replace(k.text, ' ', '')), length(replace(f.shown, ' ', ''))) <= 2 * least(length(replace(k.text, ' ', '')), length(replace(f.shown, ' ', '')))
 AND (contains(replace(k.text, ' ', ''), replace(f.shown, ' ', '')) OR contains(replace(f.shown, ' ', ''), replace(k.text, ' ', '')))) END AS go FROM f JOIN k ON k.video_id = f.video_id AND k.k = f.k + 1, rr) z) y) x,
 LATERAL (SELECT list_sort(list_transform(x.now, lambda c, i: {{'n': c.n, 'alike': list_sum(list_transform(x.now, lambda o: CASE WHEN x.rs[c.t || chr(1) || o.t] >= 0.8::DOUBLE THEN o.n ELSE 0 END)),
 'near': round(list_sum(list_transform(x.now, lambda o: x.rs[c.t || chr(1) || o.t] * o.n)), 9), 'mean': c.s / c.n, 'len': length(c.t), 'i': -i, 't': c.t}}), 'DESC')[1] AS best)),
 o AS (SELECT video_id, from_s AS start_s, until_s AS end_s, done AS text FROM f WHERE done IS NOT NULL
 UNION ALL SELECT video_id, start_s, last + 1.0::DOUBLE / 15, shown FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY k DESC) = 1) WHERE shown <> '')"""
FOLDED = f" SELECT video_id AS doc_id, row_number() OVER (PARTITION BY video_id ORDER BY start_s) - 1 AS idx, {m('start_s')} AS start_ms, {m('end_s')} AS end_ms, text FROM o WHERE end_s - start_s >= 0.2::DOUBLE"
register("merge_captions", lambda s, d: cp.merge_captions(v_noisy(s, d), votes=3).select("doc_id", "idx", ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms"), "text"),
         sql(NOISY + STABLE + FLICKER + FOLD.format(reads="calm") + FOLDED, "v_cues", "v_noisy", recursive=True))
register("merge_captions_unsmoothed", lambda s, d: cp.merge_captions(v_noisy(s, d), flicker=False).select("doc_id", "idx", ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms"), "text"),
         sql(NOISY + RAW + FOLD.format(reads="stable") + FOLDED, "v_cues", "v_noisy", recursive=True))
register("merge_captions_exact", lambda s, d: cp.merge_captions_exact(v_reads(s, d)).select("doc_id", "idx", ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms"), "text"),
         sql(f"""WITH q AS (SELECT *, CASE WHEN text = lag(text) OVER w THEN 0 ELSE 1 END AS new FROM v_reads WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)), g AS (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY frame_idx) AS island FROM q),
 r AS (SELECT video_id, island, min(stamp_s) AS start_s, max(stamp_s) AS last, first(text) AS text FROM g GROUP BY ALL), e AS (SELECT *, coalesce(lead(start_s) OVER (PARTITION BY video_id ORDER BY island), last + 1.0::DOUBLE / 15) AS end_s FROM r),
 k AS (SELECT * FROM e WHERE text <> '' AND end_s - start_s >= 0.2::DOUBLE) SELECT video_id AS doc_id, row_number() OVER (PARTITION BY video_id ORDER BY island) - 1 AS idx, {m('start_s')} AS start_ms, {m('end_s')} AS end_ms, text FROM k""", "v_reads"))


def _detections(s, d):
    """Boxes of videos of 400 order numbers: a line of text with odd letters, a box inside it, now and then a second line, and boxes that are hardly sure."""
    said = F.get(F.array(*map(F.lit, SAID)), (F.floor(F.col("frame") / 40) % len(SAID)).cast("int"))
    at = F.col("frame") % 9 + 2
    odd = F.concat(F.substring(said, F.lit(1), (at - 1).cast("int")), F.lit("x"), F.substring(said, (at + 1).cast("int"), F.lit(100)))
    first = F.when((F.col("frame") % 3 == 0) & (said != ""), odd).otherwise(said)
    rect = lambda *v: F.struct(*[F.lit(float(x)).alias(c) for x, c in zip(v, ("x1", "y1", "x2", "y2"))])
    of = lambda *v: F.when(F.col("box") == 1, v[0]).when(F.col("box") == 2, v[1]).when((F.col("box") == 3) & (F.col("frame") % 40 < 12), v[2]).otherwise(v[3])
    return v_boxes(s, d).select(F.floor(F.col("frame") / 400).cast("long").alias("video_id"), F.col("frame").alias("frame_idx"), (F.col("frame") / 15).alias("stamp_s"), F.col("box").alias("n"),
                                of(first, F.lit("inner"), F.lit("and below"), F.col("text")).alias("text"), of(F.lit(0.95), F.lit(0.9), F.lit(0.8), F.lit(0.3)).alias("score"),
                                of(rect(100, 50, 500, 90), rect(150, 55, 300, 85), rect(100, 200, 400, 240), rect(0, 0, 50, 30)).alias("rect"))


DETECTED = f"""WITH said AS (SELECT frame, box, text, {SAID_SQL}[1 + (frame // 40) % {len(SAID)}] AS said FROM v_boxes),
 v_det AS MATERIALIZED (SELECT frame, box, CASE box WHEN 1 THEN CASE WHEN frame % 3 = 0 AND said <> '' THEN substring(said, 1, frame % 9 + 1) || 'x' || substring(said, frame % 9 + 3) ELSE said END WHEN 2 THEN 'inner' ELSE 'and below' END AS text,
 CASE box WHEN 1 THEN 0.95 WHEN 2 THEN 0.9 ELSE 0.8 END::DOUBLE AS score, CASE box WHEN 2 THEN 150 ELSE 100 END::DOUBLE AS x1, CASE box WHEN 1 THEN 50 WHEN 2 THEN 55 ELSE 200 END::DOUBLE AS y1,
 CASE box WHEN 1 THEN 500 WHEN 2 THEN 300 ELSE 400 END::DOUBLE AS x2, CASE box WHEN 1 THEN 90 WHEN 2 THEN 85 ELSE 240 END::DOUBLE AS y2 FROM said WHERE box = 1 AND said <> '' OR box = 2 OR box = 3 AND frame % 40 < 12),
 kept AS MATERIALIZED ({APART.replace("WITH ", "WITH RECURSIVE ", 1).replace("v_boxes", "v_det")}), v_in AS MATERIALIZED (SELECT v_det.* FROM v_det JOIN kept USING (frame, box)),
 rows_of AS MATERIALIZED ({(READ + JOINED.replace("SAID_HERE", "text")).replace("WITH ", "WITH RECURSIVE ", 1).replace("v_boxes", "v_in")}),
 v_noisy AS MATERIALIZED (SELECT frame // 400 AS video_id, frame AS frame_idx, frame / 15 AS stamp_s, text, score FROM rows_of), """ + (NOISY + RAW + FLICKER + FOLD.format(reads="calm"))[5:] + f""",
 cap AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_s) AS n FROM o WHERE end_s - start_s >= 0.2::DOUBLE),
 isl AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY n) AS island FROM (SELECT *, CASE WHEN text = lag(text) OVER w AND start_s - lag(end_s) OVER w BETWEEN 0 AND 0.2::DOUBLE THEN 0 ELSE 1 END AS fresh FROM cap WINDOW w AS (PARTITION BY video_id ORDER BY n))),
 one AS (SELECT video_id, island, min(start_s) AS start_s, max(end_s) AS end_s, arg_min(text, n) AS text FROM isl GROUP BY ALL),
 nxt AS (SELECT *, lead(start_s) OVER w AS following, row_number() OVER w - 1 AS idx FROM one WINDOW w AS (PARTITION BY video_id ORDER BY start_s, end_s, island))
 SELECT video_id AS doc_id, idx, {m('start_s')} AS start_ms, {m('CASE WHEN end_s > following - 0.04::DOUBLE THEN greatest(start_s + 0.05::DOUBLE, following - 0.04::DOUBLE) ELSE end_s END')} AS end_ms, text FROM nxt"""
register("captions_from_detections", lambda s, d: cp.captions_from_detections(_detections(s, d)).select("doc_id", F.col("idx").cast("long").alias("idx"), ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms"), "text"),
         sql(DETECTED, "v_boxes", recursive=True))
register("fuzzy_anti_join", lambda s, d: j.fuzzy_anti_join(v_noisy(s, d), v_noisy(s, d).select("video_id", F.when(F.col("video_id") % 2 == 0, "Paper lantern").otherwise("RAIN at noom").alias("item")).distinct()).select("video_id", "frame_idx", "text"),
         sql("WITH i AS (SELECT DISTINCT video_id, lower(CASE WHEN video_id % 2 = 0 THEN 'Paper lantern' ELSE 'RAIN at noom' END) AS item FROM v_noisy), q AS (SELECT DISTINCT lower(text) AS a, item AS b FROM v_noisy JOIN i USING (video_id) WHERE text <> ''), " + lcs("q") +
             " SELECT video_id, frame_idx, text FROM v_noisy JOIN i USING (video_id) WHERE text = '' OR NOT EXISTS (SELECT 1 FROM ratios WHERE a = lower(text) AND b = item AND (a = b OR abs(length(a) - length(b)) <= greatest(4, length(b) // 2) AND r >= 0.85::DOUBLE))", "v_cues", "v_noisy"))


def _fine(s, d):
    """Fine reads around each cue's bounds, some of them with an odd letter."""
    said = F.when(F.col("event_id") % 2 == 0, F.concat("text", F.lit("s"))).when(F.col("event_id") % 7 == 0, "other").otherwise(F.col("text"))
    samples = [F.struct((F.col(c) + k).alias("stamp_s"), t.alias("text")) for c, k, t in
               (("start_s", -0.3, said), ("start_s", 0.1, F.col("text")), ("end_s", -0.45, said), ("end_s", -0.2, F.lit("")), ("end_s", -0.1, F.col("text")))]
    return v_cues(s, d, blanks=False).select("doc_id", F.explode(F.array(*samples)).alias("f")).select("doc_id", "f.*")


register("refine_boundaries", lambda s, d: j.refine_boundaries(v_cues(s, d, blanks=False), _fine(s, d), 0.5).select("doc_id", "idx", ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms")),
         sql("""WITH c AS MATERIALIZED (SELECT v_cues.doc_id, v_cues.idx, start_s, end_s, event_type AS text, event_id FROM v_cues JOIN events USING (event_id)),
 g AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN text || 's' WHEN event_id % 7 = 0 THEN 'other' ELSE text END AS said FROM c),
 fine AS (SELECT doc_id, unnest([{'t': start_s - 0.3::DOUBLE, 'x': said}, {'t': start_s + 0.1::DOUBLE, 'x': text}, {'t': end_s - 0.45::DOUBLE, 'x': said}, {'t': end_s - 0.2::DOUBLE, 'x': ''}, {'t': end_s - 0.1::DOUBLE, 'x': text}]) AS f FROM g),
 q AS (SELECT DISTINCT f.x AS a, c.text AS b FROM fine JOIN c USING (doc_id) WHERE f.x <> ''), """ + lcs("q") + """,
 w AS (SELECT c.doc_id, c.idx, f.t AS stamp, coalesce(r >= 0.8::DOUBLE, f.x = c.text) AS same, f.t BETWEEN greatest(0, start_s - 0.5::DOUBLE) AND start_s AND start_s > 0 AS early, f.t BETWEEN greatest(0, end_s - 0.5::DOUBLE) AND end_s AS late
 FROM c JOIN fine USING (doc_id) LEFT JOIN ratios ON a = f.x AND b = c.text WHERE (f.t BETWEEN greatest(0, start_s - 0.5::DOUBLE) AND start_s AND start_s > 0) OR f.t BETWEEN greatest(0, end_s - 0.5::DOUBLE) AND end_s),
 m AS (SELECT *, min(CASE WHEN late AND same THEN stamp END) OVER (PARTITION BY doc_id, idx) AS met FROM w),
 b AS (SELECT doc_id, idx, min(stamp) FILTER (early AND same) AS appeared, min(stamp) FILTER (late AND NOT same AND stamp > met) AS gone FROM m GROUP BY ALL),
 n AS MATERIALIZED (SELECT c.doc_id, c.idx, start_s, end_s, appeared, gone, row_number() OVER (PARTITION BY c.doc_id ORDER BY c.idx) AS k FROM c LEFT JOIN b USING (doc_id, idx)),
 f AS (SELECT DISTINCT doc_id, 0::BIGINT AS k, NULL::BIGINT AS idx, 0.0::DOUBLE AS start_s, 0.0::DOUBLE AS last FROM n UNION ALL SELECT n.doc_id, n.k, n.idx, s, CASE WHEN n.gone > s + 0.05::DOUBLE THEN n.gone ELSE n.end_s END FROM f JOIN n ON n.doc_id = f.doc_id AND n.k = f.k + 1,
 LATERAL (SELECT greatest(f.last, CASE WHEN n.appeared IS NULL THEN n.start_s ELSE least(n.appeared, n.end_s - 0.05::DOUBLE) END) AS s))
 SELECT doc_id, idx, """ + f"{m('start_s')} AS start_ms, {m('last')} AS end_ms FROM f WHERE k > 0", "v_cues", recursive=True))
register("merge_short", lambda s, d: cues_out(sg.merge_short(v_cues(s, d).where("text <> ''"), 1.5, 12.0, 84)),
         sql("""n AS (SELECT *, row_number() {ORDER} AS k, greatest(0, end_s - start_s) AS dur FROM v_cues WHERE text <> ''), c AS (SELECT doc_id, max(k) AS m FROM n GROUP BY doc_id),
 f AS (SELECT n.doc_id, 1::BIGINT AS k, start_s, end_s, text, translation, speaker, 0::BIGINT AS idx FROM n WHERE k = 1 UNION ALL
 SELECT n.doc_id, n.k, CASE WHEN j THEN f.start_s ELSE n.start_s END, n.end_s, CASE WHEN j THEN trim(f.text || ' ' || n.text) ELSE n.text END, CASE WHEN j THEN f.translation ELSE n.translation END, CASE WHEN j THEN f.speaker ELSE n.speaker END, CASE WHEN j THEN f.idx ELSE f.idx + 1 END
 FROM f JOIN n ON n.doc_id = f.doc_id AND n.k = f.k + 1, LATERAL (SELECT n.dur < 1.5 AND greatest(0, f.end_s - f.start_s) + n.dur <= 12 AND length(f.text) + length(n.text) + 1 <= 84 AND n.start_s - f.end_s < 0.4::DOUBLE AS j)),
 x AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, idx ORDER BY k DESC) = 1) SELECT {CUES} FROM x""".join(["WITH ", ""]), "v_cues", recursive=True))
register("resegment", lambda s, d: cues_out(sg.resegment(v_lines(s, d))), sql(RESEGMENT, "v_lines", recursive=True))


def _stream(s, d, name):
    """A table as a stream; the braces make its path a pattern, as a stream takes a single file by pattern only."""
    return s.readStream.schema(table(s, d, name).schema).parquet(f"{d}/{{{name}}}.parquet")


def _streamed_captions(s, d, **smoothing):
    """Captions from a stream of events; the place of a read is its time. A row of another table, years later, moves the watermark past all reads."""
    e = _stream(s, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    stamp = (at - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 3.6e9
    reads = e.select(F.col("user_id").alias("video_id"), at.alias("frame_idx"), stamp.alias("stamp_s"), F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("text"),
                     F.least(F.col("value") / 500, F.lit(1.0)).alias("score"), F.timestamp_seconds(stamp + 86_400).alias("at"))
    nothing = [(F.lit(-1) if f.name == "video_id" else F.lit(None)).cast(f.dataType).alias(f.name) for f in reads.schema.fields[:-1]]
    end = _stream(s, d, "region").where("r_regionkey = 0").select(*nothing, F.timestamp_seconds(F.lit(8 * 10 ** 9)).alias("at"))
    found = streams.rows_of_stream(st.stream_merge_captions(reads.unionByName(end), idle="1000 days", **smoothing), "captions")
    return found.select("video_id", ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms"), "text")


register("stream_merge_captions", _streamed_captions,
         sql(f"""WITH q AS (SELECT *, CASE WHEN text = lag(text) OVER w THEN 0 ELSE 1 END AS new FROM v_reads WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)), g AS (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY frame_idx) AS island FROM q),
 r AS (SELECT video_id, island, min(stamp_s) AS start_s, max(stamp_s) AS last, first(text) AS text FROM g GROUP BY ALL), e AS (SELECT *, coalesce(lead(start_s) OVER (PARTITION BY video_id ORDER BY island), last + 1.0::DOUBLE / 15) AS end_s FROM r)
 SELECT video_id, {m('start_s')} AS start_ms, {m('end_s')} AS end_ms, text FROM e WHERE text <> '' AND end_s - start_s >= 0.2::DOUBLE""", "v_reads"))


def _smoothed_stream(s, d):
    """Noisy reads that land as files in no order, one a trigger, and then a row that moves the watermark past all of them."""
    folder = streams.shared_folder(s, "noisy")
    reads = v_noisy(s, d).withColumn("at", F.timestamp_seconds(F.col("stamp_s") + 86_400))
    reads.repartition(3, F.xxhash64("frame_idx")).write.parquet(folder)
    end = s.range(1).select(*[(F.lit(-1) if f.name == "video_id" else F.lit(None)).cast(f.dataType).alias(f.name) for f in reads.schema.fields[:-1]], F.timestamp_seconds(F.lit(8 * 10 ** 9)).alias("at"))
    end.write.mode("append").parquet(folder)
    stream = s.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    found = streams.rows_of_stream(st.stream_merge_captions(stream, idle="1000 days", delay="100 days", votes=3, flicker=True), "captions")
    return found.select("video_id", ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms"), "text")


register("stream_merge_captions_smoothed", _smoothed_stream,
         sql(NOISY + STABLE + FLICKER + FOLD.format(reads="calm") + f" SELECT video_id, {m('start_s')} AS start_ms, {m('end_s')} AS end_ms, text FROM o WHERE end_s - start_s >= 0.2::DOUBLE", "v_cues", "v_noisy", recursive=True))


def _streamed_issues(s, d):
    """Timing issues of documents as plain text files that land in a stream."""
    files = _stream(s, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("doc_id"), F.col("text").alias("value"))
    found = streams.rows_of_batches(lambda sink: st.stream_subtitle_qc(files, sink), s, "issues", "doc_id string, idx long, kind string, severity string, message string")
    return found.select("doc_id", "idx", "kind", "severity")


register("stream_subtitle_qc", _streamed_issues,
         sql("SELECT doc_id || '.txt' AS doc_id, idx, 'fast' AS kind, 'warning' AS severity FROM v_lines WHERE length(text) > 63", "v_lines"))


# ---- files that are written, and read back or streamed
def _saved(s, d):
    """Cues written as files of their own, half of them in each of two formats."""
    named = v_cues(s, d, blanks=False).withColumn("doc_id", F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".srt").otherwise(".vtt")))
    folder = streams.shared_folder(s, "saved")
    sinks.save_subtitles(named, folder)
    return folder


SAVED = f"""WITH f AS (SELECT doc_id || CASE WHEN doc_id % 2 = 0 THEN '.srt' ELSE '.vtt' END AS doc_id, v_cues.idx AS n, {m('start_s')} AS a, {m('end_s')} AS b, event_type AS said FROM v_cues JOIN events USING (event_id)),
 r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a, b, n) - 1 AS idx, a, b, said FROM f)"""
register("save_subtitles", lambda s, d: sub.read_subtitles(sub.read_saved(s, _saved(s, d)))[0].select("doc_id", "idx", ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms"), "text"),
         sql(SAVED + " SELECT doc_id, idx, a AS start_ms, b AS end_ms, said AS text FROM r", "v_cues"))


def _streamed_files(s, d):
    """Timing issues of files that land in a folder, in about three triggers."""
    folder = _saved(s, d)
    a_trigger = table(s, d, "events").select("user_id").distinct().count() // 3 + 1
    with streams.small_files(s):
        files = sub.subtitle_file_stream(s, folder, a_trigger, saved=True)
        found = streams.rows_of_batches(lambda sink: st.stream_subtitle_qc(files, sink, read_once=True), s, "issues", "doc_id string, idx long, kind string, severity string, message string, batch_id int")
    return found.select("doc_id", "idx", "kind", "severity")


register("stream_subtitle_files", _streamed_files, sql(SAVED + """, q AS (SELECT doc_id, idx, a, b, b - a AS dur, 1000 * length(said) / (b - a) AS cps, lead(a) OVER (PARTITION BY doc_id ORDER BY idx) AS n FROM r),
 i AS (SELECT doc_id, idx, unnest([CASE WHEN b <= a THEN 'negative' WHEN dur < 500 THEN 'short' WHEN dur > 8000 THEN 'long' END, CASE WHEN dur > 0 AND cps > 21 THEN 'fast' END, CASE WHEN b > n THEN 'overlap' WHEN n - b > 15000 THEN 'gap' END]) AS kind FROM q)
 SELECT doc_id, idx, kind, CASE WHEN kind IN ('negative', 'overlap') THEN 'error' ELSE 'warning' END AS severity FROM i WHERE kind IS NOT NULL""", "v_cues"))
