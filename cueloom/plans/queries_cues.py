"""Queries on cues: projections, filters, edits, windows and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, cues as c, joins as j, timing as t
from .registry import MS, cues_out, ms, register, sql
from .relations import table, v_cues, v_source


def m(x: str) -> str:
    return MS.format(x)


DUR = "greatest(0, end_s - start_s)"
RATIO = "CASE WHEN length(trim(text)) > 0 THEN length(trim(translation)) / length(trim(text)) ELSE 0 END"
CPS = f"CASE WHEN {DUR} > 0 THEN length(text) / ({DUR}) ELSE 0 END"

register("normalize_cues", lambda s, d: cues_out(c.normalize_cues(v_cues(s, d).withColumns({
    "start_s": F.col("start_s") - 100, "text": F.concat(F.lit(" \t"), "text", F.lit("\n")), "speaker": F.nullif("speaker", F.lit(""))}))),
    sql("WITH x AS (SELECT * REPLACE (greatest(0, start_s - 100) AS start_s) FROM v_cues) SELECT {CUES} FROM x", "v_cues"))
register("cue_metrics", lambda s, d: c.cue_metrics(v_cues(s, d)).select("doc_id", "idx", ms("duration_s").alias("duration_ms"), F.col("chars").cast("long").alias("chars"), F.round("cps", 6).alias("cps"), F.round("length_ratio", 6).alias("length_ratio")),
         sql(f"SELECT doc_id, idx, {m(DUR)} AS duration_ms, length(text) AS chars, round({CPS}, 6) AS cps, round({RATIO}, 6) AS length_ratio FROM v_cues", "v_cues"))
register("display_text", lambda s, d: v_cues(s, d).select("doc_id", "idx", *[c.display_text(k).alias(k) for k in ("original", "translation", "both")]),
         sql("""SELECT doc_id, idx, CASE WHEN text <> '' THEN text ELSE translation END AS original, CASE WHEN translation <> '' THEN translation ELSE text END AS translation,
 CASE WHEN text <> '' AND translation <> '' THEN text || chr(10) || translation WHEN text <> '' THEN text ELSE translation END AS "both" FROM v_cues""", "v_cues"))
register("shift_cues", lambda s, d: cues_out(c.shift_cues(v_cues(s, d), -20.0, F.col("idx") % 2 == 0)),
         sql("WITH x AS (SELECT * REPLACE (CASE WHEN idx % 2 = 0 THEN greatest(0, start_s - 20) ELSE start_s END AS start_s, CASE WHEN idx % 2 = 0 THEN greatest(greatest(0, start_s - 20) + 0.05::DOUBLE, end_s - 20) ELSE end_s END AS end_s) FROM v_cues) SELECT {CUES} FROM x", "v_cues"))
register("scale_cues", lambda s, d: cues_out(c.scale_cues(v_cues(s, d), 1.25)),
         sql("WITH x AS (SELECT * REPLACE (start_s * 1.25::DOUBLE AS start_s, end_s * 1.25::DOUBLE AS end_s) FROM v_cues) SELECT {CUES} FROM x", "v_cues"))
register("round_cues", lambda s, d: cues_out(c.round_cues(v_cues(s, d))), sql("SELECT {CUES} FROM v_cues", "v_cues"))
register("cue_table_view", lambda s, d: c.cue_table_view(v_cues(s, d)).select("doc_id", "idx", "label", "speaker", "time", "text", "translation", (F.col("ratio") == "-").alias("no_ratio")),
         sql(f"""WITH x AS (SELECT *, {m('start_s')} AS a, {m('end_s')} AS b FROM v_cues) SELECT doc_id, idx, 'No. ' || (idx + 1) AS label, CASE WHEN speaker = '' THEN '1' ELSE speaker END AS speaker,
 printf('%02d:%02d:%02d,%03d', a // 3600000, a % 3600000 // 60000, a % 60000 // 1000, a % 1000) || ' --> ' || printf('%02d:%02d:%02d,%03d', b // 3600000, b % 3600000 // 60000, b % 60000 // 1000, b % 1000) AS time,
 text, translation, NOT ({RATIO} > 0) AS no_ratio FROM x""", "v_cues"))
register("sort_cues", lambda s, d: cues_out(c.sort_cues(v_cues(s, d).withColumn("start_s", F.floor("start_s").cast("double")))),
         sql("WITH x AS (SELECT * REPLACE (floor(start_s) AS start_s) FROM v_cues), y AS (SELECT * REPLACE (row_number() OVER (PARTITION BY doc_id ORDER BY start_s, end_s, idx) - 1 AS idx) FROM x) SELECT {CUES} FROM y", "v_cues"))
register("clean_cues", lambda s, d: cues_out(c.clean_cues(v_cues(s, d), "c,k", "ERROR")),
         sql("WITH x AS (SELECT * REPLACE (trim(regexp_replace(regexp_replace(replace(replace(text, 'c', ''), 'k', ''), 'error', '', 'gi'), '\\s+', ' ', 'g')) AS text) FROM v_cues) SELECT {CUES} FROM x WHERE text <> ''", "v_cues"))
register("drop_invalid_cues", lambda s, d: cues_out(c.drop_invalid_cues(v_cues(s, d))), sql("SELECT {CUES} FROM v_cues WHERE text <> '' AND end_s > start_s", "v_cues"))
register("pending_cues", lambda s, d: cues_out(c.pending_cues(v_cues(s, d))), sql("SELECT {CUES} FROM v_cues WHERE trim(text) <> ''", "v_cues"))
register("voice_windows", lambda s, d: c.voice_windows(v_cues(s, d)).select("doc_id", "idx", ms("start_s").alias("start_ms"), ms("length_s").alias("length_ms")),
         sql(f"SELECT doc_id, idx, {m('start_s')} AS start_ms, {m('greatest(0.05, least(end_s, start_s + 4) - start_s)')} AS length_ms FROM v_cues WHERE end_s - start_s >= 0.25::DOUBLE", "v_cues"))
register("merge_cues", lambda s, d: cues_out(c.merge_cues(v_cues(s, d), v_cues(s, d).where("idx between 3 and 5").select("doc_id", "idx"))),
         sql("""WITH p AS (SELECT doc_id, count(*) AS n FROM v_cues WHERE idx BETWEEN 3 AND 5 GROUP BY doc_id HAVING count(*) >= 2),
 g AS (SELECT v.doc_id, 3 AS idx, min(start_s) AS start_s, max(end_s) AS end_s, coalesce(string_agg(CASE WHEN trim(text) <> '' THEN trim(text) END, ' ' ORDER BY v.idx), '') AS text,
 coalesce(string_agg(CASE WHEN trim(translation) <> '' THEN trim(translation) END, ' ' ORDER BY v.idx), '') AS translation, coalesce(arg_min(speaker, v.idx) FILTER (speaker <> ''), '') AS speaker
 FROM v_cues v JOIN p USING (doc_id) WHERE v.idx BETWEEN 3 AND 5 GROUP BY v.doc_id),
 x AS (SELECT v.doc_id, CASE WHEN p.n IS NOT NULL AND v.idx > 5 THEN v.idx - p.n + 1 ELSE v.idx END AS idx, start_s, end_s, text, translation, speaker FROM v_cues v LEFT JOIN p USING (doc_id) WHERE p.n IS NULL OR v.idx NOT BETWEEN 3 AND 5
 UNION ALL SELECT doc_id, idx, start_s, end_s, text, translation, speaker FROM g) SELECT {CUES} FROM x""", "v_cues"))


def _cuts(s, d):
    return v_cues(s, d).where("idx % 4 = 1").select("doc_id", "idx", (F.col("start_s") + (F.col("end_s") - F.col("start_s")) / 2).alias("t"))


register("split_cues", lambda s, d: cues_out(c.split_cues(v_cues(s, d).withColumn("text", F.lit("aa bb cc dd")), _cuts(s, d))[0]).drop("translation"),
         sql("""WITH x AS (SELECT *, start_s + (end_s - start_s) / 2 AS t FROM v_cues), y AS (SELECT *, idx % 4 = 1 AND t >= start_s + 0.05::DOUBLE AND t <= end_s - 0.05::DOUBLE AS good FROM x),
 z AS (SELECT doc_id, idx, 0 AS half, start_s, CASE WHEN good THEN t ELSE end_s END AS end_s, CASE WHEN good THEN 'aa bb' ELSE 'aa bb cc dd' END AS text, '' AS translation, speaker FROM y
 UNION ALL SELECT doc_id, idx, 1, t, end_s, 'cc dd', '', speaker FROM y WHERE good),
 w AS (SELECT * REPLACE (row_number() OVER (PARTITION BY doc_id ORDER BY idx, half) - 1 AS idx) FROM z) SELECT * EXCLUDE translation FROM (SELECT {CUES} FROM w)""", "v_cues"))
register("split_rejects", lambda s, d: c.split_cues(v_cues(s, d), _cuts(s, d))[1].select("doc_id", "idx", ms("t").alias("t_ms")),
         sql(f"WITH x AS (SELECT *, start_s + (end_s - start_s) / 2 AS t FROM v_cues WHERE idx % 4 = 1) SELECT doc_id, idx, {m('t')} AS t_ms FROM x WHERE NOT (t >= start_s + 0.05::DOUBLE AND t <= end_s - 0.05::DOUBLE)", "v_cues"))
register("update_cues", lambda s, d: cues_out(c.update_cues(v_cues(s, d), v_cues(s, d).where("idx % 3 = 0").select(
    "doc_id", "idx", F.when(F.col("idx") % 2 == 0, F.col("start_s") + 1).alias("start_s"), (F.col("end_s") - 1).alias("end_s"), F.lit("new").alias("text"), F.lit(None).cast("string").alias("translation"), F.lit(None).cast("string").alias("speaker")))),
    sql("""WITH x AS (SELECT *, idx % 3 = 0 AS e, idx % 3 = 0 AND idx % 2 = 0 AS r, start_s + 1 AS ns, end_s - 1 AS ne FROM v_cues), y AS (SELECT * REPLACE (CASE WHEN r AND ne > ns THEN ns ELSE start_s END AS start_s,
 CASE WHEN r THEN CASE WHEN ne > ns THEN ne ELSE end_s END WHEN e THEN greatest(ne, start_s + 0.05::DOUBLE) ELSE end_s END AS end_s, CASE WHEN e THEN 'new' ELSE text END AS text) FROM x) SELECT {CUES} FROM y""", "v_cues"))
register("delete_cues", lambda s, d: cues_out(c.delete_cues(v_cues(s, d), v_cues(s, d).where("value > 50").select("doc_id", "idx"))),
         sql("WITH x AS (SELECT * REPLACE (row_number() {ORDER} - 1 AS idx) FROM v_cues WHERE NOT value > 50) SELECT {CUES} FROM x", "v_cues"))
register("insert_cues", lambda s, d: cues_out(c.insert_cues(v_cues(s, d), v_cues(s, d).where("idx % 10 = 0").select("doc_id", (F.col("start_s") + 0.5).alias("t")))),
         sql("""WITH x AS (SELECT doc_id, idx, start_s, end_s, text, translation, speaker FROM v_cues UNION ALL SELECT doc_id, NULL, start_s + 0.5::DOUBLE, start_s + 0.5::DOUBLE + 2, '', '', '' FROM v_cues WHERE idx % 10 = 0),
 y AS (SELECT * REPLACE (row_number() OVER (PARTITION BY doc_id ORDER BY start_s, end_s, idx NULLS LAST) - 1 AS idx) FROM x) SELECT {CUES} FROM y""", "v_cues"))
register("append_cues", lambda s, d: cues_out(c.append_cues(v_cues(s, d), v_source(s, d))),
         sql("""WITH x AS (SELECT doc_id, idx, start_s, end_s, text, translation, speaker, 0 AS l FROM v_cues UNION ALL SELECT doc_id, idx, start_s + 0.7, end_s + 0.7, text, translation, speaker, 1 FROM v_cues WHERE event_id % 2 = 0),
 y AS (SELECT * REPLACE (row_number() OVER (PARTITION BY doc_id ORDER BY start_s, end_s, l, idx) - 1 AS idx) FROM x) SELECT {CUES} FROM y""", "v_cues"))
register("doc_summary", lambda s, d: c.doc_summary(v_cues(s, d)).select("doc_id", "cue_count", "total_chars", "translated", ms("duration_s").alias("duration_ms")),
         sql(f"SELECT doc_id, count(*) AS cue_count, CAST(sum(length(text)) AS BIGINT) AS total_chars, count(*) FILTER (trim(translation) <> '') AS translated, {m('max(end_s)')} AS duration_ms FROM v_cues GROUP BY doc_id", "v_cues"))


def _projects(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_nationkey") % 2 == 0, "").otherwise("en").alias("target_language"),
                                          (F.col("c_nationkey") % 3 == 0).alias("has_dub"), (F.col("c_nationkey") % 5 == 0).alias("has_render"))


register("project_rollup", lambda s, d: c.project_rollup(_projects(s, d), v_cues(s, d)),
         sql("""WITH q AS (SELECT doc_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS ch, count(*) FILTER (trim(translation) <> '') AS tr FROM v_cues GROUP BY doc_id)
 SELECT c_custkey AS doc_id, coalesce(n, 0) AS cue_count, coalesce(ch, 0) AS total_chars, coalesce(n, 0) > 0 AS has_subtitle, coalesce(tr, 0) > 0 AS has_translation, c_nationkey % 3 = 0 AS has_dub,
 c_nationkey % 5 = 0 AS has_render, CASE WHEN c_nationkey % 2 = 0 THEN 'vi' ELSE 'en' END AS target_language FROM customer LEFT JOIN q ON doc_id = c_custkey""", "v_cues"))
register("project_states", lambda s, d: c.project_states(table(s, d, "customer").select(
    F.col("c_custkey").alias("doc_id"), *[(F.col("c_nationkey") % k == 0).alias(n) for k, n in enumerate(("has_audio", "has_subtitle", "has_translation", "has_dub", "has_render"), 2)],
    F.when(F.col("c_nationkey") % 2 == 0, "").otherwise("en").alias("language"), F.when(F.col("c_nationkey") % 3 == 0, "").otherwise("de").alias("target_language"), (F.col("c_custkey") * 1237).alias("char_count"))),
    "SELECT c_custkey AS doc_id, " + ", ".join(f"CASE WHEN c_nationkey % {k} = 0 THEN 'yes' ELSE 'no' END AS {n}" for k, n in enumerate(("has_audio", "has_subtitle", "has_translation", "has_dub", "has_render"), 2))
    + ", CASE WHEN c_nationkey % 2 <> 0 THEN 'en' WHEN c_nationkey % 3 <> 0 THEN 'de' ELSE '-' END AS language, replace(format('{:,}', c_custkey * 1237), ',', '.') AS chars FROM customer")


def _runs(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("batch"), F.when(F.col("o_orderkey") % 3 == 0, "render").otherwise("").alias("task"), (F.col("o_orderkey") % 100).alias("progress"),
                                        F.element_at(F.array(*[F.lit(x) for x in ("running", "pending", "done", "failed", "cancelled")]), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("status"),
                                        F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("message"), F.col("o_custkey").alias("project_id"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderkey") % 2 == 0).alias("has_render"))


RUNS = """(SELECT o_orderkey AS id, o_custkey AS batch, CASE WHEN o_orderkey % 3 = 0 THEN 'render' ELSE '' END AS task, o_orderkey % 100 AS progress, list_extract(['running','pending','done','failed','cancelled'], o_orderkey % 5 + 1) AS status,
 o_orderpriority AS name, o_orderstatus AS message, o_custkey AS project_id, o_orderdate AS created_at, o_orderkey % 2 = 0 AS has_render FROM orders)"""
register("reset_interrupted", lambda s, d: c.reset_interrupted(_runs(s, d)).select("id", "task", F.col("progress").cast("long").alias("progress"), "status"),
         f"SELECT id, '' AS task, CASE WHEN task <> '' THEN 0 ELSE progress END AS progress, CASE WHEN task <> '' THEN 'closed earlier' ELSE status END AS status FROM {RUNS}")
register("search_projects", lambda s, d: c.search_projects(_runs(s, d), " URGENT ", True).select("id", "name", "status", "task"),
         f"SELECT id, name, status, task FROM {RUNS} WHERE NOT has_render AND contains(lower(id || ' ' || name || ' ' || status || ' ' || task), 'urgent')")
register("batch_status", lambda s, d: c.batch_status(_runs(s, d)),
         f"SELECT batch, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'pending') AS waiting, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status IN ('failed', 'cancelled')) AS failed FROM {RUNS} GROUP BY batch")
register("project_log", lambda s, d: c.project_log(_runs(s, d), 7),
         f"SELECT id, '[' || strftime(created_at, '%Y-%m-%d %H:%M:%S') || '] ' || name || ' - ' || status || ': ' || message AS line FROM {RUNS} WHERE project_id = 7 ORDER BY id DESC LIMIT 200")
register("first_n_per_key", lambda s, d: c.first_n_per_key(_runs(s, d), "batch", [F.desc("id")], 3).select("batch", "id"),
         f"SELECT batch, id FROM {RUNS} QUALIFY row_number() OVER (PARTITION BY batch ORDER BY id DESC) <= 3")
register("recent_projects", lambda s, d: _runs(s, d).orderBy(F.desc("id")).limit(50).select("id", "name"), f"SELECT id, name FROM {RUNS} ORDER BY id DESC LIMIT 50")

# ---- timing
register("remove_overlaps", lambda s, d: t.remove_overlaps(v_cues(s, d)).transform(lambda x: cues_out(x).withColumn("fixed", F.lit(0)).drop("fixed")),
         sql("""WITH x AS (SELECT *, lead(start_s) OVER w AS n, row_number() OVER w - 1 AS place FROM v_cues WINDOW w AS (PARTITION BY doc_id ORDER BY start_s, end_s, idx)),
 y AS (SELECT doc_id, place AS idx, start_s, CASE WHEN end_s > n - 0.04::DOUBLE AND abs(greatest(start_s + 0.05::DOUBLE, n - 0.04::DOUBLE) - end_s) > 1e-6 THEN greatest(start_s + 0.05::DOUBLE, n - 0.04::DOUBLE) ELSE end_s END AS end_s, text, translation, speaker FROM x) SELECT {CUES} FROM y""", "v_cues"))
ISSUES = f"""WITH q AS (SELECT *, {DUR} AS dur, {CPS} AS cps, {RATIO} AS ratio, lead(start_s) {{ORDER}} AS n FROM v_cues),
 i AS (SELECT doc_id, idx, unnest([CASE WHEN end_s <= start_s THEN 'negative' WHEN dur < 0.5 THEN 'short' WHEN dur > 8 THEN 'long' END, CASE WHEN dur > 0 AND cps > 21 THEN 'fast' END,
 CASE WHEN trim(text) = '' AND trim(translation) = '' THEN 'empty' END, CASE WHEN trim(translation) <> '' AND ratio > 1.6::DOUBLE THEN 'ratio' END, CASE WHEN end_s > n + 1e-6 THEN 'overlap' WHEN n - end_s > 15 THEN 'gap' END]) AS kind FROM q),
 k AS (SELECT *, CASE WHEN kind IN ('negative', 'overlap') THEN 'error' ELSE 'warning' END AS severity FROM i WHERE kind IS NOT NULL)"""
register("check_timing", lambda s, d: t.check_timing(v_cues(s, d)).select("doc_id", "idx", "kind", "severity"), sql(ISSUES + " SELECT doc_id, idx, kind, severity FROM k", "v_cues"))
register("sort_issues", lambda s, d: t.sort_issues(t.check_timing(v_cues(s, d))).select("doc_id", "idx", "kind"), sql(ISSUES + " SELECT doc_id, idx, kind FROM k ORDER BY doc_id, idx, kind", "v_cues"))
register("issue_summary", lambda s, d: t.issue_summary(t.check_timing(v_cues(s, d))),
         sql(ISSUES + " SELECT doc_id, count(*) AS issues, count(*) FILTER (severity = 'error') AS errors, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("negative", "short", "long", "fast", "empty", "ratio", "overlap", "gap")) + " FROM k GROUP BY doc_id", "v_cues"))
register("make_continuous", lambda s, d: cues_out(t.make_continuous(v_cues(s, d))),
         sql("WITH q AS (SELECT *, lead(start_s) {ORDER} AS n FROM v_cues), x AS (SELECT * REPLACE (CASE WHEN n - end_s > 0 AND n - end_s <= 1.5::DOUBLE THEN n ELSE end_s END AS end_s) FROM q) SELECT {CUES} FROM x", "v_cues"))
register("merge_exact_repeats", lambda s, d: cues_out(t.merge_exact_repeats(v_cues(s, d, blanks=False), 10.0)),
         sql("""WITH q AS (SELECT * REPLACE (coalesce(nullif(text, ''), (SELECT event_type FROM events e WHERE e.event_id = v_cues.event_id)) AS text) FROM v_cues),
 f AS (SELECT *, CASE WHEN text = lag(text) {ORDER} AND start_s - lag(end_s) {ORDER} BETWEEN 0 AND 10 THEN 0 ELSE 1 END AS new FROM q), g AS (SELECT *, sum(new) {ORDER} AS island FROM f),
 x AS (SELECT doc_id, CAST(island - 1 AS BIGINT) AS idx, min(start_s) AS start_s, max(end_s) AS end_s, arg_min(text, idx) AS text, arg_min(translation, idx) AS translation, arg_min(speaker, idx) AS speaker FROM g GROUP BY doc_id, island) SELECT {CUES} FROM x""", "v_cues"))


def _voices(s, d):
    return v_cues(s, d).where("idx % 7 <> 6").select("doc_id", "idx", (F.col("value") / 8).alias("voice_s"))


register("dub_fit_plan", lambda s, d: t.dub_fit_plan(v_cues(s, d), _voices(s, d)).select("doc_id", "idx", ms("slot_s").alias("slot_ms"), F.round("tempo", 6).alias("tempo"), "apply", "over"),
         sql(f"""WITH q AS (SELECT *, lead(start_s) {{ORDER}} AS n, value / 8 AS voice FROM v_cues), x AS (SELECT *, greatest(0.1::DOUBLE, CASE WHEN n > start_s THEN least(end_s, n) ELSE end_s END - start_s) AS slot FROM q),
 y AS (SELECT *, CASE WHEN voice > slot THEN voice / slot ELSE 1.0 END AS raw FROM x WHERE idx % 7 <> 6) SELECT doc_id, idx, {m('slot')} AS slot_ms, round(least(raw, 2.5), 6) AS tempo, raw > 1.02::DOUBLE AS apply, raw > 2.5 AS over FROM y""", "v_cues"))
register("dub_report", lambda s, d: t.dub_report(t.dub_fit_plan(v_cues(s, d), _voices(s, d))),
         sql("""WITH q AS (SELECT *, lead(start_s) {ORDER} AS n, value / 8 AS voice FROM v_cues), x AS (SELECT *, greatest(0.1::DOUBLE, CASE WHEN n > start_s THEN least(end_s, n) ELSE end_s END - start_s) AS slot FROM q)
 SELECT doc_id, count(*) FILTER (voice > 0) AS made, count(*) FILTER (voice <= 0) AS failed, count(*) FILTER (voice > slot AND voice / slot > 2.5) AS over_tempo, count(*) FILTER (voice * 1000 < 500) AS short FROM x WHERE idx % 7 <> 6 GROUP BY doc_id""", "v_cues"))


def _strict(s, d):
    return v_cues(s, d)


register("voice_timeline", lambda s, d: t.voice_timeline(_strict(s, d), _voices(s, d), table(s, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(5000.0).alias("total_s")))[0].select(
    "doc_id", "idx", ms("src_end").alias("src_end_ms"), ms("target_s").alias("target_ms"), F.round(F.col("new_start"), 2).alias("new_start"), F.round(F.col("new_end"), 2).alias("new_end")),
    sql(f"""WITH q AS (SELECT *, coalesce(lead(start_s) {{ORDER}}, greatest(end_s, start_s + 0.04::DOUBLE)) AS src_end, first(start_s) {{ORDER}} AS first FROM v_cues),
 x AS (SELECT *, greatest(0.04::DOUBLE, src_end - start_s, CASE WHEN idx % 7 <> 6 THEN value / 8 ELSE 0 END) AS target FROM q),
 y AS (SELECT *, coalesce(sum(target) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN first > 0.001 THEN first ELSE 0 END AS laid FROM x)
 SELECT doc_id, idx, {m('src_end')} AS src_end_ms, {m('target')} AS target_ms, round(round_even(laid * 1e6, 0) / 1e6, 2) AS new_start, round(round_even((laid + target) * 1e6, 0) / 1e6, 2) AS new_end FROM y""", "v_cues"))
register("translation_batches", lambda s, d: t.translation_batches(v_cues(s, d), 8).select("doc_id", "batch", F.array_join("texts", "|").alias("texts"), "context_before", "context_after"),
         sql("""WITH q AS (SELECT *, row_number() {ORDER} - 1 AS n, lag(text) {ORDER} AS b, lead(text) {ORDER} AS a FROM v_cues WHERE text <> '')
 SELECT doc_id, n // 8 AS batch, string_agg(text, '|' ORDER BY n) AS texts, coalesce(first(b ORDER BY n), '') AS context_before, coalesce(last(a ORDER BY n), '') AS context_after FROM q GROUP BY doc_id, n // 8""", "v_cues"))
register("spread_sample", lambda s, d: t.spread_sample(v_cues(s, d), "doc_id", "idx", 7).select("doc_id", "idx"),
         sql("""WITH q AS (SELECT doc_id, idx, row_number() {ORDER} - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM v_cues)
 SELECT doc_id, idx FROM q WHERE n <= 7 OR i IN (SELECT CAST(round_even(k * (n - 1) / 6, 0) AS BIGINT) FROM range(7) r(k))""", "v_cues"))
register("thin", lambda s, d: t.thin(v_cues(s, d), "doc_id", "idx", 10).select("doc_id", "idx"),
         sql("WITH q AS (SELECT doc_id, idx, row_number() {ORDER} - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM v_cues) SELECT doc_id, idx FROM q WHERE i % CAST(ceil(n / 10) AS BIGINT) = 0", "v_cues"))
register("frame_gap", lambda s, d: t.frame_gap(v_cues(s, d).select(F.col("doc_id").alias("video_id"), F.col("start_s").alias("stamp_s")), 12.0).select("video_id", ms("gap_s").alias("gap_ms")),
         sql(f"WITH q AS (SELECT doc_id, start_s - lag(start_s) OVER (PARTITION BY doc_id ORDER BY start_s) AS g FROM v_cues) SELECT doc_id AS video_id, {m('coalesce(least(max(CASE WHEN g > 0 THEN g END), 24), 12)')} AS gap_ms FROM q GROUP BY doc_id", "v_cues"))

# ---- joins
register("cue_at", lambda s, d: j.cue_at(v_cues(s, d), v_source(s, d).select("doc_id", F.col("start_s").alias("t"))).select("doc_id", ms("t").alias("t_ms"), F.col("idx").cast("long").alias("idx")),
         sql(f"WITH p AS (SELECT DISTINCT doc_id, start_s AS t FROM v_source) SELECT p.doc_id, {m('t')} AS t_ms, coalesce(min(v.idx), -1) AS idx FROM p LEFT JOIN v_cues v ON v.doc_id = p.doc_id AND v.start_s <= p.t AND p.t < v.end_s GROUP BY p.doc_id, p.t", "v_cues", "v_source"))
register("align_translations", lambda s, d: j.align_translations(v_cues(s, d), v_source(s, d)),
         sql("""WITH c AS (SELECT doc_id, idx, translation, (start_s + end_s) / 2 AS mid FROM v_cues), r AS (SELECT doc_id, idx AS sidx, text, start_s, end_s, (start_s + end_s) / 2 AS smid FROM v_source),
 h AS (SELECT c.doc_id, c.idx, min(sidx) AS sidx FROM c JOIN r ON r.doc_id = c.doc_id AND r.start_s <= c.mid AND c.mid < r.end_s GROUP BY c.doc_id, c.idx),
 n AS (SELECT c.doc_id, c.idx, sidx FROM c JOIN r ON r.doc_id = c.doc_id AND abs(r.smid - c.mid) <= 2.0 QUALIFY row_number() OVER (PARTITION BY c.doc_id, c.idx ORDER BY abs(r.smid - c.mid), sidx) = 1),
 z AS (SELECT c.doc_id, c.idx, c.translation, coalesce(h.sidx, n.sidx) AS sidx FROM c LEFT JOIN h ON h.doc_id = c.doc_id AND h.idx = c.idx LEFT JOIN n ON n.doc_id = c.doc_id AND n.idx = c.idx)
 SELECT z.doc_id, z.idx, coalesce(z.sidx, -1) AS source_idx, coalesce(r.text, z.translation) AS translation FROM z LEFT JOIN r ON r.doc_id = z.doc_id AND r.sidx = z.sidx""", "v_cues", "v_source"))


def _memory(s, d):
    from ..functions.text import translation_key

    kinds = table(s, d, "events").select("event_type").distinct()
    return kinds.select(translation_key(F.lit("p"), F.lit("en"), F.lit("vi"), F.col("event_type")).alias("key"), F.when(F.col("event_type") == "view", " ").otherwise(F.upper("event_type")).alias("result"))


register("translation_memory", lambda s, d: j.translation_memory(v_cues(s, d), _memory(s, d), "p", "en", "vi"),
         sql("SELECT doc_id, idx, sha256('p|en|vi|' || text) AS key, CASE WHEN text = 'view' THEN translation ELSE upper(text) END AS translation, text = 'view' AS pending FROM v_cues WHERE text <> ''", "v_cues"))
register("missing_frames", lambda s, d: j.missing_frames(v_cues(s, d).groupBy(F.col("doc_id").alias("cache_key")).agg(F.count("*").alias("total")), v_cues(s, d).where("value < 40").select(F.col("doc_id").alias("cache_key"), F.col("idx").alias("frame_idx"))),
         sql("SELECT doc_id AS cache_key, idx AS frame_idx FROM v_cues WHERE NOT value < 40", "v_cues"))
register("missing_keys", lambda s, d: v_cues(s, d).select("doc_id", "idx").exceptAll(v_cues(s, d).where("value < 40").select("doc_id", "idx")), sql("SELECT doc_id, idx FROM v_cues EXCEPT ALL SELECT doc_id, idx FROM v_cues WHERE value < 40", "v_cues"))
register("assign_speakers", lambda s, d: j.assign_speakers(v_cues(s, d), v_cues(s, d).where("idx % 5 <> 0").select("doc_id", "idx", (F.col("value") * 5 - 50).alias("pitch"))).select("doc_id", "idx", "speaker", "assigned"),
         sql("SELECT doc_id, idx, CASE WHEN idx % 5 = 0 OR value * 5 - 50 <= 0 THEN speaker WHEN value * 5 - 50 < 165 THEN 'Nam' ELSE 'Nu' END AS speaker, NOT (idx % 5 = 0 OR value * 5 - 50 <= 0) AS assigned FROM v_cues", "v_cues"))
register("match_voice_profile", lambda s, d: j.match_voice_profile(v_cues(s, d), table(s, d, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 == 0, "default").when(F.col("n_nationkey") % 3 == 1, "nu").otherwise("nam").alias("gender"))),
         sql("WITH n AS (SELECT n_name, n_nationkey % 3 AS k, n_nationkey AS p FROM nation) SELECT doc_id, idx, (SELECT arg_min(n_name, p) FROM n WHERE k = CASE speaker WHEN 'Nam' THEN 2 WHEN 'Nu' THEN 1 ELSE 0 END) AS profile FROM v_cues", "v_cues"))
register("apply_timing", lambda s, d: cues_out(j.apply_timing(v_cues(s, d), v_cues(s, d).where("doc_id % 2 = 0 or idx > 0").select("doc_id", "idx", (F.col("start_s") + 1).alias("new_start"), (F.col("start_s") + F.col("value") - 5).alias("new_end")))),
         sql("WITH x AS (SELECT * REPLACE (CASE WHEN doc_id % 2 = 0 AND start_s + value - 5 > start_s + 1 THEN start_s + 1 ELSE start_s END AS start_s, CASE WHEN doc_id % 2 = 0 AND start_s + value - 5 > start_s + 1 THEN start_s + value - 5 ELSE end_s END AS end_s) FROM v_cues) SELECT {CUES} FROM x", "v_cues"))


def _replies(s, d):
    """Replies to batches of 20 cues."""
    batched = v_cues(s, d).withColumns({"part": F.floor(F.col("idx") / 20), "at": F.col("idx") % 20})
    rows = batched.groupBy("doc_id", "part").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("r"), F.count("*").cast("int").alias("expected"))
    body = F.to_json(F.struct(F.transform(F.filter("r", lambda x: x["at"] % 3 != 0), lambda x: F.struct(x["at"].cast("string").alias("id"), x["text"].alias("text"))).alias("translations")))
    return rows.select((F.col("doc_id") * 1_000_000 + F.col("part")).alias("batch"), F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("response"), "expected")


register("scatter_results", lambda s, d: j.scatter_results(_replies(s, d)).select("batch", F.array_join("texts", "|").alias("texts")),
         sql("SELECT doc_id * 1000000 + idx // 20 AS batch, string_agg(CASE WHEN idx % 20 % 3 <> 0 THEN text ELSE '' END, '|' ORDER BY idx) AS texts FROM v_cues GROUP BY ALL", "v_cues"))
register("language_names", lambda s, d: j.language_names(table(s, d, "documents"), {"en": "English", "de": "German", "fr": "French"}).groupBy("lang", "language_name").count().withColumnRenamed("count", "documents"),
         "SELECT lang, coalesce(CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' END, lang) AS language_name, count(*) AS documents FROM documents GROUP BY lang")
register("union_ignore_lists", lambda s, d: table(s, d, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("a")).select("c_nationkey", F.array_join(F.array_union("a", F.array(F.lit("LOGO"), F.lit("BUILDING"))), "|").alias("items")),
         "SELECT c_nationkey, array_to_string(list_concat(l, list_filter(['LOGO', 'BUILDING'], lambda x: NOT list_contains(l, x))), '|') AS items FROM (SELECT c_nationkey, list_sort(list(DISTINCT c_mktsegment)) AS l FROM customer GROUP BY c_nationkey)")
register("catalog_profile", lambda s, d: audit.catalog_profile(s, {n: f"{d}/{n}.parquet" for n in ("region", "nation", "customer", "orders")}),
         " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS rows, (SELECT string_agg(column_name, ',' ORDER BY column_index) FROM duckdb_columns() WHERE table_name = '{n}') AS columns FROM {n}" for n in ("region", "nation", "customer", "orders")))
