"""Timed-text relations over the given tables, in Spark and in DuckDB SQL with the same definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v_cues(spark: SparkSession, sf_dir: str, blanks: bool = True) -> DataFrame:
    """One cue for every event: a user's events are a document."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    start = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 3.6e9
    text = F.when(F.col("event_id") % 17 == 0, "").otherwise(F.col("event_type")) if blanks else F.col("event_type")
    return e.select(
        F.col("user_id").alias("doc_id"), (F.row_number().over(w) - 1).cast("long").alias("idx"), start.alias("start_s"),
        (start + F.col("value") / 10).alias("end_s"), text.alias("text"),
        F.when(F.col("event_id") % 3 == 0, F.concat("event_type", "event_type")).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise("").alias("translation"),
        F.when(F.col("event_id") % 3 == 0, "Nam").when(F.col("event_id") % 3 == 1, "Nu").otherwise("").alias("speaker"), "event_id", "value")


V_CUES = """v_cues AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
 (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9 AS start_s, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9 + value / 10 AS end_s,
 CASE WHEN event_id % 17 = 0 THEN '' ELSE event_type END AS text,
 CASE event_id % 3 WHEN 0 THEN event_type || event_type WHEN 1 THEN props ELSE '' END AS translation,
 CASE event_id % 3 WHEN 0 THEN 'Nam' WHEN 1 THEN 'Nu' ELSE '' END AS speaker, event_id, value FROM events)"""


def v_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second track: the cues of even events, 0.7 s later."""
    return v_cues(spark, sf_dir).where("event_id % 2 = 0").withColumns({"start_s": F.col("start_s") + 0.7, "end_s": F.col("end_s") + 0.7})


V_SOURCE = "v_source AS (SELECT doc_id, idx, start_s + 0.7 AS start_s, end_s + 0.7 AS end_s, text FROM v_cues WHERE event_id % 2 = 0)"


def v_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame reads (video_id, frame_idx, stamp_s, text, score): 'view' events read nothing."""
    c = v_cues(spark, sf_dir, blanks=False)
    return c.select(F.col("doc_id").alias("video_id"), F.col("idx").alias("frame_idx"), F.col("start_s").alias("stamp_s"),
                    F.when(F.col("text") == "view", "").otherwise(F.col("text")).alias("text"), F.least(F.col("value") / 500, F.lit(1.0)).alias("score"))


V_READS = """v_reads AS (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
 (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3.6e9 AS stamp_s, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS text,
 least(value / 500, 1.0) AS score FROM events)"""


SAID = ["paper lantern", "rain at noon", "call me later", "", "nobody home"]


def v_noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame reads whose captions last some frames, with odd letters, scraps and blanks in them."""
    c = v_cues(spark, sf_dir, blanks=False)
    said = F.get(F.array(*map(F.lit, SAID)), ((F.col("doc_id") * 7 + F.floor(F.col("idx") / 5)) % len(SAID)).cast("int"))
    at = F.col("event_id") % 9 + 2
    odd = F.concat(F.substring(said, F.lit(1), (at - 1).cast("int")), F.lit("x"), F.substring(said, (at + 1).cast("int"), F.lit(100)))
    text = (F.when(said == "", "").when(F.col("event_id") % 19 == 0, "").when(F.col("event_id") % 17 == 0, "C.15").when(F.col("event_id") % 3 == 0, odd)
            .when(F.col("event_id") % 11 == 0, F.concat(said, F.lit(" and so on"))).otherwise(said))
    return c.select(F.col("doc_id").alias("video_id"), F.col("idx").alias("frame_idx"), F.col("start_s").alias("stamp_s"), text.alias("text"), F.round(F.least(F.col("value") / 500, F.lit(1.0)), 3).alias("score"))


SAID_SQL = "['" + "', '".join(SAID) + "']"
V_NOISY = f"""v_noisy AS (SELECT doc_id AS video_id, idx AS frame_idx, start_s AS stamp_s, CASE WHEN said = '' OR event_id % 19 = 0 THEN '' WHEN event_id % 17 = 0 THEN 'C.15'
 WHEN event_id % 3 = 0 THEN substring(said, 1, event_id % 9 + 1) || 'x' || substring(said, event_id % 9 + 3) WHEN event_id % 11 = 0 THEN said || ' and so on' ELSE said END AS text,
 round(least(value / 500, 1.0), 3) AS score FROM (SELECT *, {SAID_SQL}[1 + (doc_id * 7 + idx // 5) % {len(SAID)}] AS said FROM v_cues))"""


def v_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank lines of documents as cues of 3 s back to back."""
    from ..sources.subtitles import read_plain_text

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text").alias("value"))
    return read_plain_text(docs)


V_LINES = """v_lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS idx, trim(line, E' \\t\\r\\n') AS text FROM (
 SELECT doc_id, unnest(string_split(text, E'\\n')) AS line, generate_subscripts(string_split(text, E'\\n'), 1) AS pos FROM documents)
 WHERE trim(line, E' \\t\\r\\n') <> '')"""


def v_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text boxes of frames from line items."""
    x1, y1 = (F.col("l_partkey") % 900).cast("double"), ((F.col("l_suppkey") % 8) * 12).cast("double")
    rect = F.struct(x1.alias("x1"), y1.alias("y1"), (x1 + 40 + 4 * F.col("l_quantity")).alias("x2"), (y1 + 30 + F.col("l_linenumber")).alias("y2"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).cast("long").alias("box"),
        rect.alias("rect"), F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("text"), (1 - 5 * F.col("l_discount")).alias("score"))


V_BOXES = """v_boxes AS (SELECT l_orderkey AS frame, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS box,
 (l_partkey % 900)::DOUBLE AS x1, ((l_suppkey % 8) * 12)::DOUBLE AS y1, (l_partkey % 900)::DOUBLE + 40 + 4 * l_quantity AS x2,
 ((l_suppkey % 8) * 12)::DOUBLE + 30 + l_linenumber AS y2, l_returnflag || l_linestatus || l_linenumber::VARCHAR AS text, 1 - 5 * l_discount AS score FROM lineitem)"""


def v_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration documents from customers."""
    c = table(spark, sf_dir, "customer")
    value = F.to_json(F.struct(
        F.col("c_name").alias("video_file"), F.col("c_mktsegment").alias("segment"), F.concat(F.lit("secret"), F.col("c_custkey").cast("string")).alias("api_token"),
        F.array(F.array(F.lit("1"), F.lit("00:00:01,000 --> 00:00:02,500"), F.lit("A"), F.col("c_name"), F.col("c_mktsegment")),
                F.array(F.lit("2"), F.concat(F.lit("00:00:"), F.lpad((F.col("c_custkey") % 60).cast("string"), 2, "0"), F.lit(",250 --> 00:00:30,000")), F.lit("B"), F.col("c_mktsegment"))).alias("data_table")))
    return c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 == 0, F.concat("c_name", F.lit(" (NOT USED)"))).otherwise(F.col("c_name")).alias("name"), value.alias("value"),
                    F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment"))
