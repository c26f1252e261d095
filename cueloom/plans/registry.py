"""Every registered query and its SQL. Times come out as whole milliseconds, ratios with six decimals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.timecode import millis
from .relations import V_BOXES, V_CUES, V_LINES, V_NOISY, V_READS, V_SOURCE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BASES = {"v_cues": V_CUES, "v_source": V_SOURCE, "v_reads": V_READS, "v_noisy": V_NOISY, "v_lines": V_LINES, "v_boxes": V_BOXES}


def ms(column: str | Column) -> Column:
    """Whole milliseconds of a time that may be negative."""
    return F.rint((F.col(column) if isinstance(column, str) else column) * 1000).cast("long")


def cues_out(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.col("idx").cast("long").alias("idx"), ms("start_s").alias("start_ms"), ms("end_s").alias("end_ms"), "text", "translation", "speaker")


MS = "CAST(round_even({} * 1000, 0) AS BIGINT)"
CUES_OUT = f"doc_id, idx, {MS.format('start_s')} AS start_ms, {MS.format('end_s')} AS end_ms, text, translation, speaker"
ORDER = "OVER (PARTITION BY doc_id ORDER BY idx)"


def sql(body: str, *bases: str, recursive: bool = False) -> str:
    """A query over the base relations that it names; {ORDER}, {CUES} and m(x) stand for common parts."""
    body = body.replace("{ORDER}", ORDER).replace("{CUES}", CUES_OUT)
    parts = ",\n".join(BASES[b] for b in bases)
    if not parts:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}" + (f",\n{body[5:]}" if body.startswith("WITH ") else f"\n{body}")


def lcs(pairs: str) -> str:
    """A relation ratios (a, b, r) for a relation of texts (a, b): twice the longest common subsequence over both lengths."""
    return f"""lengths AS (SELECT a, b, list_last(list_reduce(list_prepend([0 for x in range(length(b) + 1)], [[i] for i in range(1, length(a) + 1)]), lambda row, i: list_reduce(list_prepend([0], [[j] for j in range(1, length(b) + 1)]),
 lambda acc, j: list_append(acc, CASE WHEN substring(a, i[1]::INT, 1) = substring(b, j[1]::INT, 1) THEN row[j[1]] + 1 ELSE greatest(row[j[1] + 1], list_last(acc)) END)))) AS n FROM {pairs}),
 ratios AS MATERIALIZED (SELECT a, b, 2 * n / (length(a) + length(b)) AS r FROM lengths)"""


def register(name: str, query: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues to SRT text, read back, checked and summarised by document."""
    from ..operators.timing import check_timing, issue_summary
    from ..sources.sinks import to_srt
    from ..sources.subtitles import read_srt
    from .relations import v_cues

    return issue_summary(check_timing(read_srt(to_srt(v_cues(spark, sf_dir)))[0]))


from . import queries_captions, queries_cues, queries_text  # noqa: E402,F401  (they register themselves)

__all__ = ["ORACLES", "QUERIES", "flagship", "millis", "register", "sql"]
