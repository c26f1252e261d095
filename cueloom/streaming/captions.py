"""Captions and timing checks over streams."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.captions import OnScreen
from ..operators.smoothing import Smoothing
from ..operators.timing import check_timing
from ..sources.subtitles import read_subtitles

_OUT = "video_id long, start_s double, end_s double, text string"
_COLUMNS = ["video_id", "start_s", "end_s", "text"]
_WAITING = ["frame_idx", "at_ms", "stamp_s", "text", "score"]


class _Fold:
    """What one video's reads come to so far: the smoothing's memory, the caption that is on, and the last read's times."""

    def __init__(self, threshold: float, least: float, step: float, idle_ms: int, votes: int, flicker: bool, known: dict | None):
        known = known or {}
        self.threshold, self.least, self.step, self.idle_ms, self.votes, self.flicker = threshold, least, step, idle_ms, votes, flicker
        self.smoothing = Smoothing(votes, flicker, threshold, known.get("smoothing"))
        self.on = OnScreen(threshold, least, known.get("start", 0.0), [tuple(x) for x in known.get("said", ())])
        self.last, self.last_at = known.get("last", 0.0), known.get("last_at")

    def take(self, at_ms: int, stamp: float, text: str, score: float) -> list[tuple]:
        """Captions that have ended with this read; a pause of over ``idle`` before it ends what was on."""
        out = self.end() if self.last_at is not None and at_ms - self.last_at > self.idle_ms else []
        self.last, self.last_at = stamp, at_ms
        for read in self.smoothing.take((stamp, text, score)):
            out += self.on.read(*read)
        return out

    def end(self) -> list[tuple]:
        """The captions that are left where no read follows; the video begins anew after that."""
        out = []
        for read in self.smoothing.end():
            out += self.on.read(*read)
        out += self.on.until(self.last + self.step)
        self.smoothing, self.on, self.last_at = Smoothing(self.votes, self.flicker, self.threshold), OnScreen(self.threshold, self.least), None
        return out

    def known(self) -> dict:
        return {"smoothing": self.smoothing.memory, "start": self.on.start, "said": self.on.support.dump(), "last": self.last, "last_at": self.last_at}


class _Captions(StatefulProcessor):
    """Reads wait until the watermark has gone by, and then are folded in frame order; timers tell when.

    Videos may be many: each call to the state costs about as much as a video's fold, and so does an empty frame of rows.
    """

    def __init__(self, idle_ms: int, **fold):
        self.idle_ms, self.settings = idle_ms, dict(fold, idle_ms=idle_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "frame_idx long, at_ms long, stamp_s double, text string, score double")
        self.fold = handle.getValueState("fold", "known string, wake long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = [r for pdf in rows for r in pdf[_WAITING].itertuples(index=False, name=None) if isinstance(r[3], str)]
        if found:
            self.waiting.appendList([(int(f), int(at), float(stamp), text, float(score)) for f, at, stamp, text, score in found])
            known, wake = self.fold.get() or (None, None)
            first = min(int(r[1]) for r in found) + 1
            if wake is None or first < wake:
                self._wake(known, wake, first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        known, _ = self.fold.get() or (None, None)
        fold = _Fold(**self.settings, known=json.loads(known) if known else None)
        waiting = sorted(self.waiting.get())
        later = [r for r in waiting if r[1] >= now]
        out = []
        for frame, at, stamp, text, score in waiting:
            if at < now:
                out += fold.take(at, stamp, text, score)
        if not later and fold.last_at is not None and fold.last_at + self.idle_ms < now:
            out += fold.end()
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        wake = min(r[1] for r in later) + 1 if later else fold.last_at + self.idle_ms + 1 if fold.last_at is not None else None
        if wake is None:
            self.fold.clear()
        else:
            self._wake(json.dumps(fold.known()), None, wake)
        return iter([pd.DataFrame([(key[0], *row) for row in out], columns=_COLUMNS)] if out else [])

    def _wake(self, known: str | None, before: int | None, at: int) -> None:
        """One timer a video: the first moment at which a read that waits may be folded, or at which the video is idle."""
        if before is not None:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        self.fold.update((known, at))

    def close(self) -> None:
        pass


def stream_merge_captions(reads: DataFrame, fps: float = 15.0, threshold: float = 0.8, least: float = 0.2, idle: str = "10 minutes", delay: str = "10 seconds",
                          time_column: str = "at", votes: int = 1, flicker: bool = False) -> DataFrame:
    """Captions of an unbounded stream of reads (video_id, frame_idx, stamp_s, text, score, at), emitted as each one ends.

    A read waits in state until the watermark, ``delay`` behind the latest ``at`` of all videos, has passed it; then a
    timer fires, and the reads that the watermark has passed are folded in frame order. So reads may come out of order
    by ``delay``; later ones are dropped, as is one whose time is not after 1970 began, where the watermark starts. A video without reads for ``idle`` is flushed, its last caption included; a
    pause of over ``idle`` inside a video ends its caption in any case, whatever the triggers. ``votes`` and ``flicker``
    smooth reads as in ``merge_captions``, delayed by their radius; the rows then are those of the batch operator.

    Times grow with the frames of a video. State a video: the reads that wait, at most 2 * votes + 1 that smoothing looks
    at, and counts of the distinct texts of the caption that is on. Rows without a text are no reads; they only move the
    watermark. Rows without a video are left out. Needs the RocksDB state store (``run.rows_of_stream`` sets it for a query).
    """
    interval = F.expr(f"interval {idle}")
    idle_ms = reads.sparkSession.range(1).select((F.unix_millis(F.timestamp_seconds(F.lit(0)) + interval) - F.unix_millis(F.timestamp_seconds(F.lit(0)))).alias("ms")).first()["ms"]
    processor = _Captions(idle_ms, threshold=threshold, least=least, step=1.0 / max(0.2, fps), votes=votes, flicker=flicker)
    timed = reads.where("video_id is not null").withWatermark(time_column, delay).withColumn("at_ms", F.unix_millis(time_column))
    return timed.groupBy("video_id").transformWithStateInPandas(processor, _OUT, "Append", "EventTime")


def stream_subtitle_qc(files: DataFrame, sink, read_once: bool = False):
    """A started query over subtitle files (doc_id, value) as they land: ``sink(issues, batch_id)`` gets each batch's issues.

    A file is whole in its batch, so that no state is kept. Files tell times as decimals, and are held to limits as such.
    Each format reads the batch; with ``read_once`` a copy of it on the executors' disks, where many small files cost much to open.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        if read_once:
            batch = batch.persist(StorageLevel.DISK_ONLY)
        try:
            sink(check_timing(read_subtitles(batch)[0], digits=6), batch_id)
        finally:
            if read_once:
                batch.unpersist()

    return files.writeStream.foreachBatch(each)
