"""Clips of running videos as keyed state, and the same in batch.

A clip is a span of ``seconds`` of its video's clock. It closes when a frame of
a later clip of the video arrives or when the watermark passes its end, and is
then sent once, with the time of the last frame read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import prepare

OUT = "video_id long, clip_no long, first_frame timestamp, last_frame timestamp, n_frames long, n_sampled long, late boolean"
_STATE = "first timestamp, last timestamp, n long, sampled long"


def _spans(rows: Iterator[pd.DataFrame], every: int) -> dict[int, tuple]:
    """Of each clip in the rows: first and last time, frames, sampled frames."""
    out: dict[int, tuple] = {}
    for pdf in rows:
        if pdf["clip_no"].hasnans:
            pdf = pdf[pdf["clip_no"].notna()]
        if not len(pdf):
            continue
        clip = pdf["clip_no"].to_numpy().astype("int64")
        order = np.argsort(clip, kind="stable")
        clip, ts, hit = clip[order], pdf["ts"].to_numpy("datetime64[ns]")[order], (pdf["frame_no"].to_numpy()[order] % every == 0).astype("int64")
        at = np.flatnonzero(np.concatenate(([True], clip[1:] != clip[:-1])))
        parts = zip(clip[at].tolist(), np.minimum.reduceat(ts, at), np.maximum.reduceat(ts, at), np.diff([*at, len(clip)]).tolist(), np.add.reduceat(hit, at).tolist(), strict=True)
        for k, first, last, n, sampled in parts:
            f, t, m, s = out.get(k, (pd.Timestamp.max, pd.Timestamp.min, 0, 0))
            out[k] = (min(f, pd.Timestamp(first)), max(t, pd.Timestamp(last)), n + m, sampled + s)
    return out


class _Clips(StatefulProcessor):
    """Open clips of one video by number; ``closed`` is the last one sent."""

    def __init__(self, seconds: int, every: int):
        self.seconds, self.every = seconds, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "clip long", _STATE)
        self.closed = handle.getValueState("closed", "clip long")

    def _sent(self) -> int:
        return self.closed.get()[0] if self.closed.exists() else -(1 << 62)

    def _row(self, key, clip: int, first, last, n: int, sampled: int, late: bool) -> dict:
        return {"video_id": key[0], "clip_no": clip, "first_frame": first, "last_frame": last, "n_frames": n, "n_sampled": sampled, "late": late}

    def _close(self, key, before: int) -> list[dict]:
        """Rows of the open clips below ``before``, which are forgotten."""
        out = []
        for k, v in sorted((k[0], v) for k, v in self.open.iterator()):
            if k < before:
                out.append(self._row(key, k, *v, False))
                self.open.removeKey((k,))
                self.closed.update((max(k, self._sent()),))
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = _spans(rows, self.every)
        if not new:
            return
        sent = self._sent()
        out = [self._row(key, k, *v, True) for k, v in sorted(new.items()) if k <= sent]
        new = {k: v for k, v in new.items() if k > sent}
        held = {k[0]: v for k, v in self.open.iterator()} if new else {}
        for k in new.keys() & held.keys():
            f, t, m, n = held[k]
            first, last, frames, sampled = new[k]
            new[k] = (min(first, pd.Timestamp(f)), max(last, pd.Timestamp(t)), frames + m, sampled + n)
        # a clip that a later one of the same rows closes never gets into the state
        seen = max(new, default=-(1 << 62))
        done = {k: v for k, v in {**held, **new}.items() if k < seen}
        for k, v in sorted(done.items()):
            out.append(self._row(key, k, *v, False))
            if k in held:
                self.open.removeKey((k,))
        if done:
            self.closed.update((max(done),))
        for k, (first, last, frames, sampled) in new.items():
            if k not in done:
                if k not in held:
                    self.handle.registerTimer((k + 1) * self.seconds * 1000)
                self.open.updateValue((k,), (first.to_pydatetime(), last.to_pydatetime(), frames, sampled))
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self._close(key, expiredTimerInfo.getExpiryTimeInMs() // (self.seconds * 1000))
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def _numbered(frames: DataFrame, seconds: int) -> DataFrame:
    return frames.select("video_id", "frame_no", F.col("ts").cast("timestamp").alias("ts")).withColumn("clip_no", F.floor(F.unix_micros("ts") / (seconds * 1_000_000)))


def running_clips(frames: DataFrame, *, seconds: int, every: int = 1, late: str = "1 hour") -> DataFrame:
    """Stream of ``frames(video_id long, frame_no long, ts)`` -> closed clips.
    Every ``every``-th frame is a sampled one. Frames of a clip that is closed
    already are sent at once as a row of their own with ``late``; the state of
    a video holds its open clips only. Needs the RocksDB state store."""
    spark = prepare(frames.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = _numbered(frames, seconds).withWatermark("ts", late)
    return timed.groupBy("video_id").transformWithStateInPandas(_Clips(seconds, every), OUT, "append", "eventTime")


def closed_clips(frames: DataFrame, *, seconds: int, every: int = 1, late_seconds: int = 3600) -> DataFrame:
    """The batch twin over all frames: the clips that ``running_clips`` has
    closed when it has read them in order."""
    rows = _numbered(frames, seconds)
    clips = rows.groupBy("video_id", "clip_no").agg(F.min("ts").alias("first_frame"), F.max("ts").alias("last_frame"), F.count(F.lit(1)).alias("n_frames"), F.count_if(F.col("frame_no") % every == 0).alias("n_sampled"))
    mark = rows.agg((F.max(F.unix_micros("ts")) / 1e6 - late_seconds).alias("_mark"))
    last = F.max("clip_no").over(Window.partitionBy("video_id"))
    done = clips.withColumn("_last", last).join(F.broadcast(mark)).where((F.col("clip_no") < F.col("_last")) | ((F.col("clip_no") + 1) * seconds <= F.col("_mark")))
    return done.drop("_last", "_mark").withColumn("late", F.lit(False))
